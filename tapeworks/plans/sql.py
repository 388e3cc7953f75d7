"""SQL over registered tables, and the ordered indicators as table functions.

    SELECT * FROM ema(TABLE(quotes), period => 26)
    SELECT * FROM macd(TABLE(SELECT symbol, ts, close FROM bars), fast => 8, price => 'close')

A table function takes any table with ``symbol``, ``ts`` and a column of prices, keeps all its columns and adds its own. It asks for
its rows by symbol and in order of ``ts`` (and ``seq``, if the table has it) itself, so the call has no PARTITION BY. Periods and the name
of the column of prices are constants of the call. A price that is null gives null values and does not change the state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, UserDefinedTableFunction
from pyspark.util import PythonEvalType

from ..functions.steps import Bands, Ema, Macd, Mean, Rsi


def query(spark: SparkSession, text: str, **args) -> DataFrame:
    """Any SQL text; named parameters as :name."""
    return spark.sql(text, args=args) if args else spark.sql(text)


@dataclass
class _Call(AnalyzeResult):
    """What a call's constants and table say, handed from ``analyze`` to the rows' tasks."""

    constants: dict = field(default_factory=dict)
    price: str = "price"


def _analyzed(table: AnalyzeArgument, given: dict, defaults: dict, columns: tuple[str, ...]) -> _Call:
    if not table.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    constants = dict(defaults) | {"price": "price"}
    for name, said in given.items():
        if said is None:
            continue
        if not said.isConstantExpression:
            raise ValueError(f"{name} must be a constant")
        constants[name] = said.value
    price, fields = constants.pop("price"), table.dataType.fields
    names = [f.name for f in fields]
    for needed in ("symbol", "ts", price):
        if needed not in names:
            raise ValueError(f"the table has no column {needed}")
    for name in columns:
        if name in names:
            raise ValueError(f"the table has a column {name} already")
    for name, value in constants.items():
        if name != "k" and (value is None or int(value) != value or value < 1):
            raise ValueError(f"{name} must be a whole number of 1 or more")
    order = [OrderingColumn(c) for c in ("ts", "seq") if c in names]
    schema = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in columns)])
    return _Call(schema=schema, partitionBy=[PartitioningColumn("symbol")], orderBy=order, constants={k: float(v) if k == "k" else int(v) for k, v in constants.items()}, price=price)


class _Function:
    """A symbol's rows in order; ``make`` gives the step, ``columns`` are what it gives."""

    make = None
    columns: tuple[str, ...] = ()

    def __init__(self, call: _Call):
        self.step, self.price = type(self).make(**call.constants), call.price

    def eval(self, table: pa.RecordBatch, *constants, **named):
        """Some rows of one symbol; only the prices become Python values, all columns of the table leave as they came."""
        push, none = self.step.push, (None,) * len(self.columns)
        prices = table.column(table.schema.names.index(self.price)).to_pylist()
        values = [none if x is None else push(float(x)) for x in prices]
        made = zip(*(v if isinstance(v, tuple) else (v,) for v in values))
        yield pa.RecordBatch.from_arrays([*table.columns, *(pa.array(c, pa.float64()) for c in made)], names=[*table.schema.names, *self.columns])


class SmaTable(_Function):
    make, columns = Mean, ("sma",)

    @staticmethod
    def analyze(table, period=None, price=None) -> _Call:
        return _analyzed(table, {"period": period, "price": price}, {"period": 20}, SmaTable.columns)


class EmaTable(_Function):
    make, columns = Ema, ("ema",)

    @staticmethod
    def analyze(table, period=None, price=None) -> _Call:
        return _analyzed(table, {"period": period, "price": price}, {"period": 12}, EmaTable.columns)


class RsiTable(_Function):
    make, columns = Rsi, ("rsi",)

    @staticmethod
    def analyze(table, period=None, price=None) -> _Call:
        return _analyzed(table, {"period": period, "price": price}, {"period": 14}, RsiTable.columns)


class MacdTable(_Function):
    make, columns = Macd, ("macd", "macd_signal", "macd_histogram")

    @staticmethod
    def analyze(table, fast=None, slow=None, signal=None, price=None) -> _Call:
        return _analyzed(table, {"fast": fast, "slow": slow, "signal": signal, "price": price}, {"fast": 12, "slow": 26, "signal": 9}, MacdTable.columns)


class BollingerTable(_Function):
    make, columns = Bands, ("bb_upper", "bb_middle", "bb_lower")

    @staticmethod
    def analyze(table, period=None, k=None, price=None) -> _Call:
        return _analyzed(table, {"period": period, "k": k, "price": price}, {"period": 20, "k": 2.0}, BollingerTable.columns)


TABLE_FUNCTIONS = {"sma": SmaTable, "ema": EmaTable, "rsi": RsiTable, "macd": MacdTable, "bollinger": BollingerTable}


def register_table_functions(spark: SparkSession) -> None:
    """sma, ema, rsi, macd and bollinger for SQL.

    They take and give Arrow batches. The decorator for that, ``arrow_udtf``, still refuses handlers with ``analyze`` (SPARK-53286), though Spark
    4.1 plans and runs them, so the functions are made by the class behind it.
    """
    for name, handler in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, UserDefinedTableFunction(handler, None, evalType=PythonEvalType.SQL_ARROW_UDTF))

"""Schemas of the tables that the engine reads and writes; a ``!`` marks a column without nulls."""

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "timestamp": T.TimestampType(), "bigint": T.LongType(), "double": T.DoubleType()}


def _schema(text: str) -> T.StructType:
    fields = (f.split() for f in text.split(","))
    return T.StructType([T.StructField(name, _KINDS[kind.rstrip("!")], not kind.endswith("!")) for name, kind in fields])


QUOTE = _schema("symbol string!, ts timestamp!, seq bigint, price double!, volume bigint!, bid double, ask double, open double, high double, low double")
STOCK_QUOTES = _schema("symbol string!, timestamp timestamp!, price double!, volume bigint!, open double, high double, low double")

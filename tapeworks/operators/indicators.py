"""Technical indicators over quotes (symbol, ts, seq, price), for all symbols at once.

Moving averages and bands are window functions over one window. Recurrences that are rounded at each step (EMA, RSI, MACD) are
an ordered fold: after the windows, rows stay together and sorted by symbol, and ``mapInArrow`` reads a partition's symbols one after the
other, with a new state for each, so a symbol of any length takes the memory of one batch. Only symbol, time and price are looked
at; all other columns pass through as Arrow data. A symbol's fold is serial by nature; symbols run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expr import round_to
from ..functions.steps import Bands, Ema, Macd, Mean, Rsi

ORDER = ("ts", "seq")


def by_symbol():
    return Window.partitionBy("symbol").orderBy(*ORDER)


def _last(n: int):
    return by_symbol().rowsBetween(1 - n, 0)


def _check(*periods: int) -> None:
    if any(p < 1 for p in periods):
        raise ValueError("period must be 1 or more")


def moving_average_column(period: int, precision: int | None = None) -> Column:
    """0.0, not null, before ``period`` rows have been seen."""
    _check(period)
    mean = F.avg("price").over(_last(period))
    return F.when(F.row_number().over(by_symbol()) >= period, mean if precision is None else round_to(mean, precision)).otherwise(F.lit(0.0))


def sma(quotes: DataFrame, period: int, precision: int = 4, name: str | None = None) -> DataFrame:
    return quotes.withColumn(name or f"sma_{period}", moving_average_column(period, precision))


def moving_average(quotes: DataFrame, window: int, name: str = "moving_average") -> DataFrame:
    return quotes.withColumn(name, moving_average_column(window))


def bollinger(quotes: DataFrame, period: int = 20, k: float = 2.0, precision: int = 4) -> DataFrame:
    """bb_upper, bb_middle, bb_lower. The deviation is the population's, about the rounded middle."""
    _check(period)
    full, mean = F.row_number().over(by_symbol()) >= period, F.avg("price").over(_last(period))
    spread = F.var_pop("price").over(_last(period)) + F.pow(mean - round_to(mean, precision), F.lit(2.0))
    band = lambda s: F.when(full, round_to(round_to(mean, precision) + s * k * F.sqrt(spread), precision)).otherwise(F.lit(0.0))
    return quotes.withColumns({"bb_upper": band(1), "bb_middle": moving_average_column(period, precision), "bb_lower": band(-1)})


class _Segments:
    """Cuts sorted batches into runs of one symbol; says whether a run goes on from the batch before, and checks the order."""

    def __init__(self):
        self.last = None

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[bool, int, int]]:
        if not batch.num_rows:
            return
        symbols = batch.column("symbol").to_pylist()
        ts = batch.column("ts").cast(pa.int64()).to_numpy(zero_copy_only=False)
        seq = batch.column("seq").to_numpy(zero_copy_only=False)
        same = np.array([a == b for a, b in zip(symbols, symbols[1:])], bool)
        if (same & ((ts[1:] < ts[:-1]) | (ts[1:] == ts[:-1]) & (seq[1:] < seq[:-1]))).any():
            raise ValueError("rows of a symbol are out of order")
        goes_on = self.last is not None and self.last[0] == symbols[0]
        if goes_on and (ts[0], seq[0]) < self.last[1:]:
            raise ValueError("rows of a symbol are out of order")
        self.last = symbols[-1], ts[-1], seq[-1]
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(symbols)]
        for a, b in zip(cuts, cuts[1:]):
            yield goes_on and a == 0, a, b


def _in_order(quotes: DataFrame, arrange: bool) -> DataFrame:
    """Rows of a symbol in one partition and in order; the sort costs nothing after windows that have left them so."""
    return (quotes.repartition("symbol") if arrange else quotes).sortWithinPartitions("symbol", *ORDER)


def fold(quotes: DataFrame, make, columns: str, arrange: bool = True) -> DataFrame:
    """quotes plus ``columns`` (DDL, all double) from a step: make() gives a function of a price to a tuple of values.

    Without ``arrange`` the rows of a symbol must be in one partition already, as after a window by symbol.
    """
    schema = T.StructType([*quotes.schema.fields, *T._parse_datatype_string(columns).fields])
    arrow, n = to_arrow_schema(schema), len(quotes.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, push = _Segments(), None
        for batch in batches:
            prices, values = batch.column("price").to_numpy(zero_copy_only=False).tolist(), []
            for goes_on, a, b in segments(batch):
                push = push if goes_on else make()
                values += [push(x) for x in prices[a:b]]
            made = np.array(values, float).reshape(-1, len(schema) - n)
            kept = [batch.column(f.name).cast(f.type) for f in list(arrow)[:n]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c) for c in made.T)], schema=arrow)

    return _in_order(quotes, arrange).mapInArrow(run, schema)


def ema(quotes: DataFrame, period: int, precision: int = 4) -> DataFrame:
    _check(period)

    def make():
        step = Ema(period, precision)
        return lambda x: (step.push(x),)

    return fold(quotes, make, f"ema_{period} double")


def rsi(quotes: DataFrame, period: int = 14, precision: int = 4) -> DataFrame:
    _check(period)

    def make():
        step = Rsi(period, precision)
        return lambda x: (step.push(x),)

    return fold(quotes, make, "rsi double")


def macd(quotes: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, precision: int = 4) -> DataFrame:
    _check(fast, slow, signal)

    def make():
        return Macd(fast, slow, signal, precision).push

    return fold(quotes, make, "macd double, macd_signal double, macd_histogram double")


def signal_of(value: Column) -> Column:
    return F.when(~F.isnan(value) & (value > 70.0), "Sell").when(~F.isnan(value) & (value < 30.0), "Buy").otherwise("Hold")


def rsi_signals(quotes: DataFrame, period: int = 14, warmup: str = "buy") -> DataFrame:
    """rsi and signal. Warm-up rows have RSI 0.0 and so are ``Buy``, unless warmup is ``null``."""
    out = rsi(quotes, period)
    if warmup == "null":
        out = out.withColumn("rsi", F.when(F.row_number().over(by_symbol()) > period, F.col("rsi")))
    return out.withColumn("signal", F.when(F.col("rsi").isNotNull(), signal_of(F.col("rsi"))))


def all_indicators(quotes: DataFrame, rsi_period: int = 14, sma_short: int = 20, sma_long: int = 50, fast: int = 12, slow: int = 26, signal: int = 9, lag: int = 0) -> DataFrame:
    """Windows first, over one exchange and sort, then one fold for RSI and MACD; ``lag`` adds the line that many rows back."""
    _check(rsi_period, fast, slow, signal)
    out = bollinger(sma(sma(quotes, sma_short, name="sma_short"), sma_long, name="sma_long"))

    def make():
        index, lines, kept = Rsi(rsi_period), Macd(fast, slow, signal), []

        def push(x):
            values = (index.push(x), *lines.push(x))
            if lag:
                kept.append(values[1])
                del kept[: -lag - 1]
                values += (kept[0],)
            return values

        return push

    return fold(out, make, "rsi double, macd double, macd_signal double, macd_histogram double" + ", macd_before double" * bool(lag), arrange=False)


#: Parameters of a strategy with their defaults, and how many strategies may be run at once.
PARAMETERS = {"rsi_period": 14, "sma_short": 20, "sma_long": 50, "macd_fast": 12, "macd_slow": 26, "macd_signal": 9, "bb_period": 20, "bb_k": 2.0}
MAX_STRATEGIES = 1_000
_BY_STRATEGY = "sma_short double, sma_long double, rsi double, macd double, macd_signal double, macd_histogram double, bb_upper double, bb_middle double, bb_lower double"


def indicators_by_strategy(quotes: DataFrame, strategies: DataFrame) -> DataFrame:
    """All indicators with each strategy's own PARAMETERS: (symbol, strategy, ts, seq, price, indicators).

    strategies (id, params) has at most MAX_STRATEGIES rows, which are sent to the tasks. Quotes are shuffled once, whatever the
    number of strategies; each task runs all strategies over a symbol side by side.
    """
    rows = strategies.select("id", "params").limit(MAX_STRATEGIES + 1).collect()
    if len(rows) > MAX_STRATEGIES:
        raise ValueError(f"more than {MAX_STRATEGIES} strategies")
    chosen = [(r.id, {k: (r.params or {}).get(k, v) for k, v in PARAMETERS.items()}) for r in rows]
    for _, p in chosen:
        _check(*(p[k] for k in PARAMETERS if k != "bb_k"))
    source = quotes.select("symbol", "ts", "seq", "price")
    schema = T.StructType([source.schema["symbol"], T.StructField("strategy", T.StringType()), *source.schema.fields[1:], *T._parse_datatype_string(_BY_STRATEGY).fields])
    arrow = to_arrow_schema(schema)

    def make(p: dict):
        whole = {k: int(p[k]) for k in PARAMETERS if k != "bb_k"}
        short, long, bands = Mean(whole["sma_short"]), Mean(whole["sma_long"]), Bands(whole["bb_period"], p["bb_k"])
        index, lines = Rsi(whole["rsi_period"]), Macd(whole["macd_fast"], whole["macd_slow"], whole["macd_signal"])
        return lambda x: (short.push(x), long.push(x), index.push(x), *lines.push(x), *bands.push(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, pushes = _Segments(), [None] * len(chosen)
        for batch in batches:
            prices, runs = batch.column("price").to_numpy(zero_copy_only=False).tolist(), list(segments(batch))
            own = [batch.column(f.name).cast(f.type) if f.name != "strategy" else None for f in list(arrow)[:5]]
            for k, (name, p) in enumerate(chosen):  # a strategy's values leave before the next one's are made
                values = []
                for goes_on, a, b in runs:
                    pushes[k] = pushes[k] if goes_on else make(p)
                    values += map(pushes[k], prices[a:b])
                made = np.array(values, float).reshape(-1, 9)
                named = [pa.array([name] * batch.num_rows, pa.string()) if c is None else c for c in own]
                yield pa.RecordBatch.from_arrays([*named, *(pa.array(c) for c in made.T)], schema=arrow)

    return _in_order(source, True).mapInArrow(run, schema)


def rolling_volatility(quotes: DataFrame, k: int = 20) -> DataFrame:
    before = F.lag("price").over(by_symbol())
    rows = quotes.withColumn("ret", F.try_divide(F.col("price") - before, before))
    return rows.withColumn("rolling_volatility", F.when(F.count("ret").over(_last(k)) == k, F.stddev_samp("ret").over(_last(k)) * F.sqrt(F.lit(252.0))))

"""Filters, latest quotes, paging and top symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def by_symbols(quotes: DataFrame, symbols: list[str] | DataFrame) -> DataFrame:
    """A list is a predicate that reaches the scan; a table is a semi join."""
    if isinstance(symbols, DataFrame):
        return quotes.join(symbols.select("symbol"), "symbol", "left_semi")
    return quotes.filter(F.col("symbol").isin(*symbols))


def time_range(quotes: DataFrame, start: Column, end: Column) -> DataFrame:
    """start <= ts < end."""
    return quotes.filter((F.col("ts") >= start) & (F.col("ts") < end))


def trading_session(quotes: DataFrame) -> DataFrame:
    """UTC 14:30 to 21:00, both inclusive at minute grain; the session's time zone must be UTC."""
    h, m = F.hour("ts"), F.minute("ts")
    return quotes.filter(((h == 14) & (m >= 30)) | ((h > 14) & (h < 21)) | ((h == 21) & (m == 0)))


def latest(quotes: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """The last quote of each symbol; a requested symbol without quotes has nulls."""
    rest = [c for c in quotes.columns if c != "symbol"]
    last = quotes.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("q")).select("symbol", "q.*")
    return last if symbols is None else symbols.select("symbol").join(last, "symbol", "left")


def page(quotes: DataFrame, size: int, number: int = 0, where: Column | None = None) -> DataFrame:
    rows = quotes if where is None else quotes.filter(where)
    return rows.orderBy("ts", "seq").offset(size * number).limit(size)


def next_page(quotes: DataFrame, size: int, ts: Column, seq: Column, where: Column | None = None) -> DataFrame:
    """Keyset paging: the rows after (ts, seq), without reading over the earlier pages."""
    rows = quotes if where is None else quotes.filter(where)
    return rows.filter((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("seq") > seq))).orderBy("ts", "seq").limit(size)


def top_symbols(metrics: DataFrame, by: str, k: int) -> DataFrame:
    return metrics.orderBy(F.desc_nulls_last(by), "symbol").limit(k)

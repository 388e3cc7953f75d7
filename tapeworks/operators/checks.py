"""Data quality and enrichment of quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import is_valid_symbol, trim_whitespace
from ..sources.io import staged
from .indicators import by_symbol

MAX_PRICE = 1_000_000.0


# The messages of the checks.
def reject_reason(now: Column) -> Column:
    """Null for a valid quote; the first failing rule wins; a NaN price passes."""
    return (
        F.when(F.col("symbol") == "", "Symbol cannot be empty")
        .when(F.col("price") <= 0, "Price must be positive")
        .when(F.col("ts") > now, "Timestamp cannot be in the future")
    )


def validate(quotes: DataFrame, now: Column) -> DataFrame:
    return quotes.withColumn("reject_reason", reject_reason(now))


def price_range_reason(price: Column) -> Column:
    return F.when(price <= 0, "Price must be positive").when(~F.isnan(price) & (price > MAX_PRICE), "Price seems unreasonably high")


def check_price_range(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("range_reason", price_range_reason(F.col("price")))


def clean_symbols(quotes: DataFrame) -> DataFrame:
    """symbol without white space, and symbol_reason where it is no symbol."""
    out = quotes.withColumn("symbol", trim_whitespace(F.col("symbol")))
    return out.withColumn("symbol_reason", F.when(F.coalesce(is_valid_symbol(F.col("symbol")), F.lit(False)), F.lit(None).cast("string")).otherwise("Symbol is not valid"))


def judged(quotes: DataFrame, now: Column) -> DataFrame:
    """All checks at once: quarantine_reason is null for good rows."""
    out = check_price_range(validate(clean_symbols(quotes), now))
    return out.withColumn("quarantine_reason", F.coalesce("reject_reason", "range_reason", "symbol_reason")).drop("reject_reason", "range_reason", "symbol_reason")


def quarantine_split(quotes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined). The checks run once: rows are written in two folders, and each result reads its own."""
    rows = staged(judged(quotes, now).withColumn("bad", F.col("quarantine_reason").isNotNull()), "quarantine", "bad")
    return rows.filter("not bad").drop("bad", "quarantine_reason"), rows.filter("bad").drop("bad")


def fill_missing(quotes: DataFrame) -> DataFrame:
    """Ours: bid and ask from the last known value of the symbol; open, high and low then fall back to the price."""
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    return quotes.withColumns({"bid": last("bid"), "ask": last("ask"), **{c: F.coalesce(last(c), "price") for c in ("open", "high", "low")}})


def payload_hash(quotes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return quotes.withColumn("payload_hash", F.sha2(F.to_json(F.struct(*(columns or quotes.columns)), {"ignoreNullFields": "false"}), 256))


def remove_duplicates(quotes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return payload_hash(quotes, columns).dropDuplicates(["payload_hash"])


def reconcile(staging: DataFrame, canonical: DataFrame) -> DataFrame:
    """Row counts by symbol and day on both sides, and their difference."""
    count = lambda df, name: df.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias(name))
    both = count(staging, "staged").join(count(canonical, "kept"), ["symbol", "day"], "full")
    both = both.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("staged", "kept")})
    return both.withColumn("missing", F.col("staged") - F.col("kept"))


def map_industry(quotes: DataFrame, industries: DataFrame) -> DataFrame:
    """industries (symbol, industry) is a dimension; Spark broadcasts it if it is small enough. Unmapped: ``unknown``."""
    return quotes.join(industries.select("symbol", "industry"), "symbol", "left").withColumn("industry", F.coalesce("industry", F.lit("unknown")))


def adjusted_price(quotes: DataFrame, factors: DataFrame) -> DataFrame:
    """Ours: price times the product of the symbol's factors (symbol, ex_ts, factor) with ex_ts after the quote.

    Quotes and factors are put in one stream by symbol and time, and a window from each row's end sums the factors' logs: one
    shuffle, no range join.
    """
    marked = quotes.withColumns({"_log": F.lit(0.0), "_kind": F.lit(1)})
    events = factors.select("symbol", F.col("ex_ts").alias("ts"), F.ln("factor").alias("_log"), F.lit(0).alias("_kind"))
    both = marked.unionByName(events, allowMissingColumns=True)
    # At equal times factors count as before the quote, so that only later ones apply.
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("adjusted_price", F.col("price") * F.exp(F.sum("_log").over(w))).filter("_kind = 1").drop("_log", "_kind")

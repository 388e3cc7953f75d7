"""Mergeable sketches: distinct counts and quantiles kept by day, merged at query time over any range of days.

A sketch is a value of a few kilobytes whatever it has seen, and sketches of parts merge to the sketch of the whole, so a question
over a year reads a row for each day and group instead of the rows themselves. Days are added or rewritten by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: 2^LOG_K registers: a standard error of 0.8 % for distinct counts. QUANTILE_K: a rank error of about 0.7 %.
LOG_K, QUANTILE_K = 14, 400


def daily_sketches(rows: DataFrame, by: list[str], ts: str, distinct: str, value: str) -> DataFrame:
    """(by, day, rows, low, high, users, spread): counts, extremes and the two sketches. Null values are in the count alone."""
    return rows.groupBy(*by, F.to_date(ts).alias("day")).agg(
        F.count("*").alias("rows"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.hll_sketch_agg(F.col(distinct), F.lit(LOG_K)).alias("users"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_K)).alias("spread"),
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of any rows to those of their union, by other or fewer columns."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("spread").alias("spread"),
    )


def estimates(sketches: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(by, rows, low, high, distinct, a column for each quantile)."""
    at = lambda q: F.kll_sketch_get_quantile_double("spread", F.lit(q))
    return sketches.select(*by, "rows", "low", "high", F.hll_sketch_estimate("users").alias("distinct"), *[at(q).alias(n) for n, q in quantiles.items()])


def estimated_rank(value: Column) -> Column:
    """The share of values up to ``value``, by the sketch of the row."""
    return F.kll_sketch_get_rank_double(F.col("spread"), value)

"""Trading sessions: which days are expected, which are missing, and what the next one is.

A calendar is a table of sessions (day, session), numbered from 1 in order: a few hundred rows a year, which Spark broadcasts by
itself. Numbers turn days into positions, so a run of sessions is a run of consecutive numbers, whatever weekends and holidays
lie between, and everything is equi-joins with the calendar and windows by symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def sessions(spark: SparkSession, first: Column, last: Column, holidays: DataFrame | None = None) -> DataFrame:
    """(day, session): the weekdays from first to last that are no holidays (day). A calendar with other rules is any such table."""
    days = spark.range(1).select(F.explode(F.sequence(first.cast("date"), last.cast("date"))).alias("day")).filter(F.weekday("day") < 5)
    if holidays is not None:
        days = days.join(holidays.select(F.col("day").cast("date")), "day", "left_anti")
    # One window over the calendar, which has a row for each day.
    return days.withColumn("session", F.row_number().over(Window.orderBy("day")))


def _present(quotes: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol, day, session) of the sessions in which a symbol has quotes; quotes on other days count for nothing."""
    return quotes.select("symbol", F.to_date("ts").alias("day")).distinct().join(calendar, "day")


def session_runs(quotes: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol, first_day, last_day, sessions): the longest stretches of sessions without a missing one."""
    order = Window.partitionBy("symbol").orderBy("session")
    island = F.col("session") - F.row_number().over(order)
    runs = _present(quotes, calendar).withColumn("island", island).groupBy("symbol", "island")
    return runs.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("sessions")).drop("island")


def missing_sessions(quotes: DataFrame, calendar: DataFrame, until_end: bool = False) -> DataFrame:
    """(symbol, first_day, last_day, sessions): the gaps between a symbol's sessions, as intervals.

    With ``until_end`` also from its last one to the calendar's end.
    """
    order = Window.partitionBy("symbol").orderBy("session")
    here = _present(quotes, calendar).select("symbol", "session")
    if until_end:
        end = calendar.agg((F.max("session") + 1).alias("session"))
        here = here.union(here.select("symbol").distinct().join(end).select("symbol", "session"))
    gaps = here.withColumn("before", F.lag("session").over(order)).filter(F.col("session") - F.col("before") > 1)
    gaps = gaps.select("symbol", (F.col("before") + 1).alias("a"), (F.col("session") - 1).alias("b"))
    at = lambda c, name: calendar.select(F.col("session").alias(c), F.col("day").alias(name))
    return gaps.join(at("a", "first_day"), "a").join(at("b", "last_day"), "b").select("symbol", "first_day", "last_day", (F.col("b") - F.col("a") + 1).cast("long").alias("sessions"))


def next_session(quotes: DataFrame, calendar: DataFrame, name: str = "next_session") -> DataFrame:
    """quotes with the first session after their day; null behind the calendar's last."""
    far = calendar.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = far.select(F.explode(F.sequence(F.date_sub("a", 7), "b")).alias("day")).join(calendar, "day", "left")
    following = F.first("open", ignorenulls=True).over(Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing))
    days = days.withColumn("open", F.when(F.col("session").isNotNull(), F.col("day"))).select(F.col("day").alias("_day"), following.alias(name))
    return quotes.withColumn("_day", F.to_date("ts")).join(days, "_day", "left").drop("_day")


def off_session(quotes: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol, quotes): how many quotes of a symbol lie outside of all sessions."""
    out = quotes.withColumn("_day", F.to_date("ts")).join(calendar.select(F.col("day").alias("_day")), "_day", "left_anti")
    return out.groupBy("symbol").agg(F.count("*").alias("quotes"))

"""Streams of ticks: enrichment, subscriptions, alerts, bars, live indicators, dedup and fan-out.

Stateful functions need ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider (``use_rocksdb``). Those that
depend on the order of rows are in ``ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.expr import ieee_divide
from ..operators.indicators import by_symbol
from .ordered import HOUR, Book, Changes, Live, _run, alert_events

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def tick_changes(quotes: DataFrame) -> DataFrame:
    """Batch: change and change_percent against the symbol's last price; null for its first tick, infinite after a price of zero."""
    last = F.lag("price").over(by_symbol())
    return quotes.withColumns({"change": F.col("price") - last, "change_percent": ieee_divide(F.col("price") - last, last) * 100})


def stream_tick_changes(quotes: DataFrame, delay: str = "1 hour", width: int = HOUR) -> DataFrame:
    """The same for a stream, by event time; late rows come out marked, without change."""
    out = _run(quotes.select("symbol", "ts", "seq", "price", "volume"), Changes(width), delay)
    return out.select("symbol", "ts", "seq", "price", "volume", "change", (ieee_divide(F.col("change"), F.col("before")) * 100).alias("change_percent"), "late")


def stream_indicators(quotes: DataFrame, window: int = 20, delay: str = "1 hour", width: int = HOUR) -> DataFrame:
    """SMA(window), EMA(12), RSI(14) and MACD(12,26,9) of live quotes, by event time, by the step functions of the batch fold."""
    return _run(quotes.select("symbol", "ts", "seq", "price"), Live(window, width), delay)


def current_subscriptions(messages: DataFrame) -> DataFrame:
    """(client_id, symbols, action, at) to the pairs (client_id, symbol) whose latest action is not ``unsubscribe``."""
    each = messages.select("client_id", F.explode("symbols").alias("symbol"), F.coalesce("action", F.lit("subscribe")).alias("action"), "at")
    last = each.groupBy("client_id", "symbol").agg(F.max_by("action", F.struct("at", "action")).alias("action"))
    return last.filter("action <> 'unsubscribe'").select("client_id", "symbol")


def for_subscribers(ticks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(client_id, tick) for batch or streaming ticks and a static table of subscriptions."""
    return ticks.join(subscriptions, "symbol").select("client_id", *ticks.columns)


def subscriber_counts(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("symbol").agg(F.countDistinct("client_id").alias("subscribers"))


def fan_out(stream: DataFrame, consumers: dict, checkpoints: str) -> list:
    """One query for each consumer (name to a foreachBatch function), each with its own checkpoint: none can slow or drop another's rows."""
    return [stream.writeStream.foreachBatch(f).option("checkpointLocation", f"{checkpoints}/{name}").queryName(name).start() for name, f in consumers.items()]


def dedup_stream(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["payload_hash"])


def alert_table(alerts: DataFrame) -> DataFrame:
    """Alerts with ids symbol_epochseconds; of equal ids the last one stays."""
    named = alerts.withColumn("alert_id", F.concat_ws("_", "symbol", F.unix_timestamp("created_at").cast("string")))
    order = Window.partitionBy("alert_id").orderBy(F.desc("created_at"), F.desc("target_price"), "alert_type")
    return named.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _hit() -> Column:
    above = (F.col("alert_type") == "above") & (F.col("price") >= F.col("target_price"))
    return F.col("active") & (above | ((F.col("alert_type") == "below") & (F.col("price") <= F.col("target_price"))))


def alert_hits(ticks: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every tick that meets an active alert; batch or streaming ticks, a static table of alerts."""
    return ticks.join(alerts.select("alert_id", "symbol", "target_price", "alert_type", "active"), "symbol").filter(_hit()).select("alert_id", *ticks.columns)


def first_hits(ticks: DataFrame, alerts: DataFrame) -> DataFrame:
    """Batch: each active alert's first hit, (alert_id, symbol, ts, price), without comparing ticks with alerts.

    An alert above is first met by a tick that is higher than all before it. In falling order of price these records and the targets
    form one line, where an alert's first hit is the last record before it; below likewise, in rising order.
    """
    out = None
    for side, top, order in (("above", F.max, F.desc), ("below", F.min, F.asc)):
        before = top("price").over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))
        further = F.col("price") > F.col("_before") if side == "above" else F.col("price") < F.col("_before")
        records = ticks.select("symbol", "ts", "seq", "price").withColumn("_before", before).filter(F.col("_before").isNull() | further)
        records = records.select("symbol", F.col("price").alias("value"), F.lit(0).alias("turn"), F.struct("ts", "seq", "price").alias("tick"))
        open_ = alerts.filter(F.col("active") & (F.col("alert_type") == side) & F.col("target_price").isNotNull())
        line = records.unionByName(open_.select("symbol", F.col("target_price").alias("value"), F.lit(1).alias("turn"), "alert_id"), allowMissingColumns=True)
        near = Window.partitionBy("symbol").orderBy(order("value"), "turn").rowsBetween(Window.unboundedPreceding, 0)
        met = line.withColumn("hit", F.last("tick", ignorenulls=True).over(near)).filter("turn = 1 and hit is not null")
        met = met.select("alert_id", "symbol", "hit.ts", "hit.price")
        out = met if out is None else out.union(met)
    return out


def fire_once(ticks: DataFrame, alerts: DataFrame, delay: str = "1 hour", width: int = HOUR) -> DataFrame:
    """Streaming: alerts (symbol, ts, alert_id, action, target_price) are a stream too; each fires at its first hit while it is set.

    (symbol, ts, alert_id, price, late). An action is ``above``, ``below`` or ``cancel``; setting an alert anew replaces it.
    """
    return _run(alert_events(ticks, alerts), Book(width), delay)


def stream_bars(quotes: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    at = F.struct("ts", "seq")
    out = quotes.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def closing_row(quotes: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """One row without a symbol behind all others: appended to a bounded stream, its watermark closes every bar; its own stays open."""
    end = quotes.agg(F.max("ts").alias("end")).select((F.col("end") + F.expr(f"INTERVAL {width}") + F.expr(f"INTERVAL {delay}") + F.expr(f"INTERVAL {width}")).alias("ts"))
    blank = {"string": F.lit(""), "timestamp": F.col("ts")}
    return end.filter("ts is not null").select(*[blank.get(f.dataType.simpleString(), F.lit(0).cast(f.dataType)).alias(f.name) for f in quotes.schema.fields])

"""Indicators kept up to date with a lake of quotes: only what a change can reach is computed again.

A lake (``sources.io.write_lake``) has its quotes by exchange and day. ``refresh`` compares it with what the last refresh saw:

1. by day, from the files' names, sizes and times alone: days without a new, changed or missing file are not read;
2. in the days that differ, by symbol, from the count and the summed hashes of its quotes: a rewritten day with the same quotes
   changes nothing;
3. by symbol, from the hashes of its adjustment factors, which change all prices before them.

That gives each changed symbol its first changed day. Every indicator is a fold over the symbol's quotes, so earlier days stay, and
the fold goes on from the state that was saved with the last quote of the day before: only the changed symbols' quotes from their
first changed day on are read. With the state, a day's last row of a symbol keeps the count and the hash of step 2.

Results are in partitions of day and bucket of symbols. A refresh writes the partitions that it touches as a new run, with the rows
of the bucket's other symbols copied, and then a manifest that says which run each partition is read from. The manifest is written
last: a refresh that fails changes nothing, and readers never see half of it. ``vacuum`` deletes what no manifest lists.

Defined results: those of the batch indicators over the whole lake, row by row. A symbol that is gone from the lake is gone from the
results. Of quotes equal in time and number the order is free, as in the batch. A null symbol is a symbol like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.steps import Ema, Macd, Mean, Rsi
from .checks import adjusted_price

BUCKETS = 64
#: Quotes of a task of the fold, on average; buckets with more are dealt to several tasks by symbol.
TASK_ROWS = 250_000
_ROW_HASH_BITS = 36  # sums of these stay below 2^63 for 10^8 quotes of a symbol and day
_VALUES = ("sma", "ema", "rsi", "macd", "macd_signal", "macd_histogram")
_ROW = "symbol string, ts timestamp, seq bigint, price double, " + ", ".join(f"{v} double" for v in _VALUES) + ", state array<array<double>>, n bigint, mark bigint, dt date, bucket int"
_FIRST = "0001-01-01"


def _steps() -> list:
    return [Mean(20), Ema(12), Rsi(14), Macd()]


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by symbol and time to their values. A row with a saved state comes first and sets it; where ``ends`` holds the state goes out."""
    symbol, steps, n, mark = object(), [], 0, 0
    for batch in batches:
        out, at = [], []
        columns = (batch.column(c).to_pylist() for c in ("symbol", "saved", "price", "hash", "ends"))
        for k, (name, saved, price, h, ends) in enumerate(zip(*columns)):
            if name != symbol:
                symbol, steps, n, mark = name, _steps(), 0, 0
            if saved is not None:
                for step, kept in zip(steps, saved):
                    step.load(kept)
                continue
            mean, ema, rsi, macd = (s.push(price) for s in steps)
            n, mark = n + 1, mark + h
            at.append(k)
            out.append((mean, ema, rsi, *macd, [list(s.state()) for s in steps] if ends else None, n if ends else None, mark if ends else None))
            if ends:
                n = mark = 0
        kept = batch.take(pa.array(at, pa.int64()))
        made = list(zip(*out)) or [[]] * 9
        arrays = {f.name: kept.column(f.name).cast(f.type) for f in schema if f.name in kept.schema.names}
        arrays |= {name: pa.array(c, schema.field(name).type) for name, c in zip((*_VALUES, "state", "n", "mark"), made)}
        yield pa.RecordBatch.from_arrays([arrays[f.name] for f in schema], schema=schema)


def _slot(symbol: str, slots: int) -> Column:
    """Of a multiple of the buckets; a slot's symbols are in one bucket, the slot's number modulo the buckets."""
    return F.pmod(F.xxhash64(symbol), F.lit(slots)).cast("int")


def _folded(quotes: DataFrame, saved: DataFrame | None, slots: int) -> DataFrame:
    """quotes (symbol, ts, seq, price, dt, bucket, hash), and (symbol, saved) for symbols that go on from a state, to rows of ``_ROW``.

    One exchange, by slot, so that a task writes one bucket's partitions; the window that finds a day's last row leaves each symbol
    together and in order for the fold.
    """
    rows = quotes.withColumn("saved", F.lit(None).cast("array<array<double>>"))
    rows = rows if saved is None else rows.unionByName(saved, allowMissingColumns=True)
    order = Window.partitionBy("slot", "symbol").orderBy("ts", "seq")  # a saved state has no time, so it comes first
    following = F.lead("dt").over(order)
    rows = rows.withColumn("slot", _slot("symbol", slots)).repartitionById(slots, "slot").withColumn("ends", following.isNull() | (following != F.col("dt")))
    schema = to_arrow_schema(T._parse_datatype_string(_ROW))
    return rows.sortWithinPartitions("slot", "symbol", "ts", "seq").mapInArrow(lambda it: _fold(it, schema), _ROW)


class Refreshed:
    """What a refresh did: the days whose files differed, and how many symbols, quotes and partitions were computed again."""

    def __init__(self, days: int = 0, symbols: int = 0, quotes: int = 0, partitions: int = 0):
        self.days, self.symbols, self.quotes, self.partitions = days, symbols, quotes, partitions

    def __repr__(self) -> str:
        return f"Refreshed(days={self.days}, symbols={self.symbols}, quotes={self.quotes}, partitions={self.partitions})"


_LIVE, _FILES, _FACTORS = "dt date, bucket int, run string", "file string, bytes long, changed timestamp, dt date", "symbol string, factors long"


def _version(spark: SparkSession, out: str) -> int:
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    folder = path_of(f"{out}/live")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0
    return max((int(s.getPath().getName()) for s in files.listStatus(folder) if files.exists(path_of(s.getPath(), "_SUCCESS"))), default=0)


def _part(spark: SparkSession, out: str, name: str, version: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/{name}/{version}") if version else spark.createDataFrame([], schema)


def _listing(spark: SparkSession, lake: str) -> DataFrame:
    """The lake's files; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(lake)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"), F.col("dt").cast("date").alias("dt"))


def _live_rows(spark: SparkSession, out: str, version: int) -> DataFrame:
    rows = spark.read.schema(_ROW + ", run string").parquet(f"{out}/rows") if version else spark.createDataFrame([], _ROW + ", run string")
    return rows.join(_part(spark, out, "live", version, _LIVE), ["run", "dt", "bucket"], "left_semi")


def results(spark: SparkSession, out: str) -> DataFrame:
    """(symbol, ts, seq, price, sma, ema, rsi, macd, macd_signal, macd_histogram, dt) as of the last refresh."""
    return _live_rows(spark, out, _version(spark, out)).select("symbol", "ts", "seq", "price", *_VALUES, "dt")


def refresh(spark: SparkSession, lake: str, out: str, factors: DataFrame | None = None, buckets: int = BUCKETS) -> Refreshed:
    """Bring ``results`` up to the lake, and to ``factors`` (symbol, ex_ts, factor) if prices are to be adjusted.

    ``buckets`` is how many partitions a day has, and must stay the same over the life of ``out``. It does not bound the tasks.
    """
    version = _version(spark, out)
    # Written first, as what this refresh saw: a file that comes later is found by the next one.
    _listing(spark, lake).write.mode("overwrite").parquet(f"{out}/files/{version + 1}")
    now, before = _part(spark, out, "files", version + 1, _FILES), _part(spark, out, "files", version, _FILES)
    keys = ["file", "bytes", "changed", "dt"]
    differ = now.join(before, keys, "left_anti").union(before.join(now, keys, "left_anti"))
    days = [r.dt for r in differ.select("dt").distinct().collect()]

    per_symbol = (factors if factors is not None else spark.createDataFrame([], "symbol string, ex_ts timestamp, factor double")).groupBy("symbol").agg(F.sum(F.pmod(F.xxhash64("ex_ts", "factor"), F.lit(1 << _ROW_HASH_BITS))).alias("factors"))
    per_symbol.write.mode("overwrite").parquet(f"{out}/factors/{version + 1}")
    new, old = _part(spark, out, "factors", version + 1, _FACTORS), _part(spark, out, "factors", version, _FACTORS)
    refactored = new.join(old, ["symbol", "factors"], "left_anti").union(old.join(new, ["symbol", "factors"], "left_anti")).select("symbol").distinct()
    if version and not days and refactored.isEmpty():
        return Refreshed()

    quotes = spark.read.parquet(lake).withColumn("dt", F.col("dt").cast("date"))
    quotes = quotes.withColumn("bucket", _slot("symbol", buckets))
    row_hash = F.pmod(F.xxhash64("symbol", "ts", "seq", "price"), F.lit(1 << _ROW_HASH_BITS))
    live = _live_rows(spark, out, version)
    of_days = lambda rows: rows.filter(F.col("dt").isin(days)) if days else rows.limit(0)
    marked = of_days(quotes).groupBy("symbol", "dt").agg(F.count("*").alias("n"), F.sum(row_hash).alias("mark"))
    known = of_days(live).filter("n is not null").select("symbol", "dt", F.col("n").alias("known_n"), F.col("mark").alias("known_mark"))
    same = F.expr("symbol <=> known_symbol and dt = known_dt")
    both = marked.join(known.withColumnsRenamed({"symbol": "known_symbol", "dt": "known_dt"}), same, "full")
    changed = both.filter(~(F.col("n").eqNullSafe(F.col("known_n")) & F.col("mark").eqNullSafe(F.col("known_mark"))))
    changed = changed.select(F.when(F.col("dt").isNotNull(), F.col("symbol")).otherwise(F.col("known_symbol")).alias("symbol"), F.coalesce("dt", "known_dt").alias("dt"))
    since = changed.union(refactored.select("symbol", F.lit(_FIRST).cast("date").alias("dt"))).groupBy("symbol").agg(F.min("dt").alias("since"))
    run = uuid.uuid4().hex
    since.write.parquet(f"{out}/since/{run}")
    since = spark.read.schema("symbol string, since date").parquet(f"{out}/since/{run}")
    symbols, first = since.agg(F.count("*"), F.min("since").cast("string")).first()

    rows_path, count = f"{out}/rows/run={run}", 0
    touched = spark.createDataFrame([], "dt date, bucket int")
    if symbols:
        of = since.withColumnsRenamed({"symbol": "of"})
        later = F.col("symbol").eqNullSafe(F.col("of")) & (F.col("dt") >= F.col("since"))
        # The hash is of the quotes as they are in the lake, so it is taken before prices are adjusted.
        reached = quotes.filter(F.col("dt") >= F.lit(first).cast("date"))
        slots = buckets * max(1, -(-reached.count() // (buckets * TASK_ROWS)))  # counted in the files' footers
        read = reached.join(of, later, "left_semi").withColumn("hash", row_hash)
        if factors is not None:
            read = adjusted_price(read, factors).withColumn("price", F.col("adjusted_price"))
        read = read.select("symbol", "ts", "seq", "price", "dt", "bucket", "hash")
        earlier = F.col("symbol").eqNullSafe(F.col("of")) & (F.col("dt") < F.col("since"))
        saved = live.filter("state is not null").join(of, earlier).groupBy("bucket", "symbol").agg(F.max_by("state", "dt").alias("saved"))
        _folded(read, saved, slots).write.partitionBy("dt", "bucket").parquet(rows_path)

        fresh = spark.read.schema(_ROW).parquet(rows_path)
        count = fresh.count()
        gone = live.filter("n is not null").join(of, later, "left_semi").select("dt", "bucket")
        touched = gone.union(fresh.select("dt", "bucket")).distinct()
        touched.write.parquet(f"{out}/touched/{run}")
        touched = spark.read.schema("dt date, bucket int").parquet(f"{out}/touched/{run}")
        stay = live.join(touched, ["dt", "bucket"], "left_semi").join(of, later, "left_anti")
        stay.drop("run").write.mode("append").partitionBy("dt", "bucket").parquet(rows_path)

    filled = spark.read.schema(_ROW).parquet(rows_path).select("dt", "bucket").distinct() if symbols else touched
    kept = _part(spark, out, "live", version, _LIVE).join(touched, ["dt", "bucket"], "left_anti").select("dt", "bucket", "run")
    kept.union(filled.select("dt", "bucket", F.lit(run))).write.mode("overwrite").parquet(f"{out}/live/{version + 1}")
    return Refreshed(len(days), symbols, count, touched.count())


def vacuum(spark: SparkSession, out: str) -> None:
    """Delete runs that the newest manifest does not read, and the tables of older versions."""
    version, path_of = _version(spark, out), spark._jvm.org.apache.hadoop.fs.Path
    if not version:
        return
    runs = {r.run for r in _part(spark, out, "live", version, _LIVE).select("run").distinct().collect()}
    files = path_of(out).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in ("rows", "since", "touched", "live", "files", "factors"):
        if not files.exists(path_of(f"{out}/{folder}")):
            continue
        for s in files.listStatus(path_of(f"{out}/{folder}")):
            name = s.getPath().getName()
            spent = name.removeprefix("run=") not in runs if folder == "rows" else folder in ("since", "touched") or int(name) != version
            if spent and not name.startswith("_"):
                files.delete(s.getPath(), True)

"""A stored inverted index over documents: written once, extended by segments, merged, and read by the queries' terms only.

Layout under an index folder:

    segments/<id>/blocks/range=<r>   rows (term, slot, n, top, base, ids, counts), sorted by term and slot
    segments/<id>/docs               rows (doc_id, snippet)
    manifests/<version>              a row for each live segment: id, documents, slots, and its ranges of terms

A document's slot is a hash of its id, so the blocks of all terms cut the documents in the same way. A block is a term's
documents of one slot: their ids as distances from the least (``base``) and the term's counts in them, with the number of documents
(``n``) and the largest count (``top``), which are columns of their own. A slot has about SLOT documents, so no block grows with
the collection, whatever its term. Blocks are dealt by range of (term, slot): a frequent term has several tasks and files, and the
manifest says which terms a range has.

A search reads the ranges that have its terms, first without ids and counts: the document frequencies are sums of ``n``, and
sum(top * idf) over a query's terms bounds the score of all documents of a slot. The PROBE best slots of each query are scored;
their k-th score is a floor for the result, and only slots whose bound reaches it are scored at all. Texts are never read, and
of the documents only the snippets of what is returned.

A segment becomes visible with the manifest that lists it, which is written last, so a failed write changes nothing; readers go on
with the manifest they began with. Not for several writers at once.

Defined results: terms are lower-case runs of letters and digits. A null text has no terms; a null id is no document. Rows of
one segment with equal ids are one document; segments are expected to have different ids. A query without a term of the index has no
rows; ties of scores, rounded to four places, go to the smaller id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.expr import safe_truncate

#: Documents of a slot, about; the slots that give a query its floor; ranges of a segment at most.
SLOT, PROBE, RANGES = 4096, 2, 1024
SEPARATORS = r"[^\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _slot(doc_id: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int")


def _postings(docs: DataFrame, slots: int) -> DataFrame:
    """(slot, doc_id, term, tf). Texts move once, evenly by document: a slot is too large a share of a small segment for one task."""
    rows = docs.filter("doc_id is not null").select("doc_id", "text").withColumn("slot", _slot(F.col("doc_id"), slots)).repartition("doc_id")
    return rows.select("slot", "doc_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("slot", "doc_id", "term").agg(F.count("*").cast("int").alias("tf"))


def _blocks(postings: DataFrame) -> DataFrame:
    held = postings.groupBy("slot", "term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
    held = held.withColumn("base", F.get("p", F.lit(0)).doc_id)
    ids = F.transform("p", lambda e: e.doc_id - F.col("base"))
    return held.select("term", "slot", F.size("p").cast("long").alias("n"), F.array_max("p.tf").alias("top"), "base", ids.alias("ids"), F.col("p.tf").alias("counts"))


def _manifest(spark: SparkSession, path: str) -> tuple[int, list]:
    """The newest version (0 without one) and its rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0, []
    done = [int(s.getPath().getName()) for s in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    version = max(done, default=0)
    return version, spark.read.parquet(f"{path}/manifests/{version}").collect() if version else []


_SCHEMAS = {"blocks": "term string, slot int, n long, top int, base long, ids array<long>, counts array<int>, range int", "docs": "doc_id long, snippet string"}
_SEGMENT = "segment string, documents long, slots int, ranges array<struct<range: int, low: string, high: string>>"


def _commit(spark: SparkSession, path: str, version: int, rows: list) -> None:
    spark.createDataFrame([tuple(r) for r in rows], _SEGMENT).coalesce(1).write.parquet(f"{path}/manifests/{version + 1}")


def _write(spark: SparkSession, path: str, blocks: DataFrame, docs: DataFrame, documents: int, slots: int) -> tuple:
    """Write a segment's files; its row for the manifest."""
    segment = uuid.uuid4().hex
    base = f"{path}/segments/{segment}"
    parts = max(1, min(RANGES, slots, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Ranges are found by a pass over all rows, which must not make the blocks a second time.
    blocks.write.parquet(f"{base}/made")
    dealt = spark.read.schema(blocks.schema).parquet(f"{base}/made").repartitionByRange(parts, "term", "slot").withColumn("range", F.spark_partition_id())
    dealt.sortWithinPartitions("range", "term", "slot").write.partitionBy("range").parquet(f"{base}/blocks")
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/made")
    made.getFileSystem(spark._jsc.hadoopConfiguration()).delete(made, True)
    docs.write.parquet(f"{base}/docs")
    if not documents:
        return segment, 0, slots, []
    found = spark.read.schema(_SCHEMAS["blocks"]).parquet(f"{base}/blocks").groupBy("range").agg(F.min("term").alias("low"), F.max("term").alias("high")).orderBy("range").collect()
    return segment, documents, slots, [(r.range, r.low, r.high) for r in found]


def add_segment(docs: DataFrame, path: str, snippet: int = 60) -> None:
    """Index docs (doc_id, text) as a new segment; the first one makes the index."""
    spark = docs.sparkSession
    version, rows = _manifest(spark, path)
    docs = docs.filter("doc_id is not null")
    documents = docs.select("doc_id").distinct().count()
    slots = max(1, -(-documents // SLOT))
    short = docs.select("doc_id", safe_truncate(F.col("text"), snippet).alias("snippet")).groupBy("doc_id").agg(F.min("snippet").alias("snippet"))
    # Dealt by block before they are collected: partial lists of mostly single postings cost more than the rows.
    made = _write(spark, path, _blocks(_postings(docs, slots).repartition("slot", "term")), short, documents, slots)
    _commit(spark, path, version, [*rows, made])


def _read(spark: SparkSession, path: str, segment, what: str, ranges: list[int] | None = None) -> DataFrame:
    if not segment.documents:
        return spark.createDataFrame([], _SCHEMAS[what]).withColumn("segment", F.lit(segment.segment))
    rows = spark.read.schema(_SCHEMAS[what]).parquet(f"{path}/segments/{segment.segment}/{what}")
    rows = rows if ranges is None else rows.filter(F.col("range").isin(ranges))
    return rows.withColumn("segment", F.lit(segment.segment))


def _all(spark: SparkSession, path: str, segments: list, what: str, ranges: dict | None = None) -> DataFrame:
    out = None
    for s in segments:
        rows = _read(spark, path, s, what, None if ranges is None else ranges.get(s.segment, []))
        out = rows if out is None else out.union(rows)
    return out


def merge_segments(spark: SparkSession, path: str) -> None:
    """All segments as one, with slots of the usual size again. No text is read; the old files stay for readers until ``vacuum``."""
    version, segments = _manifest(spark, path)
    if len(segments) < 2:
        return
    docs = _all(spark, path, segments, "docs").groupBy("doc_id").agg(F.min("snippet").alias("snippet"))
    documents = docs.count()
    slots = max(1, -(-documents // SLOT))
    # One exchange, by block, does for the sums and for the new blocks.
    each = decoded(_all(spark, path, segments, "blocks"), "term").withColumn("slot", _slot(F.col("doc_id"), slots)).repartition("slot", "term")
    postings = each.groupBy("slot", "term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"))
    _commit(spark, path, version, [_write(spark, path, _blocks(postings), docs, documents, slots)])


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the segments that the newest manifest does not list, and older manifests; how many segments went."""
    version, segments = _manifest(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    live, gone = {s.segment for s in segments}, 0
    for s in files.listStatus(path_of(f"{path}/segments")) if segments else []:
        if s.getPath().getName() not in live:
            gone += int(files.delete(s.getPath(), True))
    for s in files.listStatus(path_of(f"{path}/manifests")) if segments else []:
        if int(s.getPath().getName()) < version:
            files.delete(s.getPath(), True)
    return gone


def decoded(blocks: DataFrame, *keep: str) -> DataFrame:
    """Blocks to a row for each posting: the columns of ``keep``, doc_id and tf."""
    each = blocks.select(*keep, "base", F.explode(F.arrays_zip("ids", "counts")).alias("p"))
    return each.select(*keep, (F.col("base") + F.col("p.ids")).alias("doc_id"), F.col("p.counts").alias("tf"))


def term_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(term, documents, occurrences, most): what the index knows of each term; block counts alone give all but occurrences."""
    _, segments = _manifest(spark, path)
    blocks = _all(spark, path, segments, "blocks")
    said = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    return blocks.groupBy("term").agg(F.sum("n").alias("documents"), F.sum(said).alias("occurrences"), F.max("top").cast("long").alias("most"))


def wanted_ranges(segments: list, wanted: DataFrame) -> dict[str, list[int]]:
    """By segment the ranges that may have a wanted term. Terms stay in Spark; at most RANGES numbers a segment come back."""
    rows = [(s.segment, *r) for s in segments for r in s.ranges or []]
    ranges = wanted.sparkSession.createDataFrame(rows, "segment string, range int, low string, high string")
    found: dict[str, list[int]] = {}
    for r in ranges.join(wanted.select("term").distinct(), F.col("term").between(F.col("low"), F.col("high")), "left_semi").select("segment", "range").collect():
        found.setdefault(r.segment, []).append(r.range)
    return found


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """queries (query_id, query) to the k documents of largest tf-idf sum: query_id, rank, doc_id, score, snippet."""
    _, segments = _manifest(spark, path)
    segments = [s for s in segments if s.documents]
    if not segments:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, doc_id long, score double, snippet string")
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms_of(F.col("query")))).alias("term"))
    ranges, total = wanted_ranges(segments, wanted), float(sum(s.documents for s in segments))

    # Heads of blocks only: frequencies, and a bound for each query and slot.
    heads = _all(spark, path, segments, "blocks", ranges).select("segment", "slot", "term", "n", "top")
    heads = heads.join(wanted.select("term").distinct(), "term", "left_semi")
    idf = heads.groupBy("term").agg(F.ln(F.lit(total) / F.sum("n")).alias("idf"))
    weights = wanted.join(idf, "term")
    bounds = heads.join(weights, "term").groupBy("query_id", "segment", "slot").agg(F.sum(F.col("top") * F.col("idf")).alias("bound"))

    def scores(slots: DataFrame) -> DataFrame:
        """Of all documents of these (query_id, segment, slot)."""
        blocks = _all(spark, path, segments, "blocks", ranges).join(weights, "term").join(slots, ["query_id", "segment", "slot"])
        return decoded(blocks, "query_id", "segment", "idf").groupBy("query_id", "segment", "doc_id").agg(F.round(F.sum(F.col("tf") * F.col("idf")), 4).alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "slot")
    probed = bounds.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PROBE).select("query_id", "segment", "slot")
    floor = ranked(scores(probed)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    open_ = bounds.join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") + 0.0001 >= F.col("floor"))).select("query_id", "segment", "slot")
    top = ranked(scores(open_))
    return _all(spark, path, segments, "docs").join(top, ["segment", "doc_id"]).select("query_id", "rank", "doc_id", "score", "snippet")

"""Line dedup: lines that many documents share are kept only in the document with the largest id.

A sharded minimal perfect hash over the hashes of the lines that two or more documents hold indexes arrays of 64-bit
fingerprints, document counts and last ids; documents probe those arrays, so lines are never joined with lines and only
16-byte hashes are shuffled:

1. every document emits the distinct 128-bit hashes of its keys (one small table in the shared folder);
2. they are counted (partial sums first, so a line in a third of all documents is no hot key);
3. per shard of the hash space one row with the perfect hash and its arrays is built;
4. hashes travel to their shard, are looked up there, and return to their document as the list of keys to drop. Keys with
   more than 1/(4 * partitions) of all probes, at most 4 * partitions of them, are looked up before the exchange instead;
5. documents are rewritten.

Defined results: a null or empty text is one empty line. A row is a document: rows with equal ids count one by one, and
if they hold the largest id, all of them keep the line. A null id counts as smaller than any other. Keys shorter than
``min_chars`` code points are never dropped. Other columns pass through unchanged, whatever their names; columns called
``_tw_n_lines`` or ``_tw_n_dropped`` make place for the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ROW, WHITE, from_row, id_key, shuffle_partitions, with_row, written
from .mph import PerfectHash

_STRIP = WHITE.encode()
#: Keys per shard at most, on average: 24 bytes each in the task that looks up.
SHARD_KEYS = 200_000
_SHARD = "_tw_shard int, _tw_probe int, _tw_h1 long, _tw_h2 long, _tw_id long, sizes array<long>, words binary, rest binary, fps binary, counts binary, last binary"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, A-Z lower-cased line, or None if it has fewer than min_chars code points."""
    key = line.strip(_STRIP)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()


def _hashes(keys) -> np.ndarray:
    """Rows (h1, h2), unsigned."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def _emit(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, found = batch.column(0).to_numpy(zero_copy_only=False), [], []
        for text in batch.column(1):
            keys = {k for line in (text.as_py() or b"").split(b"\n") if (k := line_key(line, min_chars)) is not None}
            counts.append(len(keys))
            found.append(_hashes(keys))
        h = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(h[:, 0].astype(np.int64)), pa.array(h[:, 1].astype(np.int64))], ["_tw_id", "_tw_h1", "_tw_h2"])


def _index(pdf):
    """One shard's keys to one row of arrays, in perfect hash order."""
    import pandas as pd

    h1, h2 = pdf["_tw_h1"].to_numpy().astype(np.uint64), pdf["_tw_h2"].to_numpy().astype(np.uint64)
    ph = PerfectHash.build(h1, h2)
    order = np.argsort(ph.index(h1, h2))
    row = {"_tw_shard": pdf["_tw_shard"].iloc[0], "_tw_probe": 0, "_tw_h1": None, "_tw_h2": None, "_tw_id": None, **ph.dump()}
    row |= {"fps": h2[order].tobytes(), "counts": np.minimum(pdf["n"].to_numpy(), 2**32 - 1).astype(np.uint32)[order].tobytes(), "last": pdf["last"].to_numpy().astype(np.int64)[order].tobytes()}
    return pd.DataFrame([row])


class _Arrays:
    def __init__(self, row: dict):
        self.ph = PerfectHash.load(row["sizes"], row["words"], row["rest"])
        self.fps, self.counts, self.last = np.frombuffer(row["fps"], np.uint64), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["last"], np.int64)

    def drops(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which probes are of a line that min_docs documents hold and whose last holder is another one."""
        at = self.ph.index(h1, h2)
        known = at >= 0
        known[known] = self.fps[at[known]] == h2[known]
        known[known] = (self.counts[at[known]] >= min_docs) & (self.last[at[known]] != ids[known])
        return known


def _probe(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows by shard, a shard's arrays (if it has any) before its probes; one shard's arrays are held at a time."""
    shard, arrays = None, None
    for batch in batches:
        shards, probe = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        h1, h2, ids = (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(shards) != 0) | (probe[1:] == 0) | (probe[:-1] == 0)])) if len(shards) else []
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(shards)]):
            if probe[a] == 0:
                row = batch.slice(a, 1).to_pylist()[0]
                shard, arrays = shards[a], _Arrays(row)
            elif arrays is not None and shards[a] == shard:
                out.append(np.arange(a, b)[arrays.drops(h1[a:b].astype(np.uint64), h2[a:b].astype(np.uint64), ids[a:b], min_docs)])
        at = np.concatenate(out) if out else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(h1[at])], ["_tw_id", "_tw_h1"])


def _rewrite(batches: Iterator[pa.RecordBatch], min_chars: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, drop in zip(batch.column("_tw_text"), batch.column("_tw_drop")):
            lines = (text.as_py() or b"").split(b"\n")
            n_lines.append(len(lines))
            if drop.is_valid:
                gone = set(drop.as_py())
                stay = [line for line in lines if (k := line_key(line, min_chars)) is None or int(_hashes([k])[0, 0].astype(np.int64)) not in gone]
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            else:
                n_dropped.append(0)
                kept.append(text.as_py() or b"")
        columns = [batch.column(ROW).cast(schema.field(0).type), pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def shared_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Which lines each document loses: (_tw_id, _tw_drop array<long> of the first halves of their hashes)."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    source = docs.select(id_key(doc_id).alias("_tw_id"), F.col(text).cast("string").cast("binary").alias("_tw_text"))
    probes = written(source.mapInArrow(lambda it: _emit(it, min_chars), "_tw_id long, _tw_h1 long, _tw_h2 long"), "line-hashes")
    counted = written(probes.groupBy("_tw_h1", "_tw_h2").agg(F.count("*").alias("n"), F.max("_tw_id").alias("last")).filter("n >= 2"), "line-counts")

    n_probes, n_keys = probes.count(), counted.count()
    shards = max(8 * parts, -(-n_keys // SHARD_KEYS))
    shard = F.pmod(F.xxhash64("_tw_h1"), F.lit(shards)).cast("int").alias("_tw_shard")
    index = counted.select(shard, "*").groupBy("_tw_shard").applyInPandas(_index, _SHARD)

    # At most 4 * parts keys hold more than 1 / (4 * parts) of the probes: a proven bound for this broadcast.
    hot = counted.filter((F.col("n") >= min_docs) & (F.col("n") > n_probes / (4 * parts))).select("_tw_h1", "_tw_h2", F.col("last").alias("_tw_last"))
    met = probes.join(F.broadcast(hot), ["_tw_h1", "_tw_h2"], "left")
    early = met.filter("_tw_last is not null and _tw_last <> _tw_id").select("_tw_id", "_tw_h1")
    cold = met.filter("_tw_last is null").select(shard, F.lit(1).alias("_tw_probe"), "_tw_h1", "_tw_h2", "_tw_id")
    late = (
        index.unionByName(cold, allowMissingColumns=True)
        .repartition(parts, "_tw_shard")
        .sortWithinPartitions("_tw_shard", "_tw_probe")
        .mapInArrow(lambda it: _probe(it, min_docs), "_tw_id long, _tw_h1 long")
    )
    return early.unionByName(late).groupBy("_tw_id").agg(F.collect_set("_tw_h1").alias("_tw_drop"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with ``text`` cleaned, plus ``_tw_n_lines`` (before) and ``_tw_n_dropped``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    drops = shared_lines(docs, text, doc_id, min_docs, min_chars)
    rows = with_row(docs, (text,), _tw_id=id_key(doc_id), _tw_text=F.col(text).cast("string").cast("binary")).join(drops, "_tw_id", "left")
    fields = [T.StructField("_tw_kept", T.BinaryType()), T.StructField("_tw_n_lines", T.LongType()), T.StructField("_tw_n_dropped", T.LongType())]
    schema = T.StructType([rows.schema[ROW], *fields])
    arrow = to_arrow_schema(schema)
    out = rows.select(ROW, "_tw_text", "_tw_drop").mapInArrow(lambda it: _rewrite(it, min_chars, arrow), schema)
    return from_row(out, docs.columns, **{text: F.col("_tw_kept").cast("string"), "_tw_n_lines": "_tw_n_lines", "_tw_n_dropped": "_tw_n_dropped"})


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_tw_n_lines").alias("n_lines"), F.col("_tw_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_KEY = r"translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op1_line_dedup": rf"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
      FROM documents),
    keyed AS (SELECT *, {_KEY} AS key FROM lines),
    shared AS (
      SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (
      SELECT l.doc_id, l.line, l.k, s.key IS NOT NULL AND l.doc_id <> s.last AS gone FROM keyed l LEFT JOIN shared s ON l.key = s.key)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""
}

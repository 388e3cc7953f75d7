"""Exact top-k search by inner product, with elimination by a table of distances to pivots.

Vectors become integers, floor(SCALE * x) for each component. Every vector's distances to PIVOTS pivots are computed once and
stored with it. For a query q and a candidate x, each pivot p gives |d(q, p) - d(x, p)| <= d(q, x), so the largest such difference
L bounds the score: 2 q.x = |q|^2 + |x|^2 - d(q, x)^2 <= |q|^2 + |x|^2 - L^2. Candidates are visited in the order of their bound and
visiting stops when the next bound is under the k-th score so far, so the result is exact, ties included.

Spark. Equal vectors are one entry with their k + 1 smallest ids, so a vector with a third of all rows costs nothing. Entries
are dealt by range of (nearest pivot, distance) to groups of about GROUP, queries likewise to groups of about QUERIES. Boxes of pivot
distances drop whole pairs of groups; each pair that is left is one cogroup of bounded size, whatever the number of rows. Inside
it blocks of BLOCK entries are visited by their box's bound, then entries by their own. Only k + 1 rows for each query leave a pair, and
windows with a limit merge them. Neither side is ever collected: pivots come from the SAMPLE entries of least hash, which also
give every query its first threshold; their bound is SAMPLE rows and SAMPLE_BYTES.

Defined results: vectors that are null, empty of finite numbers (a null, NaN or infinite component, before or after scaling) or
have a null id take no part. A vector without components has the score 0 with its like. Only vectors of one length meet.
Of rows with equal ids each is a candidate of the other. Components may be of any size: a vector of norm 2^26 or more is scored
by whole numbers without bounds, and a score outside of a long counts as the nearest long. With fewer candidates than k all are
given. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, written

SCALE = 1024.0
#: Pivots of each vector length, and the entries they are chosen from.
PIVOTS, SAMPLE, SAMPLE_BYTES = 32, 4096, 16 << 20
#: Entries of a group, queries of a group, and entries of a block inside a group, about.
GROUP, QUERIES, BLOCK = 8192, 8192, 256
#: Vectors of at least this norm are scored by whole numbers: below it all products of two are exact doubles.
WIDE = float(1 << 26)
_LONG = (-(1 << 63), (1 << 63) - 1)
_ENTRY = "dim int, packed binary"


def _pack(row: np.ndarray) -> bytes:
    """Whole numbers as float32 where all are exact in it, else as float64; the length tells which."""
    return row.astype("<f4" if np.abs(row).max(initial=0) < 1 << 24 else "<f8").tobytes()


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(packed), dim))
    for r, raw in enumerate(packed):
        out[r] = np.frombuffer(raw, "<f4" if len(raw) == 4 * dim else "<f8")
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (id, dim, packed) of the vectors that take part."""
    for batch in batches:
        vectors = batch.column(1)
        ends = vectors.offsets.to_numpy()
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(vectors.values.to_numpy(zero_copy_only=False).astype(float) * SCALE) + 0.0
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        stay = np.flatnonzero((bad[ends[1:]] == bad[ends[:-1]]) & ~vectors.is_null().to_numpy(zero_copy_only=False))
        packed = [_pack(values[ends[r] : ends[r + 1]]) for r in stay]
        arrays = [batch.column(0).take(pa.array(stay)), pa.array(ends[stay + 1] - ends[stay], pa.int32()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "dim", "packed"])


def _rows(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    source = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null")
    return source.mapInArrow(_whole, "id long, " + _ENTRY)


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Far from each other: each next one is the farthest from those before it; fewer where vectors are equal."""
    chosen, nearest = [], np.full(len(sample), np.inf)
    at = int((sample**2).sum(1).argmax()) if len(sample) else 0
    while len(chosen) < min(most, len(sample)) and nearest[at] > 0:
        chosen.append(at)
        nearest = np.minimum(nearest, ((sample - sample[at]) ** 2).sum(1))
        at = int(nearest.argmax())
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


class _Index:
    """What tasks need: by vector length the pivots, and the sample that gives queries their first threshold."""

    def __init__(self, samples: dict[int, np.ndarray], k: int):
        self.samples, self.k = samples, k
        self.pivots = {dim: choose_pivots(s) for dim, s in samples.items()}

    def entries(self, x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Table of distances, squared norms (infinite if wide), nearest pivots and the distances to these."""
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (x**2).sum(1)
            wide = ~(squares < WIDE**2)
            pivots = self.pivots.get(dim, np.empty((0, dim)))
            table = distances(np.where(wide[:, None], 0, x), pivots)
        none = np.zeros(len(x), np.int64)
        home = table.argmin(1) if len(pivots) else none
        near = table[np.arange(len(x)), home] if len(pivots) else none.astype(float)
        return table, np.where(wide, np.inf, squares), home, near

    def thresholds(self, x: np.ndarray, squares: np.ndarray, dim: int) -> np.ndarray:
        """A score that k + 1 rows reach: that of the sample's (k + 1)-th."""
        sample = self.samples.get(dim, np.empty((0, dim)))
        if len(sample) <= self.k:
            return np.full(len(x), -np.inf)
        usable = np.isfinite(squares)
        scores = np.where(usable[:, None], x, 0) @ sample.T
        return np.where(usable, np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1], -np.inf)


def _tabled(batches: Iterator[pa.RecordBatch], index: _Index, asked: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.take(pa.array(np.flatnonzero(dims == dim)))
            x = unpack(part.column("packed").to_pylist(), int(dim))
            table, squares, home, near = index.entries(x, int(dim))
            first = index.thresholds(x, squares, int(dim)) if asked else np.zeros(len(x))
            own = [pa.array([t.tobytes() for t in table], pa.binary()), pa.array(squares), pa.array(home), pa.array(near), pa.array(first)]
            yield pa.RecordBatch.from_arrays([*part.columns, *own], [*part.schema.names, "distances", "square", "home", "near", "first"])


_TABLED = "distances binary, square double, home long, near double, first double"


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes around the entries of a group in a batch: least and largest distance to each pivot, largest norm, least threshold."""
    for batch in batches:
        groups, dims = (batch.column(c).to_numpy() for c in ("grp", "dim"))
        out = []
        for g, dim in np.unique(np.column_stack([groups, dims]), axis=0).tolist():
            part = batch.take(pa.array(np.flatnonzero((groups == g) & (dims == dim))))
            table = _table(part)
            lo, hi = (table.min(0), table.max(0)) if len(table) else (table, table)
            out.append((g, dim, lo.tolist(), hi.tolist(), float(part.column("square").to_numpy().max()), float(part.column("first").to_numpy().min())))
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], ["grp", "dim", "lo", "hi", "square", "first"])


def _table(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("distances").to_pylist()), "<f8").reshape(len(rows), -1) if len(rows) else np.empty((0, 0))


def _bound(square, squares, gap):
    """Above every score of vectors of these norms that are ``gap`` apart at least; the last terms cover rounding."""
    gap = np.maximum(gap * (1 - 1e-9) - 1e-6, 0)
    return (square + squares - gap**2) / 2 * (1 + 1e-12) + 1e-3


def _gaps(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By row of boxes: how far ``at`` lies outside in the worst column, 0 if inside."""
    return np.maximum(np.maximum(lo - at, at - hi).max(1, initial=0), 0)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    whole = [int(v) for v in q]
    return np.array([min(max(sum(a * int(b) for a, b in zip(whole, row)), _LONG[0]), _LONG[1]) for row in x], object)


class _Group:
    """The entries of one group and vector length, in blocks."""

    def __init__(self, rows: pa.Table, dim: int):
        rows = rows.sort_by([("home", "ascending"), ("near", "ascending")])
        self.packed, self.ids = rows.column("packed").to_pylist(), rows.column("ids").to_pylist()
        self.x, self.table, self.squares = unpack(self.packed, dim), _table(rows), rows.column("square").to_numpy()
        self.starts = np.arange(0, len(rows), BLOCK)
        self.lo, self.hi = np.minimum.reduceat(self.table, self.starts), np.maximum.reduceat(self.table, self.starts)
        self.largest = np.maximum.reduceat(self.squares, self.starts)

    def search(self, q: np.ndarray, packed: bytes, at: np.ndarray, square: float, first: float, k: int) -> list[tuple[int, int, bool]]:
        """The k best rows of score ``first`` or more: (score, id, whether its vector is the query's own)."""
        best, limit = [], first
        bounds = _bound(square, self.largest, _gaps(self.lo, self.hi, at))
        order = np.argsort(-bounds, kind="stable")
        done, step = 0, 2
        while done < len(order) and bounds[order[done]] >= limit:
            blocks = order[done : done + step]
            done, step = done + step, step * 2
            rows = np.concatenate([np.arange(self.starts[b], min(self.starts[b] + BLOCK, len(self.x))) for b in blocks[bounds[blocks] >= limit]])
            own = _bound(square, self.squares[rows], np.abs(self.table[rows] - at).max(1, initial=0))
            rows, own = rows[own >= limit], own[own >= limit]
            ranked = np.argsort(-own, kind="stable")
            rows, own = rows[ranked], own[ranked]
            for a in range(0, len(rows), BLOCK):
                if own[a] < limit:
                    break
                some = rows[a : a + BLOCK]
                wide = ~np.isfinite(self.squares[some]) | (not np.isfinite(square))
                scores = (np.where(wide[:, None], 0, self.x[some]) @ np.where(np.isfinite(square), q, 0)).astype(object if wide.any() else np.int64)
                if wide.any():
                    scores[wide] = _exact(q, self.x[some[wide]])
                good = np.flatnonzero(scores >= limit)
                best += [(int(scores[r]), i, self.packed[some[r]] == packed) for r in good for i in self.ids[some[r]]]
                if len(best) > k:
                    best = sorted(best, key=lambda e: (-e[0], e[1], not e[2]))[:k]
                if len(best) == k:
                    limit = max(limit, min(e[0] for e in best))
        return best


_FOUND = "number long, score long, id long, own boolean"


def _cells(entries: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    out = []
    for dim in asked.column("dim").unique().to_pylist():
        of = lambda t: t.filter(pa.compute.equal(t.column("dim"), dim))
        own, queries = of(entries), of(asked)
        if not len(own):
            continue
        group, tables = _Group(own, dim), _table(queries)
        packed = queries.column("packed").to_pylist()
        vectors = unpack(packed, dim)
        for r, (n, square, first) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("number", "square", "first")))):
            out += [(n, *e) for e in group.search(vectors[r], packed[r], tables[r], square, first, k)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, kinds)], names=["number", "score", "id", "own"])


def _sampled(entries: DataFrame, k: int) -> _Index:
    rows = entries.select("dim", "packed").orderBy(F.xxhash64("packed"), "packed").limit(SAMPLE).collect()
    samples: dict[int, list[bytes]] = {}
    room = SAMPLE_BYTES
    for r in rows:
        room -= 8 * r.dim
        if room >= 0:
            samples.setdefault(r.dim, []).append(bytes(r.packed))
    found = {dim: unpack(packed, dim) for dim, packed in samples.items()}
    with np.errstate(over="ignore"):
        return _Index({dim: x[(x**2).sum(1) < WIDE**2] for dim, x in found.items()}, k)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k candidate rows of largest score, ties to the smaller id.

    Both tables have an id and a vector. A query row that is also a candidate (same id and vector) is not its own result.
    """
    rows = _rows(candidates, vec_id, vector)
    order = Window.partitionBy("dim", "packed").orderBy("id")
    least = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    entries = written(least.groupBy("dim", "packed").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    index = _sampled(entries, k)
    deal = ("dim", "home", "near", "packed")

    def dealt(table: DataFrame, asked: bool, size: int) -> DataFrame:
        names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
        tabled = table.mapInArrow(lambda it: _tabled(it, index, asked), f"{names}, {_TABLED}")
        parts = max(1, -(-table.count() // size))
        return tabled.repartitionByRange(parts, *deal).withColumn("grp", F.spark_partition_id().cast("long"))

    held = written(dealt(entries, False, GROUP), "entries")
    wanted = written(_rows(queries, vec_id, vector), "query-rows")
    distinct = written(wanted.select("dim", "packed").distinct(), "query-vectors")
    asked = written(dealt(distinct, True, QUERIES).withColumn("number", F.monotonically_increasing_id()), "queries")
    groups = asked.agg(F.max("grp")).first()[0] or 0

    box = "grp long, dim int, lo array<double>, hi array<double>, square double, first double"
    theirs = asked.select("grp", "dim", "distances", "square", "first").mapInArrow(_boxes, box)
    theirs = theirs.select("dim", F.col("grp").alias("other"), *[F.col(c).alias(f"q{c}") for c in ("lo", "hi", "square", "first")])
    ours = held.select("grp", "dim", "distances", "square", "first").mapInArrow(_boxes, box).drop("first")
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x - y), F.lit(0.0), lambda m, d: F.greatest(m, d))
    gap = F.greatest(apart("lo", "qhi"), apart("qlo", "hi"))
    gap = F.greatest(gap * (1 - 1e-9) - 1e-6, F.lit(0.0))
    bound = (F.col("square") + F.col("qsquare") - gap * gap) / 2 * (1 + 1e-12) + 1e-3  # as in _bound
    each = ours.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups)).cast("array<long>")))
    cells = written(each.join(theirs, ["dim", "other"]).filter(bound >= F.col("qfirst")).select("grp", "other").distinct(), "cells")

    left = held.join(cells, "grp").select("grp", "other", "dim", "packed", "ids", "distances", "square", "home", "near")
    right = asked.withColumnRenamed("grp", "other").join(cells, "other").select("grp", "other", "dim", "packed", "distances", "square", "first", "number")
    found = left.groupBy("grp", "other").cogroup(right.groupBy("grp", "other")).applyInArrow(lambda a, b: _cells(a, b, k + 1), _FOUND)
    best = Window.partitionBy("number").orderBy(F.desc("score"), "id", F.desc("own"))
    kept = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    lists = kept.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("n", "score", "id", "own"))).alias("found"))
    lists = written(lists.join(asked.select("number", "dim", "packed"), "number").select("dim", "packed", "found"), "found")
    discard(entries, held, distinct, asked, cells)

    # A query's own row leaves its vector's list once.
    mine = F.array_min(F.transform(F.filter("found", lambda e: e.own & (e.id == F.col("id"))), lambda e: e.n))
    rest = F.slice(F.filter("found", lambda e: F.col("mine").isNull() | (e.n != F.col("mine"))), 1, k)
    out = wanted.join(lists, ["dim", "packed"]).withColumn("mine", mine).select(F.col("id").alias("query_id"), F.posexplode(rest).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score"))


def op12_exact_top_k(spark, sf_dir: str) -> DataFrame:
    from .common import read

    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 100 = 0"))


SQL = {
    "op12_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}

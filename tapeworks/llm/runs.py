"""Periodic run detection: all maximal repetitions of a text's words, by longest common extensions over a difference cover.

A run of period q is a stretch of words whose smallest period is q, of at least ``max(LEAST, TIMES * q)`` words, that no
neighbouring word extends keeping q. Candidates come from a harmonic grid: for each q only the positions 0, q, 2q, ... are
looked at, n ln n in all. A run of at least four periods covers four grid points in a row, so four equal words there are
necessary; what passes is extended both ways by LCE queries and kept if long enough. Equal stretches found for a multiple of
their period keep the smallest one (it divides the others, since the stretch is longer than any two periods together).

LCE. D = COVER is a difference cover modulo 31: for any two positions some k < 31 takes both into D. Only the suffixes at such
positions are sorted (6 of 31): by their first 31 words, then by doubling over positions 31 apart, which are sampled too. The
common prefixes of neighbours in that order follow from the doubling's levels, and a sparse table answers minima over them. A
query compares at most 30 words to reach two sampled positions, and asks for one minimum there. Backward extensions are those
of the reversed words. All of it is numpy over one text; the index is built only for texts with candidates.

Spark: a text is one row, handled by one task as a stream of Arrow batches; nothing is shuffled. A text takes O(n ln n) time and
O(n) memory.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none and no run. Rows with equal or null ids each
have a result of their own. All columns of any name pass through ``collapse``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ROW, from_row, with_row

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Every difference modulo MOD is one of two members of COVER.
MOD, COVER = 31, (0, 1, 3, 8, 12, 18)
_IN = np.full(MOD, -1, np.int64)
_IN[list(COVER)] = np.arange(len(COVER))
#: By the residues of two positions: the least k that takes both into COVER.
_SHIFT = np.array([[next(k for k in range(MOD) if _IN[(a + k) % MOD] >= 0 and _IN[(b + k) % MOD] >= 0) for b in range(MOD)] for a in range(MOD)])
#: Grid points, or queries, handled at once.
CHUNK = 1 << 18


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Lce:
    """Longest common extensions of a sequence of ids from 1 up."""

    def __init__(self, ids: np.ndarray):
        self.n, width = len(ids), len(COVER)
        self.padded = np.concatenate([ids, np.zeros(2 * MOD, ids.dtype)]).astype(np.int32)  # 0 stands behind the end, and sorts first
        at = (np.arange(self.n // MOD + 1)[:, None] * MOD + np.array(COVER)).ravel()
        at = at[at <= self.n]
        first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.padded.astype(">u4"), MOD)[at])
        levels, step = [_ranks(first.view(f"V{4 * MOD}").ravel())], width
        while levels[-1].max() + 1 < len(at):
            follow = np.zeros(len(at), np.int64)
            follow[: max(0, len(at) - step)] = levels[-1][step:] + 1
            levels.append(_ranks(levels[-1] * (len(at) + 1) + follow))
            step *= 2
        self.rank, order = levels[-1], np.argsort(levels[-1])
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < len(at)
            same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
            a, b, common = a + same * (width << k), b + same * (width << k), common + same * (MOD << k)
        common += self._direct(at[order[:-1]] + common, at[order[1:]] + common, np.full(len(a), MOD))
        self.least = [common]
        while 2 << len(self.least) - 1 <= len(common):
            half = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common words from i and j on, word by word, up to ``most``."""
        out, open_ = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        while len(open_):
            open_ = open_[self.padded[i[open_] + out[open_]] == self.padded[j[open_] + out[open_]]]
            out[open_] += 1
            open_ = open_[out[open_] < most[open_]]
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i and j differ and are 0 to n."""
        shift = _SHIFT[i % MOD, j % MOD]
        out = self._direct(i, j, shift)
        far = np.flatnonzero(out == shift)
        x, y = i[far] + shift[far], j[far] + shift[far]
        x, y = (self.rank[p // MOD * len(COVER) + _IN[p % MOD]] for p in (x, y))
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        for k in np.unique(level):
            here, table = level == k, self.least[k]
            out[far[here]] += np.minimum(table[lo[here]], table[hi[here] - (1 << int(k))])
        return out


def _grid(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q) in pieces: grid points i with four equal words q apart from it on."""
    n, q = len(ids), 1
    while q <= n // TIMES:
        counts = (n - 1) // np.arange(q, min(n // TIMES, q + CHUNK) + 1) - (TIMES - 2)
        upto = max(1, int(np.searchsorted(np.cumsum(counts), CHUNK, side="right")))
        periods, counts = np.arange(q, q + upto), counts[:upto]
        q += upto
        p = np.repeat(periods, counts)
        i = (np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)) * p
        for k in range(1, TIMES):
            same = ids[i + (k - 1) * p] == ids[i + k * p]
            i, p = i[same], p[same]
        for a in range(0, len(i), CHUNK):
            yield i[a : a + CHUNK], p[a : a + CHUNK]


def find_runs(ids: np.ndarray) -> np.ndarray:
    """Ids from 1 up to rows (start, length, period), by start, then period."""
    found, ahead, back, n = [np.empty((0, 3), np.int64)], None, None, len(ids)
    for i, q in _grid(ids):
        if not len(i):
            continue
        if ahead is None:
            ahead, back = Lce(ids), Lce(ids[::-1])
        start, end = i.copy(), i + q + ahead(i, i + q)
        inner = i > 0
        start[inner] -= back(n - i[inner], n - i[inner] - q[inner])
        long = end - start >= np.maximum(LEAST, TIMES * q)
        found.append(np.unique(np.column_stack([start, end, q])[long], axis=0))
    all_ = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    first = np.ones(len(all_), bool)
    first[1:] = (all_[1:, :2] != all_[:-1, :2]).any(1)
    out = all_[first]
    out[:, 1] -= out[:, 0]
    return out[np.lexsort([out[:, 2], out[:, 0]])]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Each word's first place in the text, from 1."""
    return np.array(list(map({}.setdefault, words, count(1))), np.int64)


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """False for the words that some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def strongest(runs: np.ndarray) -> tuple[int, int, int]:
    """The run of greatest length / period; ties: smallest start, then period."""
    power = runs[:, 1] / runs[:, 2]
    near = runs[power >= power.max() * (1 - 1e-9)].tolist()
    return tuple(min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[list[bytes]]:
    for text in batch.column(name):
        yield (text.as_py() or b"").split()  # bytes: exactly the six white space characters


_RUNS = "array<struct<start: long, length: long, period: long>>"


def collapse(docs: DataFrame, text: str = "text", shorten: bool = True) -> DataFrame:
    """docs with ``runs`` (start, length, period of each) and n_dropped; with ``shorten`` the text keeps each run's first period.

    A text without runs stays as it is, byte for byte; one with runs is its kept words, joined by one space.
    """
    rows = with_row(docs, _tw_text=F.col(text).cast("string").cast("binary"))
    struct = T.StructType([rows.schema[ROW], T.StructField("_tw_text", T.StringType()), *T._parse_datatype_string(f"_tw_runs {_RUNS}, _tw_dropped long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, gone = [], [], []
            for raw, words in zip(batch.column("_tw_text"), _texts(batch, "_tw_text")):
                runs = find_runs(word_ids(words))
                stay = kept(len(words), runs)
                texts.append(raw.as_py() if not len(runs) else b" ".join(w for w, s in zip(words, stay) if s))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs.tolist()])
                gone.append(int(len(words) - stay.sum()))
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
            arrays = [batch.column(ROW), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(found, kind), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [ROW, "_tw_text", "_tw_runs", "_tw_dropped"])

    own = {"runs": "_tw_runs", "n_dropped": "_tw_dropped"} | ({text: "_tw_text"} if shorten else {})
    return from_row(rows.mapInArrow(run, struct), docs.columns, **own)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's texts: one in ten, by the id's CRC, repeats itself from some word on. A null id leaves its text alone."""
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


_DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, words in zip(batch.column("doc_id").to_pylist(), _texts(batch, "text")):
            words = planted(words, key)
            runs = find_runs(word_ids(words))
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
            s, n, q = strongest(runs) if len(runs) else (None, None, None)
            stay = words if not len(runs) else [w for w, k in zip(words, kept(len(words), runs)) if k]
            out.append((key, len(runs), s, n, q, None if n is None else 1000 * n // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(stay)).hexdigest()))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [f.split()[0] for f in _DIGESTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 8, kinds)], names)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document's runs, after the repetitions that the query plants in one document of ten."""
    from .common import read

    docs = read(spark, sf_dir, "documents")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return source.mapInArrow(_digests, _DIGESTS)

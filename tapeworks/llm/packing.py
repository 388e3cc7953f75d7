"""Packing: tokenised documents into sequences of at most ``width`` tokens.

Bounded-space online packing. A task keeps ``open_windows`` windows open. The part of a document beyond its last full
window goes to the open window that it fits best; if it fits none, the fullest window is topped up with its head, emitted
full, and a new window takes the rest. So only windows that are still open when a task's input ends are not full: those
leftovers, a few windows per task however long its input is, are merged by a second, 32 times narrower round, which pours
them into full windows and cuts its last one at powers of two, which need no padding.

Each task tokenises its rows once: its pieces are written to the shared folder, from which both rounds read. Texts are
read whole; memory is bounded by the open windows, one batch and the word cache.

Defined results: a null or empty text is a document of only the end id. Rows with equal ids are packed one by one. An
empty table gives no pieces. Other columns are not used.

Ids: the vocabulary of the given ``tokenizers`` file. Text is cut at single spaces between non-space characters, where
byte-level BPE always cuts, and each different word is encoded once per task (the cache is bounded; a text with any other
run of white space is encoded whole). A word of letters, but for one stop at its end, is one piece (and the stop another) and skips
the search for pieces. Encoding is by ``tiktoken`` over the same vocabulary, several times faster and tested to give the same
ids, the special token's string included.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import written

WIDTH, OPEN_WINDOWS, END_ID, CACHED_WORDS, MERGE = 2048, 16, 1, 300_000, 32
_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def _encoding(path: str):
    """A tiktoken encoding with the ids of a byte-level BPE file of tokenizers, whose ids are its merge ranks."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
        raise ValueError("only plain byte-level BPE vocabularies can be used here")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these bytes as themselves, others from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), tuple(special)


class Tokens(dict):
    """Ids as little-endian unsigned 32-bit bytes, by word; None for a word that borders on other white space."""

    def __init__(self, path: str):
        self.encoding, self.special = _encoding(path)
        self.old: dict = {}
        self.piece = self.encoding._encode_single_piece
        self.stops = {c: tuple(self.piece(c)) for c in ".,;:!?"}

    def encode(self, text: str) -> bytes:
        ids = self.encoding.encode(text, allowed_special="all") if any(s in text for s in self.special) else self.encoding.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a space and the word."""
        stop = self.stops.get(word[-1], ())
        letters = word[:-1] if stop else word
        if letters.isalpha():
            ids = (*self.piece(" " + letters), *stop)
            return struct.pack(f"<{len(ids)}I", *ids)
        return self.encode(" " + word)

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None and word and not word[0].isspace() and not word[-1].isspace():
            found = self.word(word)
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        words = text.split(" ")
        if len(words) < 3 or not words[0] or words[0][-1].isspace():
            return self.encode(text)
        try:
            return self.encode(words[0]) + b"".join(map(self.__getitem__, words[1:]))
        except TypeError:
            return self.encode(text)


class _Packer:
    """Open windows of pieces (doc_id, start, ids, doc_tokens, offset) and the rows of those that are done."""

    def __init__(self, width: int, space: int):
        self.width, self.space, self.open, self.done, self.size = width, space, [], [], 0

    def put(self, doc_id, ids: bytes, start: int, total: int) -> None:
        at, n, width = 0, len(ids) // 4, self.width
        while n - at >= width:
            self.emit([[(doc_id, start + at, ids[4 * at : 4 * (at + width)], total, 0)], width])
            at += width
        if at == n:
            return
        fits = [w for w in self.open if w[1] + n - at <= width]
        if fits:
            best = max(fits, key=lambda w: w[1])
        else:
            if len(self.open) == self.space:
                full = max(self.open, key=lambda w: w[1])
                head = width - full[1]
                full[0].append((doc_id, start + at, ids[4 * at : 4 * (at + head)], total, full[1]))
                full[1], at = width, at + head
                self.open.remove(full)
                self.emit(full)
            best = [[], 0]
            self.open.append(best)
        best[0].append((doc_id, start + at, ids[4 * at : 4 * n], total, best[1]))
        best[1] += n - at
        if best[1] == width:
            self.open.remove(best)
            self.emit(best)

    def emit(self, window: list) -> None:
        self.done.append(window[0])
        self.size += 4 * window[1]


class _Rows:
    """Windows to record batches; sequence ids count up from a task's own base."""

    def __init__(self, base: int):
        self.next = base

    def batch(self, windows: list[list], closed: bool | None = None) -> pa.RecordBatch:
        rows = [(*p, self.next + k) for k, w in enumerate(windows) for p in w]
        self.next += len(windows)
        doc, start, ids, total, offset, seq = ([r[k] for r in rows] for k in range(6))
        columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        if closed is not None:
            columns, names = [*columns, pa.array([closed] * len(rows), pa.bool_()), pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64())], [*names, "closed", "part"]
        return pa.RecordBatch.from_arrays(columns, names)


def _first_round(batches: Iterator[pa.RecordBatch], path: str, width: int, space: int, end: int) -> Iterator[pa.RecordBatch]:
    tokens, packer, rows = Tokens(path), _Packer(width, space), _Rows(TaskContext.get().partitionId() << 33)
    tail = np.array([end], "<u4").tobytes()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids = tokens.ids(text.as_py() or "") + tail
            packer.put(doc_id.as_py(), ids, 0, len(ids) // 4)
            if packer.size > 1 << 22:
                yield rows.batch(packer.done, True)
                packer.done, packer.size = [], 0
    yield rows.batch(packer.done, True)
    yield rows.batch([w[0] for w in packer.open], False)


def _second_round(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    packer, rows = _Packer(width, 1), _Rows(1 << 62 | TaskContext.get().partitionId() << 33)
    for batch in batches:
        for p in batch.to_pylist():
            packer.put(p["doc_id"], p["ids"], p["start"], p["doc_tokens"])
        yield rows.batch(packer.done)
        packer.done = []
    for pieces, fill in packer.open:
        windows, start = [], 0
        while start < fill:  # the rest of the last window, cut at powers of two
            size, window = 1 << ((fill - start).bit_length() - 1), []
            for doc_id, at, ids, total, offset in pieces:
                a, b = max(offset, start), min(offset + len(ids) // 4, start + size)
                if a < b:
                    window.append((doc_id, at + a - offset, ids[4 * (a - offset) : 4 * (b - offset)], total, a - start))
            windows.append(window)
            start += size
        yield rows.batch(windows)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, width: int = WIDTH, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    path = vocabulary or default_vocabulary()
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = written(source.mapInArrow(lambda it: _first_round(it, path, width, open_windows, end_id), _PIECE + ", closed boolean, part long"), "pieces")
    names = [x.split()[0] for x in _PIECE.split(", ")]
    tasks = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    groups = -(-tasks // MERGE)
    rest = pieces.filter("not closed").select(*names, F.floor(F.col("part") / MERGE).alias("group")).repartition(groups, "group").sortWithinPartitions("group", "sequence_id", "offset").drop("group")
    return pieces.filter("closed").select(names).unionByName(rest.mapInArrow(lambda it: _second_round(it, width), _PIECE))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = pack(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

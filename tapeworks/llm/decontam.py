"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every training passage (windows of ``2 * stride`` words that overlap by half; the stride is the longest indexed part, so a part
inside a document lies whole in some passage) queries the index. An item of at most ``PART`` words is one part; a longer one
is cut evenly. Impacts are BM25 weights divided by the part's score for its own text, so 1 means that the passage holds all
of its words, and ``threshold`` is the same for all. If a passage holds that share of a long item, it does so of one of its
parts, so no long item is missed; it is then scored as a whole on the words around.

Postings are sorted by part (parts by length, which keeps block maxima tight), in blocks of ``BLOCK`` with their largest impact.
The search moves one cursor for each term of a passage: terms are sorted by their cursors, the pivot is the first part at which
the terms' largest impacts add up to the threshold, and only if the maxima of the blocks around the pivot do so too is it
scored; else the cursors skip to the end of the nearest block. All passages of a batch take these steps at once, as arrays, and
leave when no pivot is left. All parts at or above the threshold are retrieved; a term counts once in a passage. A hit is then
verified on the words around the passage: enough word 3-grams of the item's question (all but its last sentence) and of its
answer (its last sentence) must occur there in order.

The index is built from at most about ``MAX_WORDS`` words of items at a time (more only by one item), which bounds what is
collected and broadcast; a larger benchmark is searched in as many shards, one after the other. Document frequencies, the mean
length and the stride are those of the whole benchmark, counted in Spark before it is cut, so a score does not depend on the shards.
A document's hits never leave its row, so nothing is shuffled.

Defined results: null or empty texts and items have no words and never match. Items of equal text are all reported; rows of
equal id and text are one item. Null item ids are reported as null. Other columns pass through, whatever their names; a column
called ``_tw_hits`` makes place for the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ROW, discard, from_row, with_row, written

K1, B = 1.2, 0.75
PART, BLOCK, MAX_WORDS = 64, 8, 1_000_000
THRESHOLD, MIN_QUESTION, MIN_ANSWER = 0.6, 0.7, 0.5
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|…«»“”‘’-"
_BATCH_BYTES = 1 << 22
_ROUNDING = 1e-9

HIT = "array<struct<item_id:bigint,score:double,question:double,answer:double,passage_start:bigint>>"


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-cased words without surrounding punctuation; a word of punctuation alone becomes empty."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat = pc.utf8_trim(lists.flatten(), characters=PUNCTUATION)
    return pa.ListArray.from_arrays(lists.offsets, flat)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer; of a single sentence, its last quarter of words."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip(PUNCTUATION + " \n")]
    if len(parts) > 1 and len(parts[-1].split()) >= 2:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) * 3 // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _grams(words: list[str], n: int) -> set[tuple]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _share(part: list[str], near: list[str]) -> float:
    """The share of a part's word 3-grams (of all its words, if it has fewer) that occur in order nearby."""
    n = min(3, len(part))
    own = _grams(part, n)
    return len(own & _grams([w for w in near if w], n)) / len(own) if n else 1.0


@dataclass(frozen=True)
class Statistics:
    """Of a whole benchmark: items and words, the longest part, and how many items have each word (of those that are asked for)."""

    items: int
    words: int
    stride: int
    df: dict[str, int]

    @classmethod
    def of(cls, lists: list[list[str]]) -> "Statistics":
        longest = max((-(-len(x) // -(-len(x) // PART)) for x in lists if x), default=0)
        return cls(sum(map(bool, lists)), sum(map(len, lists)), longest, Counter(w for x in lists for w in set(x)))


class Index:
    """Postings with block maxima of items [(item_id, text)]; they are the whole benchmark, or ``statistics`` are of that."""

    def __init__(self, items: list[tuple], statistics: Statistics | None = None):
        lists = words_of(pa.array([t or "" for _, t in items], pa.string())).to_pylist()
        said = [(k, t, w) for (k, t), x in zip(items, lists) if (w := [w for w in x if w])]
        self.ids, self.words = [k for k, _, _ in said], [w for _, _, w in said]
        halves = [split_item(t) for _, t, _ in said]
        norm = lambda xs: [[w for w in x if w] for x in words_of(pa.array(xs, pa.string())).to_pylist()]
        self.question, self.answer = norm([h[0] for h in halves]), norm([h[1] for h in halves])
        parts = []
        for k, x in enumerate(self.words):
            n = -(-len(x) // PART)
            parts += [(k, x[len(x) * i // n : len(x) * (i + 1) // n]) for i in range(n)]
        parts.sort(key=lambda p: len(p[1]))
        self.item = [k for k, _ in parts]
        self.whole = [len(self.words[k]) <= PART for k in self.item]
        of = statistics or Statistics.of(self.words)
        self.stride = max(8, of.stride)

        self.vocabulary = sorted({w for _, x in parts for w in x})
        self.number = {w: k for k, w in enumerate(self.vocabulary)}
        self.items, self.df, self.mean = of.items, of.df, of.words / max(1, of.items)
        rows = [(self.number[w], d, i) for d, (_, x) in enumerate(parts) for w, i in self._impacts(x).items()]
        rows.sort()
        term, part, impact = (np.array([r[c] for r in rows], t) for c, t in enumerate((np.int64, np.int64, float)))
        # Keys are term * span + part: one sorted array finds the next posting of any term at or after any part.
        self.n, self.span = len(parts), len(parts) + 1
        self.keys, self.impact = term * self.span + part, impact
        first = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        block = (np.arange(len(term)) - first[term]) // BLOCK if len(term) else term
        cut = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else term
        self.block_max = np.maximum.reduceat(impact, cut) if len(term) else impact
        self.block_end = self.keys[np.r_[cut[1:], len(term)] - 1] if len(term) else term
        self.top = np.maximum.reduceat(impact, first[:-1]) if len(term) else impact
        self.first = part[first[:-1]] if len(term) else term

    def _impacts(self, words: list[str]) -> dict[str, float]:
        """A text's terms with their shares of its own BM25 score."""
        n, made = self.items, {}
        for w, tf in Counter(words).items():
            idf = np.log(1 + (n - self.df[w] + 0.5) / (self.df[w] + 0.5))
            made[w] = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / self.mean)))
        total = sum(made.values())
        return {w: x / total for w, x in made.items()}

    def _next(self, keys: np.ndarray, term: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first of the sorted keys at or after (term, part) is, and its part; ``n`` if that term has none."""
        at = np.searchsorted(keys, term * self.span + part)
        found = keys[np.minimum(at, len(keys) - 1)] - term * self.span
        return at, np.where((at < len(keys)) & (found < self.n), found, self.n)

    def wand(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passages, parts, scores) of all at or above the threshold; the terms of a passage lie together."""
        threshold -= _ROUNDING
        if len(passage):  # Passages that cannot reach it leave before anything is sorted.
            start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            stay = np.repeat(np.add.reduceat(self.top[term], start) >= threshold - _ROUNDING, np.diff(np.r_[start, len(passage)]))
            passage, term = passage[stay], term[stay]
        cursor = self.first[term]
        while len(passage):
            order = np.argsort(passage * self.span + cursor, kind="stable")
            passage, term, cursor = passage[order], term[order], cursor[order]
            start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            size = np.diff(np.r_[start, len(passage)])
            summed = np.cumsum(self.top[term])
            before = summed[start] - self.top[term[start]]
            pivot = np.searchsorted(summed, before + threshold)
            live = pivot < start + size
            part = np.where(live, cursor[np.minimum(pivot, len(cursor) - 1)], self.n)
            # Passages without a pivot are done, and so are terms without a posting left.
            stay = np.repeat(live & (part < self.n), size) & (cursor < self.n)
            passage, term, cursor, part = passage[stay], term[stay], cursor[stay], np.repeat(part, size)[stay]
            if not len(passage):
                return
            start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(passage)]))
            at_or_before = np.flatnonzero(cursor <= part)
            t, d, g = term[at_or_before], part[at_or_before], group[at_or_before]
            block, end = self._next(self.block_end, t, d)
            bound = np.bincount(g, np.where(end < self.n, self.block_max[np.minimum(block, len(self.block_max) - 1)], 0.0), len(start))
            scored = bound >= threshold
            use = scored[g]
            if use.any():
                at, found = self._next(self.keys, t[use], d[use])
                score = np.bincount(g[use], np.where(found == d[use], self.impact[np.minimum(at, len(self.impact) - 1)], 0.0), len(start))
                hit = np.flatnonzero(scored & (score >= threshold))
                if len(hit):
                    yield passage[start[hit]], part[start[hit]], score[hit]
            # Else skip: past the nearest end of these blocks, but not past the next term's cursor.
            target = np.full(len(start), self.n)
            np.minimum.at(target, g, np.minimum(end + 1, self.n))
            later = np.flatnonzero(cursor > part)
            np.minimum.at(target, group[later], cursor[later])
            target = np.where(scored, part[start] + 1, target)
            cursor[at_or_before] = self._next(self.keys, t, target[g])[1]

    def search(self, texts: pa.Array, threshold: float, min_question: float, min_answer: float) -> list[dict[int, tuple]]:
        """For each text: item number to (score, question, answer, passage start) of its best verified passage."""
        lists = words_of(texts)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        hits: list[dict[int, tuple]] = [{} for _ in texts]
        if not self.ids or not len(flat):
            return hits
        offsets, n_terms = offsets - offsets[0], len(self.vocabulary)
        term = pc.fill_null(pc.index_in(flat, value_set=pa.array(self.vocabulary, pa.string())), -1).to_numpy().astype(np.int64)
        # Chunks of stride words; passage c is chunks c and c + 1 of one document.
        base = np.concatenate([[0], np.cumsum(-(-np.diff(offsets) // self.stride))])
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        at = np.flatnonzero(term >= 0)
        chunk = base[doc[at]] + (at - offsets[doc[at]]) // self.stride
        earlier = chunk > base[doc[at]]
        pair = np.sort(np.concatenate([chunk * n_terms + term[at], (chunk[earlier] - 1) * n_terms + term[at][earlier]]))
        pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
        for passages, parts, scores in self.wand(pair // n_terms, pair % n_terms, threshold):
            for c, part, score in zip(passages.tolist(), parts.tolist(), scores.tolist()):
                d = int(np.searchsorted(base, c, "right")) - 1
                self._verify(part, score, (c - int(base[d])) * self.stride, flat, offsets[d : d + 2].tolist(), threshold, min_question, min_answer, hits[d])
        return hits

    def _verify(self, part, score, start, flat, of_doc, threshold, min_question, min_answer, hits) -> None:
        k = self.item[part]
        around = self.stride if self.whole[part] else len(self.words[k])
        lo, hi = of_doc[0] + max(0, start - around), min(of_doc[1], of_doc[0] + start + 2 * self.stride + around)
        near = flat.slice(lo, hi - lo).to_pylist()
        if not self.whole[part]:
            there = set(near)
            score = sum(x for w, x in self._impacts(self.words[k]).items() if w in there)
        q, r = (_share(half, near) for half in (self.question[k], self.answer[k]))
        if score >= threshold - _ROUNDING and q >= min_question and r >= min_answer:
            best = hits.get(k)  # of equal scores the first passage, whatever the order of the search
            if best is None or score > best[0] + _ROUNDING or score >= best[0] - _ROUNDING and start < best[3]:
                hits[k] = (score, q, r, start)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of about _BATCH_BYTES; a longer text is a part of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + _BATCH_BYTES)))
        yield texts.slice(a, b - a)
        a = b


def _search(batches: Iterator[pa.RecordBatch], broadcast, limits: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """ROW and _tw_text to these and _tw_hits, after those of earlier shards; without that in the schema, only rows that have no hits."""
    index = broadcast.value
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
        found = [h for part in _slices(texts) for h in index.search(part, *limits)]
        columns = [batch.column(0).cast(schema.field(0).type), batch.column(1)]
        if len(schema) == 2:
            yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array([not h for h in found], pa.bool_()))
        else:
            hits = [[{"item_id": index.ids[k], "score": s, "question": q, "answer": r, "passage_start": p} for k, (s, q, r, p) in sorted(h.items())] for h in found]
            if batch.num_columns > 2:
                hits = [before + own for before, own in zip(batch.column(2).to_pylist(), hits)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, schema.field(2).type)], schema=schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, shard) of items to their distinct words; a null word carries an item's length."""
    for batch in batches:
        words, shards, lengths = [], [], []
        for shard, said in zip(batch.column(1).to_pylist(), words_of(batch.column(0)).to_pylist()):
            own = [w for w in said if w]
            for word in [*sorted(set(own)), *[None] * bool(own)]:
                words.append(word), shards.append(shard), lengths.append(len(own))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(shards, pa.int64()), pa.array(lengths, pa.int64())], ["word", "shard", "length"])


def _shards(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).filter("text is not null").distinct()
    words = items.agg(F.sum(F.size(F.split("text", " "))).alias("n")).first()[0] or 0
    n = -(-words // MAX_WORDS) or 1
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("long"))
    said = written(items.select("text", "shard").mapInArrow(_counted, "word string, shard long, length long"), "item-words")
    longest = F.max(F.ceil(F.col("length") / F.ceil(F.col("length") / PART)))
    items_n, words_n, stride = said.filter("word is null").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(longest, F.lit(0))).first()
    df = said.filter("word is not null").groupBy("word").agg(F.count("*").alias("df"))
    for k in range(n):
        own = said.filter((F.col("shard") == k) & F.col("word").isNotNull()).select("word").distinct()
        known = {r.word: r.df for r in df.join(own, "word", "left_semi").collect()}  # as many as the shard has words
        part = items.filter(F.col("shard") == k).select("item_id", "text").collect()
        yield Index(sorted(map(tuple, part), key=lambda x: (x[0] is None, x[0], x[1])), Statistics(items_n, int(words_n), int(stride), known))
    discard(said)


def _searched(rows: DataFrame, benchmark: DataFrame, with_hits: bool, item_id: str, item_text: str, limits: tuple) -> DataFrame:
    """(ROW, _tw_text) rows through the shards, one after the other, as ``_search`` says."""
    for index in _shards(benchmark, item_id, item_text):
        shared = rows.sparkSession.sparkContext.broadcast(index)
        fields = [rows.schema[ROW], T.StructField("_tw_text", T.StringType())]
        schema = T.StructType([*fields, T.StructField("_tw_hits", T._parse_datatype_string(HIT))] if with_hits else fields)
        arrow = to_arrow_schema(schema)
        rows = rows.mapInArrow(lambda it, shared=shared, arrow=arrow: _search(it, shared, limits, arrow), schema)
    return rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER) -> DataFrame:
    """docs plus _tw_hits, the benchmark items that each contains."""
    rows = with_row(docs, (text,), _tw_text=F.col(text).cast("string"))
    found = _searched(rows, benchmark, True, item_id, item_text, (threshold, min_question, min_answer))
    return from_row(found, docs.columns, **{text: "_tw_text", "_tw_hits": "_tw_hits"})


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, item_id, score, question, answer, passage_start), one row for each document and item."""
    found = find_leaks(docs.select(F.col(doc_id).alias("doc_id"), F.col(options.get("text", "text"))), benchmark, **options)
    return found.select("doc_id", F.explode("_tw_hits").alias("h")).select("doc_id", "h.*")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER) -> DataFrame:
    """docs without those that contain an item."""
    rows = with_row(docs, (text,), _tw_text=F.col(text).cast("string"))
    found = _searched(rows, benchmark, False, item_id, item_text, (threshold, min_question, min_answer))
    return from_row(found, docs.columns, **{text: "_tw_text"})


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import read

    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 4).alias("score"), F.round("question", 4).alias("question_overlap"), F.round("answer", 4).alias("answer_overlap"), "passage_start")

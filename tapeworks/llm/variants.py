"""Spelling variants: all pairs of words one edit apart, found by walking a trie that is a table, level by level.

The trie's edges are a distributed table. Only nodes that branch are kept (a node is a prefix after which words go on in two ways,
or end and go on); an edge carries the letters between two of them, or from the last one to a word's end, with the word and its
count. So the number of levels is that of branchings, however long words are, and there are at most two edges a word.

The frontier is a table of states (word, what is left of it, node, edits). A level joins states with the edges of their nodes and
consumes an edge's letters, exactly or with one edit; states with a spent edit join by node and next letter, since the rest must
be equal. A state that comes with one edit to another word's end makes the two neighbours. Each level is written, so nothing is
computed twice and a lost executor costs one level.

An edit lies in a word's first half or its second, so neighbours share the first floor(m / 2) letters of a word of m, or all
others. There are two tries, of words and of words read backwards, and states start below what is shared: at the deepest
branching of that part, or at the first one below it. Near the root, where every node has all letters below it, nothing starts; the shortest
shared part is DEPTH letters and shallower nodes do not exist. A node is a 64-bit hash of its prefix; every pair found is verified on
the words, and equal hashes could only add candidates, so none is lost or wrong.

Defined results: a text that is null or empty has no words, a null id counts as the empty text, no rows give no rows. Very long
words are words. Ties of counts go to the word that is smallest by code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, written

LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Words have at least so many code points and occurrences.
LENGTH, TIMES = 5, 3
#: The least number of letters that neighbours share on one side, for words of LENGTH or more.
DEPTH = LENGTH // 2
#: Words, or prefixes, that a task holds before it hands them on, about.
HELD = 20_000
#: A word's form has at least so many times its occurrences.
FACTOR = 2
#: One run in so many loses a letter in the query.
DAMAGED = 97


def damaged(run: str, doc: int) -> str:
    """A run without one code point, if its CRC in the document (``doc``: the CRC of ``<doc_id>:``) says so."""
    h = zlib.crc32(run.encode(), doc)
    k = h % len(run)
    return run if h % DAMAGED else run[:k] + run[k + 1 :]


def _counts(batches: Iterator[pa.RecordBatch], damage: bool) -> Iterator[pa.RecordBatch]:
    """(id, text) to (word, n), summed over a batch, or over less where a batch has very many words."""
    made = lambda t: pa.RecordBatch.from_arrays([pa.array(list(t), pa.string()), pa.array(list(t.values()), pa.int64())], ["word", "n"])
    for batch in batches:
        total: Counter[str] = Counter()
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if len(total) > HELD:
                total.pop("", None)
                yield made(total)
                total.clear()
            found = LETTERS.findall((text.as_py() or b"").lower().decode())  # of bytes: only A-Z are lower-cased
            if not damage:
                total.update(found)
                continue
            doc = zlib.crc32(f"{'' if key is None else key}:".encode())
            for run, n in Counter(found).items():
                total[damaged(run, doc)] += n
        total.pop("", None)
        yield made(total)


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", damage: bool = False, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n): words of whole texts with at least so many code points and occurrences, counted per batch before the shuffle."""
    source = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string").cast("binary"))
    each = source.mapInArrow(lambda it: _counts(it, damage), "word string, n long").filter(F.length("word") >= length)
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


_SPOT = "number long, way int, depth int, node long, next int"


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every prefix of at least DEPTH letters of a word read forwards and backwards, with the letter that follows it, 0 at its end."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    for batch in batches:
        out = []
        for number, word in zip(batch.column("number").to_pylist(), batch.column("word").to_pylist()):
            for way, letters in ((0, word), (1, word[::-1])):
                node = xxhash.xxh64(letters[:DEPTH].encode(), way)
                for depth in range(DEPTH, len(letters) + 1):
                    after = letters[depth : depth + 1]
                    out.append((number, way, depth, node.intdigest() - (1 << 63), ord(after) if after else 0))
                    node.update(after.encode())
                if len(out) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in _SPOT.split(", ")])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in _SPOT.split(", ")])


def _one_edit(a: Column, b: Column) -> Column:
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1)


#: Stands for a word's end among the letters that may follow a node.
_END = "."


def _trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(number, word, n) to the edges (node, label, child, near, near_n, first, after) and the first states of every word and way.

    An edge ends in a node (child) or in a word (near). ``first`` is the label's first letter, ``after`` all those that may follow it.
    """
    spots = written(words.select("number", "word").mapInArrow(_spots, _SPOT), "spots")
    forks = spots.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b")).filter("a <> b").select("node")
    paths = spots.join(forks.hint("shuffle_hash"), "node").groupBy("number", "way").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))
    letters = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
    paths = written(paths.join(words, "number").withColumn("letters", letters), "paths")

    size = F.size("path")
    text = lambda a, b: F.substring(F.col("letters"), a + 1, b - a)
    inner = F.zip_with(F.slice("path", F.lit(1), size - 1), F.slice("path", F.lit(2), size - 1), lambda a, b: F.struct(a.node.alias("node"), text(a.depth, b.depth).alias("label"), b.node.alias("child")))
    inner = paths.select(F.explode(inner).alias("e")).select("e.*").distinct()
    last = F.element_at("path", -1)
    ends = paths.select(last.node.alias("node"), text(last.depth, F.length("letters")).alias("label"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    edges = written(inner.unionByName(ends, allowMissingColumns=True).withColumn("first", F.substring("label", 1, 1)), "edges")
    letter = F.when(F.col("first") == "", _END).otherwise(F.col("first"))
    after = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(letter), "").alias("after"))
    # Edges to words have no child, so they stay out of the join: they would all wait at one key.
    further = edges.filter("child is not null").join(after.hint("shuffle_hash"), "child")
    edges = written(further.unionByName(edges.filter("child is null"), allowMissingColumns=True), "edges-after")

    half = F.floor(F.length("word") / 2).cast("int")
    shared = F.when(F.col("way") == 0, half).otherwise(F.length("word") - half)
    start = F.coalesce(F.array_max(F.filter("path", lambda p: p.depth <= F.col("shared"))), F.get("path", F.lit(0)))
    first = paths.withColumn("shared", shared).withColumn("start", start)
    first = first.select("word", "n", text(F.col("start.depth"), F.length("letters")).alias("rest"), F.greatest(F.lit(0), F.col("shared") - F.col("start.depth")).alias("firm"), F.col("start.node").alias("node"), F.lit(0).alias("edits"))
    states = written(first, "states")
    discard(spots, paths)
    return edges, states


def _level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States to those after one edge more, and the neighbours that are reached (near is not null).

    ``firm`` letters of the rest must match before an edit may be spent. A state with a spent edit is kept only if what is left of the
    word begins with a letter that may follow. Edges are the side that is hashed: a node has one for each letter at most, so
    however many states wait at a node, that side stays small and the other can be split.
    """
    rest, label, n, edges = F.col("rest"), F.col("label"), F.length("label"), edges.hint("shuffle_hash")
    fresh = states.filter("edits = 0").join(edges, "node").filter((F.col("firm") == 0) | (F.substring(label, F.lit(1), F.col("firm")) == F.substring(rest, F.lit(1), F.least("firm", n))))
    spent = states.filter("edits = 1").withColumn("first", F.substring("rest", 1, 1)).join(edges, ["node", "first"])

    # Letters of the rest that an edge takes, and whether an edit is spent. Where the first letters differ, that is the edit.
    part = lambda a, k: F.substring(rest, F.lit(a), k)
    alike, tail = F.col("first") == part(1, F.lit(1)), F.substring(label, F.lit(2), n)
    edit = lambda k, moved: F.when(alike, F.levenshtein(label, part(1, k), 1) == 1).otherwise(moved)
    ways = [
        (n, 0, alike & (part(1, n) == label)),
        (n, 1, edit(n, tail == part(2, n - 1))),
        (n + 1, 1, edit(n + 1, label == part(2, n))),
        (n - 1, 1, edit(n - 1, tail == part(1, n - 1))),
    ]
    option = lambda k, edits, ok: F.when((F.length(rest) >= k) & ok, F.struct(k.alias("k"), F.lit(edits).alias("edits")))
    options = [option(k, edits, F.col("child").isNotNull() & ok) for k, edits, ok in ways]
    options.append(option(F.lit(0), 1, F.col("child").isNull() & _one_edit(label, rest)))
    moved = fresh.withColumn("o", F.explode(F.array(*options))).filter("o is not null")
    follow = spent.filter(F.when(F.col("child").isNull(), label == rest).otherwise(F.startswith(rest, label))).withColumn("o", F.struct(n.alias("k"), F.lit(1).alias("edits")))
    kept = ["word", "n", "rest", "firm", "child", "after", "o", "near", "near_n"]
    on = moved.select(kept).union(follow.select(kept))
    on = on.select("word", "n", F.substring(rest, F.col("o.k") + 1, F.length(rest)).alias("rest"), F.greatest(F.lit(0), F.col("firm") - F.col("o.k")).alias("firm"), F.col("child").alias("node"), F.col("o.edits").alias("edits"), "near", "near_n", "after")
    next_letter = F.when(rest == "", _END).otherwise(F.substring(rest, 1, 1))
    return on.filter(F.col("node").isNull() | (F.col("edits") == 0) | (F.instr(F.col("after"), next_letter) > 0)).drop("after")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n) without repeats, of words of LENGTH or more, to all (word, n, near, near_n) that are one edit apart, both ways."""
    numbered = written(words.select("word", "n", F.monotonically_increasing_id().alias("number")), "words")
    edges, states = _trie(numbered)
    levels = []
    while not states.isEmpty():
        level = written(_level(states, edges), "level")
        levels.append(level)
        states = level.filter("node is not null").drop("near", "near_n")
    none = words.sparkSession.createDataFrame([], "word string, n long, near string, near_n long")
    for level in levels:
        none = none.union(level.filter("near is not null").select("word", "n", "near", "near_n"))
    found = written(none.filter(_one_edit(F.col("word"), F.col("near"))).distinct(), "neighbours")
    discard(numbered, edges, *levels)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without cycles to (word, root), by doubling: the rounds are the logarithm of the longest chain."""
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = written(reached.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(reached)
        reached = joined.drop("moved")
        reached._tw_path = joined._tw_path
        if joined.filter("moved").isEmpty():
            return reached


def variant_groups(words: DataFrame, factor: float = FACTOR) -> DataFrame:
    """(word, n) to (word, form, root, n, n_near, form_n).

    A word's form is its near word of most occurrences, if these are at least ``factor`` times its own; root is the last of
    the forms that follow.
    """
    words = written(words, "vocabulary")
    near = neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(near, "word", "left").withColumn("kept", -F.col("best.less") >= factor * F.col("n"))
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("kept"), F.col("best.near")).alias("form"), F.when(F.col("kept"), -F.col("best.less")).alias("form_n"))
    judged = written(judged, "judged")
    named = judged.join(roots(judged.filter("form is not null").select("word", "form")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return variant_groups(word_counts(read(spark, sf_dir, "documents"), damage=True))


# The CRC is taken bit by bit; two words are near if they are equal without the letter at one place, or one is the other without a letter.
SQL = {
    "op11_spelling_variants": r"""WITH RECURSIVE x AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
    y AS MATERIALIZED (SELECT run, count(*) AS n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c), -1, -1, -1, -1, -1, -1, -1, -1] ELSE [195, -1, -1, -1, -1, -1, -1, -1, -1, unicode(c) - 64, -1, -1, -1, -1, -1, -1, -1, -1] END)) AS steps FROM x GROUP BY doc_id, run),
    h AS MATERIALIZED (SELECT run, n, xor(list_reduce(steps, lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM y),
    v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n AS times FROM h),
    w AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
    d AS MATERIALIZED (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM w),
    c AS MATERIALIZED (SELECT word, n, i, CASE WHEN i = length(word) THEN word ELSE substr(word, 1, i::INT) || substr(word, i::INT + 2) END AS part, i = length(word) AS whole FROM d),
    p AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM c a JOIN c b USING (part) WHERE a.word <> b.word AND (a.whole <> b.whole OR a.i = b.i)),
    k AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n FROM p GROUP BY word),
    b AS (SELECT p.word, min(near) AS best FROM p JOIN k ON p.word = k.word AND near_n = best_n GROUP BY p.word),
    f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM w LEFT JOIN k USING (word) LEFT JOIN b USING (word)),
    r AS (SELECT word, word AS here, 0 AS steps FROM f UNION ALL SELECT r.word, f.form, steps + 1 FROM r JOIN f ON f.word = r.here WHERE form IS NOT NULL),
    z AS (SELECT word, arg_max(here, steps) AS root FROM r GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)"""
}

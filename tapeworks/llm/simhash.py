"""SimHash near-dedup: 64-bit fingerprints that differ in at most two bits, found through Golay-code fuzzy hashing.

The fingerprint is cut into segments of 22, 21 and 21 bits. Read as a word of 23 bits, a segment is decoded by the perfect
binary Golay code to the indices (12 bits) of all codewords within distance 4: one if the nearest is within 2, six if it is
at 3. Any two words within distance 2 share such an index. With at most two errors one of three segments has none
(pigeonhole), so two linked fingerprints share a key (segment i exact, Golay index of segment i+1) for some i: about 14
keys of 36 bits for each fingerprint. Keys are joined and every pair is verified on all 64 bits.

Only distinct fingerprints take part, so copies cost nothing. A key that more than ``bucket`` fingerprints hold would make
too many pairs: its members are linked through the words within distance 1 of them instead. Two fingerprints differ in two
bits or fewer exactly if they share such a word, at most 65 fingerprints share one, and all that share one are linked, so a
star from the least is enough. No link is lost either way.

Similarity. Two bits of 64 are far too few for a given similarity of the shingle sets (at 0.8 fingerprints differ in 4 to 14
bits), so with ``similarity`` Golay keys only propose pairs. Others are proposed by min-wise sketches of the same shingle hashes,
cut into bands: texts that share a band and whose estimate is at most four deviations under the limit. Proposals are chained to
clusters, and inside a cluster the whole sets of hashes decide: every link has the exact Jaccard similarity, and every pair of a
cluster whose estimate allows it is verified unless both texts are linked already.

Large clusters are dealt to blocks of bounded size, and all members meet a few centres first. What the centres leave apart is found by
its rare shingles: with the shingles of a cluster in the order of their frequency in it, two sets of similarity s have one in common
that is among the size - ceil(s * size) + 1 rarest of the larger and the size - ceil(2 s / (1 + s) * size) + 1 rarest of the smaller
set. So only texts that meet in such a shingle, and are not linked yet, are compared; what a template gives to all its pages is
none, unless the pages are alike. Shingles that stand for the same texts count once. A large band, whose texts need not be alike
at all, is not compared: its texts are proposed as one chain. Blocks give only the links that join unlinked texts (a forest),
never their pairs. So no link is lost and output is linear.

Equal sets of hashes are one node. Sets are told apart by 128 bits; a node's number is that of its row in the table of distinct sets.

Defined results: words are split at ``[\\x20\\x09-\\x0D]``, A-Z lower-cased. A text with fewer words than a shingle has one
shingle, all of it; a null or empty text has fingerprint zero and is linked like any other. Rows with equal ids all appear;
a null id never is a representative unless its whole group has none. ``one_of_each`` keeps rows, not ids: of each group the row
of the smallest id (nulls last), so rows with null or equal ids and unlike texts all stay; of rows equal in id and text one
stays, whatever their other columns. Other columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discard, from_row, id_key, with_row, written
from .components import components

SEED = 42
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code of length 23.
GOLAY = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints of a key that are compared with each other; beyond it they are linked through shared neighbours.
BUCKET = 64
_CHUNK = 1 << 16
#: Sketches: ranges, ranges of a band, and what an empty range holds. 128 ranges estimate 0.8 with a deviation of 0.035.
BINS, ROWS, EMPTY = 128, 5, np.uint32(0xFFFFFFFF)
#: Deviations of the estimate under the limit that a candidate may have: 0.659 for 0.8.
FAR = 4
#: A block holds about so many texts or bytes of their hashes at most, unless a single text has more.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Of more than a block: how many centres all are compared with, and how many of the likest to these.
CENTRES, HUBS = 16, 4


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the values of each of three bytes, and by remainder the error patterns to try and their number."""
    rest = []
    for bit in range(24):
        x = 1 << bit
        for k in range(bit, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        rest.append(x)
    of_byte = np.zeros((3, 256), np.int64)
    for b in range(24):
        of_byte[b // 8, np.arange(256) >> (b % 8) & 1 == 1] ^= rest[b]
    leader, fours = {0: (0, 0)}, {}
    for weight in range(1, 5):
        for bits in combinations(range(23), weight):
            s = e = 0
            for b in bits:
                s, e = s ^ rest[b], e | 1 << b
            if weight < 4:
                leader[s] = (e, weight)
            elif leader[s][1] == 3:
                fours.setdefault(s, []).append(e)
    patterns, count = np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for s, (e, weight) in leader.items():
        found = [e, *fours.get(s, [])] if weight == 3 else [e]
        patterns[s], count[s] = (found * 6)[:6], len(found)
    return of_byte, patterns, count


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: (n, 6) codeword indices, and how many of the six differ."""
    of_byte, patterns, count = _golay()
    s = of_byte[0, words & 255] ^ of_byte[1, words >> 8 & 255] ^ of_byte[2, words >> 16]
    return (words[:, None] ^ patterns[s]) >> 11, count[s]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unsigned fingerprints: (row, key) of all their keys."""
    cut = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(cut):
        index, count = golay_indices(cut[(i + 1) % 3])
        row, col = np.nonzero(np.arange(6) < count[:, None])
        rows.append(row)
        keys.append((i << 34) | (exact[row] << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Unsigned XXH64 of every shingle of a UTF-8 text, repeats included."""
    parts = text.lower().split()  # of bytes: A-Z only, and exactly the six white space characters
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words or None].tolist()
    ends, hashed = ends[words - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.array([hashed(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Unsigned; a bit is 1 if it is set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(h), _CHUNK):
        total += np.unpackbits(h[a : a + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.sum(np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)), where=2 * total > len(h), dtype=np.uint64))


def sketch(h: np.ndarray) -> np.ndarray:
    """One-permutation min-wise sketch of the set of hashes: the least hash of each of BINS equal ranges, EMPTY without one."""
    h = np.sort(h)
    at = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    least = np.append(h, np.uint64(0))[at]
    there = (at < len(h)) & (least >> np.uint64(57) == np.arange(BINS, dtype=np.uint64))
    return np.where(there, (least & np.uint64(0xFFFFFFFF)).astype(np.uint32), EMPTY)


def band_keys(sk: np.ndarray) -> list[int]:
    """Signed keys of the sketch's bands; an empty range borrows from the next one."""
    full = np.flatnonzero(sk != EMPTY)
    if not len(full):
        return []
    dense = sk[full[np.searchsorted(full, np.arange(BINS)) % len(full)]].tobytes()
    return [xxhash.xxh64_intdigest(dense[4 * ROWS * b : 4 * ROWS * (b + 1)], b) - (1 << 63) for b in range(BINS // ROWS)]


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(shingle_hashes(t.as_py() or b"", words)) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["_tw_id", "_tw_fp"])


def _sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, sketches, same, sizes = [], [], [], []
        for t in batch.column(1):
            h = shingle_hashes(t.as_py() or b"", words)
            fps.append(fingerprint(h))
            h = np.unique(h)
            sketches.append(sketch(h).tobytes())
            same.append(xxhash.xxh3_128_digest(h.tobytes()))
            sizes.append(len(h))
        fps = pa.array(np.array(fps, np.uint64).view(np.int64))
        arrays = [batch.column(0), fps, pa.array(sketches, pa.binary()), *_halves(same), pa.array(sizes, pa.int64()), batch.column(2)]
        yield pa.RecordBatch.from_arrays(arrays, ["_tw_id", "_tw_fp", "sketch", "high", "low", "size", "_tw_hash"])


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """Of 128 bits each."""
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Texts to their distinct shingle hashes, and the 128 bits of these as in ``_sketches``."""
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py() or b"", words)).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*_halves([xxhash.xxh3_128_digest(h) for h in sets]), pa.array(sets, pa.binary())], ["high", "low", "hashes"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [band_keys(np.frombuffer(x.as_py(), np.uint32)) for x in batch.column(1)]
        nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array([k for x in keys for k in x], pa.int64()), pa.array(nodes, pa.int64())], ["k", "node"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for a in range(0, len(fps), _CHUNK):
            row, key = golay_keys(fps[a : a + _CHUNK].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[a : a + _CHUNK][row])], ["k", "fp"])


def fingerprints(docs: DataFrame, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_tw_id, _tw_fp), one row for each document; the fingerprint as a signed long."""
    source = docs.select(F.col(doc_id).cast("long").alias("_tw_id"), F.col(text).cast("string").cast("binary").alias("_tw_text"))
    return source.mapInArrow(lambda it: _fingerprints(it, words), "_tw_id long, _tw_fp long")


def links(distinct_fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(fp) without repeats to links (a, b) that join all fingerprints within two bits, directly or in steps."""
    held = written(distinct_fps.select("fp").mapInArrow(_keys, "k long, fp long"), "golay-keys")
    sizes = held.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    held = written(held.join(sizes, "k"), "golay-buckets")
    few, many = held.filter(F.col("n") <= bucket), held.filter(F.col("n") > bucket).select("fp").distinct()
    other = few.select("k", F.col("fp").alias("b"))
    pairs = few.withColumnRenamed("fp", "a").join(other, "k").filter("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    shared = many.select("fp", F.explode(near).alias("w")).groupBy("w").agg(F.collect_set("fp").alias("s")).filter("size(s) > 1")
    stars = shared.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def _like(x: pa.StructArray, y: pa.StructArray, limit: float) -> np.ndarray:
    """Estimated similarities of two blocks: equal ranges among those that are not empty in both; 0 below ``limit``."""
    sk = [np.ascontiguousarray(np.frombuffer(b"".join(b.field("sketch").to_pylist()), np.uint32).reshape(-1, BINS).T) for b in (x, y)]
    equal = np.zeros((len(x), len(y)), np.uint8)
    for a, b in zip(*sk):
        equal += a[:, None] == b
    empty = [(s == EMPTY).astype(np.float32) for s in sk]
    both = empty[0].T @ empty[1]
    like = (equal - both) / np.maximum(1, BINS - both)
    return np.where(like >= limit, like, 0)


def _column(block: pa.StructArray, name: str) -> np.ndarray:
    return block.field(name).to_numpy(zero_copy_only=False)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    both = np.sort(np.concatenate([x, y]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common) if len(both) else 1.0


def _forest(batches: Iterator[pa.RecordBatch], limit: float, similarity: float | None) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks x and y (without y, x and x) to links that join the roots of their like texts.

    Alike are texts with an estimate of at least ``limit``, whose sets of hashes have at least ``similarity`` if it is given.
    Each joined root is linked to the least of those it is joined with, so the links of a pair of blocks are stars.
    """
    for batch in batches:
        out_a, out_b = [], []
        for r in range(batch.num_rows):
            x = batch.column("x")[r].values
            y = batch.column("y")[r].values if "y" in batch.schema.names else x
            a, b = _column(x, "node"), _column(y, "node")
            like = _like(x, y, limit)
            like[a[:, None] == b] = 0
            if y is x:
                like = np.triu(like)
            roots, label = np.unique(np.concatenate([_column(x, "root"), _column(y, "root")]), return_inverse=True)
            own = label.copy()
            row, col = label[: len(a)], label[len(a) :]  # views: a merge changes both
            sets = [[np.frombuffer(h.as_buffer(), np.uint64) for h in s.field("hashes")] for s in (x, y)] if similarity else None
            every = np.arange(len(a))
            while True:  # each time the likest open partner of every text of x
                open_ = np.where(row[:, None] != col, like, 0)
                best = open_.argmax(1)
                at = np.flatnonzero(open_[every, best] > 0)
                if not len(at):
                    break
                for i, j in zip(at.tolist(), best[at].tolist()):
                    like[i, j] = 0
                    if row[i] != col[j] and (sets is None or jaccard(sets[0][i], sets[1][j]) >= similarity - 1e-9):
                        label[label == max(row[i], col[j])] = min(row[i], col[j])
            joined_at = np.unique(own[own != label])
            of = np.zeros(len(roots), np.int64)
            of[own] = label
            out_a.append(roots[joined_at])
            out_b.append(roots[of[joined_at]])
        ends = [pa.array(np.concatenate([np.empty(0, np.int64), *out])) for out in (out_a, out_b)]
        yield pa.RecordBatch.from_arrays(ends, ["a", "b"])


def _scores(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """How like each text of a block x is to the centres y, summed."""
    for batch in batches:
        for r in range(batch.num_rows):
            x = batch.column("x")[r].values
            score = _like(x, batch.column("y")[r].values, limit).sum(1, dtype=np.float64)
            k = np.full(len(x), batch.column("k")[r].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), x.field("node"), pa.array(score)], ["k", "node", "score"])


def _slot(weight):
    return F.pmod(F.xxhash64("node"), F.ceil(weight))


def _met(members: DataFrame, limit: float, similarity: float) -> DataFrame:
    """(k, node, root, rare, sketch, hashes, w) to links inside each k between texts of unlike roots, one of them ``rare``.

    Members of more than a block meet in pairs of blocks: of one root each for roots that fill one, else mixed. Blocks of the same
    single root do not meet, nor do two blocks without rare members.
    """
    names = ["node", "root", "sketch", "hashes"]
    collect = F.collect_list(F.struct(*names))
    forest = lambda pairs: pairs.mapInArrow(lambda it: _forest(it, limit, similarity), "a long, b long")
    held = written(members.join(members.groupBy("k").agg(F.sum("w").alias("all")), "k"), "met")
    small = forest(held.filter("all <= 1").groupBy("k").agg(collect.alias("x")).select("x"))
    large = held.filter("all > 1")
    counts = large.groupBy("k", "rare", "root").agg(F.sum("w").alias("c"))
    open_ = counts.groupBy("k", "rare").agg(F.sum(F.when(F.col("c") <= 1, F.col("c"))).alias("mixed"))
    dealt = large.join(counts.join(open_, ["k", "rare"]), ["k", "rare", "root"]).withColumn("whole", F.when(F.col("c") > 1, F.col("root")))
    dealt = dealt.withColumn("slot", F.when(F.col("whole").isNull(), _slot(F.col("mixed"))).otherwise(_slot(F.col("c"))))
    blocks = dealt.groupBy("k", "rare", "whole", "slot").agg(collect.alias("x"))
    blocks = written(blocks.withColumn("block", F.xxhash64("k", "rare", "whole", "slot", F.col("whole").isNull())), "root-blocks")
    heads = blocks.select("k", "rare", "block", "whole")
    meet = heads.alias("p").join(heads.alias("q"), "k").filter("p.block <= q.block and (p.rare or q.rare) and not coalesce(p.whole = q.whole, false)")
    meet = meet.select(F.col("p.block").alias("px"), F.col("q.block").alias("qx"))
    pairs = meet.join(blocks.select(F.col("block").alias("px"), "x"), "px").join(blocks.select(F.col("block").alias("qx"), F.col("x").alias("y")), "qx").select("x", "y")
    out = written(small.union(forest(pairs)), "links-of-rare-shingles")
    discard(held, blocks)
    return out


_SHINGLE = "k long, node long, root long, size long, h long"


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hash of each set."""
    for batch in batches:
        sets = [np.frombuffer(h.as_buffer(), np.int64) for h in batch.column("hashes")]
        lengths = [len(h) for h in sets]
        own = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), lengths)) for c in ("k", "node", "root", "size")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], [f.split()[0] for f in _SHINGLE.split(", ")])


def rare_links(members: DataFrame, limit: float, similarity: float) -> DataFrame:
    """(k, node, root, size, sketch, hashes, w) to links (a, b) of at least this similarity that join the roots of each k.

    A set's keys are its rarest shingles, by their frequency in k, as the module says: those that any similar set of at most its size
    has, the first of which (``rare``) are met by similar sets of at least its size. Keys that are nobody's rare ones, or that only texts
    of one root have, are left out, and of keys with the same texts one stays.
    """
    shingles = written(members.select("k", "node", "root", "size", "hashes").mapInArrow(_shingles, _SHINGLE), "shingles")
    frequency = shingles.groupBy("k", "h").agg(F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("shared"))
    ranked = shingles.join(frequency, ["k", "h"]).groupBy("k", "node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h", "shared"))).alias("s"))
    among = lambda share: (F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1).cast("int")
    keys = ranked.select("k", "node", "root", among(2 * similarity / (1 + similarity)).alias("first"), F.posexplode(F.slice("s", F.lit(1), F.least(F.greatest(among(similarity), F.lit(1)), F.size("s")))).alias("at", "e"))
    keys = written(keys.filter("e.shared").select("k", "node", "root", (F.col("at") < F.greatest("first", F.lit(1))).alias("rare"), F.col("e.h").alias("h")), "rare-shingles")
    # Two hashes of the texts that have a key stand for them.
    same = [F.bit_xor(F.xxhash64("node", "rare", F.lit(seed))).alias(f"s{seed}") for seed in (1, 2)]
    groups = keys.groupBy("k", "h").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("rare").alias("any"), *same).filter("n > 1 and lo < hi and any")
    groups = groups.groupBy("k", "n", "s1", "s2").agg(F.min("h").alias("h")).select("k", "h")
    named = keys.join(groups, ["k", "h"]).select(F.xxhash64("k", "h").alias("g"), "k", "node", "rare")
    payload = members.select("k", "node", "root", "sketch", "hashes", "w")
    out = _met(named.join(payload, ["k", "node"]).drop("k").withColumnRenamed("g", "k"), limit, similarity)
    discard(shingles, keys)
    return out


def joined(members: DataFrame, limit: float, similarity: float | None = None, block: int = BLOCK) -> DataFrame:
    """(k, node, sketch, and with ``similarity`` size and hashes) to links (a, b) inside each k.

    With ``similarity`` they join all that is alike in a k, directly or in steps, as of ``_forest``. Without, they are proposals:
    a k of more than a block is one chain.
    """
    exact = similarity is not None
    share = F.lit(1 / block) + (F.col("size") * (8 / BLOCK_BYTES) if exact else 0)
    members = members.withColumn("w", share)
    names = ["node", "root", "sketch", *["hashes"] * exact]
    collect = F.collect_list(F.struct(*names))
    forest = lambda pairs: pairs.mapInArrow(lambda it: _forest(it, limit, similarity), "a long, b long")

    sizes = members.groupBy("k").agg(F.count("*").alias("n"), F.sum("w").alias("all")).filter("n > 1")
    held = written(members.withColumn("root", F.col("node")).join(sizes, "k"), "members")
    small, large = held.filter("all <= 1"), held.filter("all > 1")
    found = written(forest(small.groupBy("k").agg(collect.alias("x")).select("x")), "links-of-small")
    if large.isEmpty():
        discard(held)
        return found
    if not exact:
        chained = large.join(large.groupBy("k").agg(F.min("node").alias("a")), "k").filter("node <> a")
        chained = written(chained.select("a", F.col("node").alias("b")).distinct(), "links-of-large")
        discard(held)
        return found.union(chained)

    blocks = written(large.groupBy("k", _slot(F.col("all")).alias("slot")).agg(collect.alias("x")).select("k", "x"), "blocks")
    first = large.groupBy("k", F.pmod("node", F.lit(CENTRES)).alias("of")).agg(F.min_by(F.struct(*names), "node").alias("c"))
    first = written(first.groupBy("k").agg(F.collect_list("c").alias("y")), "centres")
    scored = blocks.join(first, "k").select("k", "x", "y").mapInArrow(lambda it: _scores(it, limit), "k long, node long, score double")
    likest = scored.groupBy("k", F.pmod("node", F.lit(HUBS))).agg(F.max_by("node", "score").alias("node")).select("k", "node")
    hubs = large.join(likest, ["k", "node"]).groupBy("k").agg(collect.alias("h"))
    centres = written(first.join(hubs, "k").select("k", F.concat("h", F.filter("y", lambda c: ~F.array_contains(F.col("h.node"), c.node))).alias("y")), "centres")
    stars = written(forest(blocks.join(centres, "k").select("x", "y")), "links-of-centres")
    discard(blocks, first, centres)

    # What the centres join has one root now.
    rooted = written(large.select("k", "node").join(components(found.union(stars)), "node", "left").select("k", "node", F.coalesce("root", "node").alias("root")), "rooted")
    open_ = rooted.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("k")
    apart = large.drop("root", "n", "all").join(rooted.join(open_, "k"), ["k", "node"])
    rest = rare_links(apart, limit, similarity)
    discard(held, rooted)
    return found.union(stars).union(rest)


def similar(sketches: DataFrame, sets, similarity: float, proposed: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of at least this Jaccard similarity that join all candidates, directly or in steps.

    sketches has (node, sketch, size) without repeats; ``sets`` maps a table of nodes to (node, hashes), without repeats too.
    ``proposed`` has more pairs (a, b) to be verified.
    """
    limit = similarity - FAR * (similarity * (1 - similarity) / BINS) ** 0.5
    bands = written(sketches.select("node", "sketch").mapInArrow(_bands, "k long, node long"), "bands")
    shared = bands.join(bands.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "k")
    likely = joined(shared.join(sketches.select("node", "sketch"), "node"), limit, block=block)
    likely = likely if proposed is None else likely.union(proposed.select("a", "b"))
    clusters = written(components(likely).select("node", F.col("root").alias("k")), "clusters")
    discard(bands)
    hashes = written(sets(clusters.select("node")), "shingle-sets")
    links = joined(clusters.join(sketches.select("node", "sketch", "size"), "node").join(hashes, "node"), limit, similarity, block)
    discard(clusters, hashes)
    return links


def _first(*columns: str):
    """Orders rows of documents: by id, nulls last, then by the text's hash."""
    return F.min(F.struct(F.col("_tw_id").isNull().alias("none"), F.col("_tw_id").alias("id"), *columns))


def _grouped(docs: DataFrame, words: int, text: str, doc_id: str, similarity: float) -> DataFrame:
    """(_tw_id, _tw_hash, _tw_fp, first): documents, and the first of the documents that each is linked to."""
    body = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    source = docs.select(F.col(doc_id).cast("long").alias("_tw_id"), body.alias("_tw_text"), F.xxhash64(body).alias("_tw_hash"))
    kinds = "_tw_id long, _tw_fp long, sketch binary, high long, low long, size long, _tw_hash long"
    each = written(source.mapInArrow(lambda it: _sketches(it, words), kinds), "sketches")
    nodes = each.groupBy("high", "low").agg(_first("_tw_hash").alias("first"), *[F.min(c).alias(c) for c in ("_tw_fp", "sketch", "size")])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-sketches")

    # One text stands for all of a fingerprint: what Golay keys link are pairs of those.
    of = written(nodes.groupBy("_tw_fp").agg(F.min("node").alias("node")), "fingerprints")
    near = links(of.select(F.col("_tw_fp").alias("fp")))
    at = lambda c: of.select(F.col("_tw_fp").alias(c), F.col("node").alias(f"n{c}"))
    proposed = near.join(at("a"), "a").join(at("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    proposed = proposed.union(nodes.select("_tw_fp", F.col("node").alias("a")).join(at("_tw_fp"), "_tw_fp").filter("a <> n_tw_fp").select("a", "n_tw_fp"))

    def sets(wanted: DataFrame) -> DataFrame:
        rows = nodes.join(wanted, "node", "left_semi").select(id_key("first.id").alias("_tw_key"), F.col("first._tw_hash").alias("_tw_hash"))
        texts = source.withColumn("_tw_key", id_key("_tw_id")).join(rows, ["_tw_key", "_tw_hash"], "left_semi")
        found = texts.select("_tw_text").mapInArrow(lambda it: _sets(it, words), "high long, low long, hashes binary")
        return found.join(nodes.join(wanted, "node", "left_semi").select("high", "low", "node"), ["high", "low"]).select("node", "hashes").dropDuplicates(["node"])

    found = similar(nodes.select("node", "sketch", "size"), sets, similarity, proposed)
    rooted = nodes.select("node", "high", "low", "first").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("of_root"))
    named = rooted.join(firsts, "root").select("high", "low", F.col("of_root").alias("first"))
    return each.select("_tw_id", "_tw_hash", "_tw_fp", "high", "low").join(named, ["high", "low"]).drop("high", "low")


def near_duplicates(docs: DataFrame, words: int = 5, text: str = "text", doc_id: str = "doc_id", similarity: float | None = None) -> DataFrame:
    """(_tw_id, _tw_fp, _tw_component): each document with its fingerprint and the smallest id it is linked to.

    Linked are fingerprints within two bits, or with ``similarity`` documents whose sets of shingles have at least this Jaccard
    similarity.
    """
    if similarity is not None:
        return _grouped(docs, words, text, doc_id, similarity).select("_tw_id", "_tw_fp", F.col("first.id").alias("_tw_component"))
    each = written(fingerprints(docs, words, text, doc_id), "fingerprints")
    fps = written(each.groupBy(F.col("_tw_fp").alias("fp")).agg(F.min("_tw_id").alias("least")), "distinct-fps")
    roots = components(links(fps)).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("_tw_component")), "root").select(F.col("fp").alias("_tw_fp"), "_tw_component")
    return each.join(named, "_tw_fp").select("_tw_id", "_tw_fp", "_tw_component")


def one_of_each(docs: DataFrame, words: int = 5, text: str = "text", doc_id: str = "doc_id", similarity: float = 0.8) -> DataFrame:
    """docs with only the first document of each group: that of the smallest id, nulls last."""
    groups = _grouped(docs, words, text, doc_id, similarity)
    stay = groups.filter(F.col("_tw_id").eqNullSafe(F.col("first.id")) & (F.col("_tw_hash") == F.col("first._tw_hash")))
    stay = stay.select(id_key("_tw_id").alias("_tw_key"), "_tw_hash").distinct()
    body = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    rows = with_row(docs, _tw_key=id_key(doc_id), _tw_hash=F.xxhash64(body))
    return from_row(rows.join(stay, ["_tw_key", "_tw_hash"], "left_semi").dropDuplicates(["_tw_key", "_tw_hash"]), docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = near_duplicates(read(spark, sf_dir, "documents"), words=3)
    return out.select(F.col("_tw_id").alias("doc_id"), F.lower(F.lpad(F.hex("_tw_fp"), 16, "0")).alias("fingerprint"), F.col("_tw_component").alias("component_id"))

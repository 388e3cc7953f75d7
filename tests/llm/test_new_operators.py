"""Spelling variants, exact top-k and periodic runs against brute force, with edge cases."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tapeworks.llm import runs, topk, variants


# Spelling variants ------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def grouped(n):
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        if best is not None and n[best] >= 2 * n[a]:
            form[a] = best

    def root(a):
        return root(form[a]) if a in form else a

    return {(a, form.get(a), root(a), n[a], len(near[a]), n.get(form.get(a))) for a in n}


def test_variant_groups(spark):
    rng = random.Random(3)
    base = ["colour", "letter", "ábéçédé", "ÿÿÿÿÿ", "aaaaa", "aaaaaa", "aaaaaaa", "abababab", "bababab"]
    n = {}
    for _ in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            k, c = rng.randrange(len(w) + 1), rng.choice("abcolouré")
            w[k : k + rng.randrange(2)] = [c] if rng.random() < 0.7 else []
        if len(w) >= 5:
            n["".join(w)] = rng.choice([3, 4, 7, 9, 20, 50, 200])
    long = "".join(rng.choice("abc") for _ in range(3000))
    n |= {long: 5, long[:1500] + "d" + long[1500:]: 12, long[1:]: 40, long[:-1] + "é": 90}
    got = variants.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == grouped(n)
    assert variants.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def test_words_of_documents(spark):
    rows = [(k, "Straße ÀÉÎÕü colour, Colour; COLOUR ×÷ ab " * 3 + f"row{k}x", "en") for k in range(60)]
    rows += [(None, "colour colour colour", None), (7, None, None), (7, "", "x"), (9, "z" * 40000 + " " + "z" * 40000 + " " + "z" * 40000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = {}
    for key, text, _ in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
                want[word] = want.get(word, 0) + 1
            run = ""
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert {(r.word, r.n) for r in variants.word_counts(docs, damage=True).collect()} == set(want.items())
    assert "colour" in want and "zzzzz" not in want and len(want) > 2


# Exact top-k ------------------------------------------------------------------------------------------------------------


def best(rows, queries, k):
    whole = lambda v: [int(np.floor(1024.0 * x)) for x in v]
    usable = [(n, i, whole(v)) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in usable:
        if i in queries:
            found = [(-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63)), j) for m, j, w in usable if m != n and len(w) == len(v)]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("group", [8192, 40])
def test_top_k(spark, monkeypatch, group):
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "QUERIES", group)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 6))
    rows = [(int(i), (centres[i % 8] + rng.normal(size=6) * 0.05).tolist()) for i in rng.permutation(300)]
    hot = rng.normal(size=6).tolist()
    rows += [(1000 + i, hot) for i in range(120)] + [(5000, [0.0] * 6), (5001, [-0.0] * 6), (5002, [3.0e6] * 6), (5003, [-2.5e9, 4.0e9, 1.0, 0.0, 1.0, 2.0])]
    rows += [(None, hot), (6000, None), (6001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (6002, [float("nan")] * 6), (6003, [float("inf")] * 6)]
    rows += [(6100, []), (6101, []), (6200, [1.0, 2.0]), (6201, [2.0, 1.0]), (6201, [0.5, 1.0]), (20, rows[3][1]), (20, rows[3][1])]
    queries = {20, 100, 200, 1000, 1100, 1119, 5000, 5002, 5003, 6100, 6200, 6201}
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, score int, square double")
    got = topk.top_k(table, table.filter(table.vec_id.isin(*queries)), 10)
    assert sorted(map(tuple, got.collect())) == best(rows, queries, 10)


def test_top_k_of_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, empty).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, one).count() == 0
    assert topk.top_k(one, empty).count() == 0 and topk.top_k(empty, one).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 16)) * 1024)
    index = topk._Index({16: x[:100]}, 3)
    table, squares, _, _ = index.entries(x, 16)
    scores = x @ x.T
    for q in range(50):
        gap = np.abs(table - table[q]).max(1)
        assert (topk._bound(squares[q], squares, gap) >= scores[q]).all()
    assert (np.sort(scores, axis=1)[:, -4] >= index.thresholds(x, squares, 16)).all()
    assert len(topk.choose_pivots(np.ones((50, 4)))) == 1


# Periodic runs ----------------------------------------------------------------------------------------------------------


def plain_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and i > s:
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=70), st.integers(0, 70), st.integers(1, 20), st.integers(0, 90))
def test_runs(words, at, period, tail):
    words = words + [words[at % len(words) + (k % period) % (len(words) - at % len(words))] for k in range(tail)] if words else words
    got = [tuple(r) for r in runs.find_runs(np.array(words, np.int64)).tolist()]
    assert got == sorted(plain_runs(words), key=lambda r: (r[0], r[2]))


def test_lce():
    rng = np.random.default_rng(4)
    for n in (1, 2, 30, 31, 32, 400):
        w = np.resize(rng.integers(1, 3, 37), n)
        i, j = (rng.integers(0, n + 1, 300) for _ in "ij")
        i, j = i[i != j], j[i != j]
        want = [next((k for k in range(n) if max(a, b) + k >= n or w[a + k] != w[b + k]), 0) for a, b in zip(i, j)]
        assert runs.Lce(w.astype(np.int64))(i, j).tolist() == want


def test_cover_has_all_differences():
    assert {(a - b) % runs.MOD for a in runs.COVER for b in runs.COVER} == set(range(runs.MOD))


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdef") * rng.randrange(1, 3) for _ in range(rng.randrange(120))) for _ in range(240)]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, "x " * 9, None), (900, None, "a"), (901, "", "b"), (902, " \n\t", "c"), (3, "again again again again again again\nend", "d"), (904, "long words " * 20000, "e")]
    spark.createDataFrame(rows, "doc_id long, text string, period string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text, _ in rows:
        w = (text or "").split()
        h, n = zlib.crc32(str(key).encode()) if key is not None else 1, len((text or "").split())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = [(0, 40000, 2)] if key == 904 else plain_runs(w)
        if key == 904 and h % 10 == 0:
            continue
        found.sort(key=lambda r: (r[0], r[2]))
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        listed, stay = "".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(x for i, x in enumerate(w) if i not in gone)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((key, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], digest(listed), digest(stay)))
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, want)) == sorted(map(repr, got))
    assert sum(r[1] for r in want) > 10


def test_collapse(spark):
    rows = [(1, "a b a b a b a b  c", 5), (2, None, 1), (None, "", 3), (2, "x\n y", 4)]
    out = {r.n_dropped: r for r in runs.collapse(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()}
    assert out[6].text == "a b c" and [tuple(r) for r in out[6].runs] == [(0, 8, 2)]
    kept = runs.collapse(spark.createDataFrame(rows, "doc_id long, text string, runs int"), shorten=False)
    assert {r.text for r in kept.collect()} == {"a b a b a b a b  c", None, "", "x\n y"}
    assert runs.collapse(spark.createDataFrame([], "doc_id long, text string")).count() == 0

"""The corpus pipeline on the smallest table, against a plain restatement of every stage."""

import collections
import os
import re
import zlib

import numpy as np
import pytest
import regex
from test_operators import bm25_shares, brute_components, js_distance, shingles

import corpus_pipeline
from tapeworks.llm import common, decontam, packing, quality

DATA = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def good(text, lang):
    w = words_of(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    if len(w) < 10 or 100 * len(covered) > 20 * len(w):
        return False
    if len(w) < quality.MIN_WORDS or sum(map(len, w)) < quality.MIN_CHARS or lang not in quality.COMMON:
        return True
    rest = regex.sub(r"[\p{Ll}\x20\x09-\x0D]+", "", text)
    classes = [len(regex.findall(p, rest)) for p in quality.CLASSES.values()]
    classes = [sum(map(len, w)) - len(rest), *classes, len(rest) - sum(classes)]
    listed = [w.count(x) for x in quality.COMMON[lang]]
    shares = quality.WORD_SHARES[lang]
    far = js_distance([*listed, len(w) - sum(listed)], [*shares, 1000 - sum(shares)])
    return js_distance(classes, quality.CLASS_SHARES[lang]) <= quality.MAX_CLASS_DISTANCE and far <= quality.MAX_WORD_DISTANCE


def without_shared_lines(docs):
    key = lambda line: line.strip(WHITE).translate(str.maketrans(common.UPPER, common.LOWER))
    held = collections.defaultdict(set)
    for k, (text, _) in docs.items():
        for line in (text or "").split("\n"):
            held[key(line)].add(k)
    gone = lambda line, k: len(key(line)) >= 20 and len(held[key(line)]) >= 3 and max(held[key(line)]) != k
    return {k: ("\n".join(x for x in (text or "").split("\n") if not gone(x, k)), lang) for k, (text, lang) in docs.items()}


def first_of_each(docs):
    ids = sorted(docs)
    lower = lambda t: words_of(t.translate(str.maketrans(common.UPPER, common.LOWER)))
    sets = [shingles(lower(docs[k][0] or "")) for k in ids]
    root = brute_components(sets, 0.8)
    return {ids[k]: docs[ids[k]] for k in range(len(ids)) if root[k] == k}


def clean(text):
    return [w for w in (x.strip(decontam.PUNCTUATION) for x in text.lower().split())]


def leaks(text, items, shares, stride):
    w = clean(text or "")
    grams = lambda x: {tuple(x[i : i + min(3, len(x))]) for i in range(len(x) - min(3, len(x)) + 1)}
    for a in range(0, len(w), stride):
        there = set(w[a : a + 2 * stride])
        for (question, answer), share in zip(items, shares):
            if sum(v for x, v in share.items() if x in there) >= decontam.THRESHOLD - 1e-9:
                near = [x for x in w[max(0, a - stride) : a + 3 * stride] if x]
                both = lambda part: len(grams(part) & {tuple(near[i : i + min(3, len(part))]) for i in range(len(near))}) / len(grams(part)) if part else 1.0
                if both(question) >= decontam.MIN_QUESTION and both(answer) >= decontam.MIN_ANSWER:
                    return True
    return False


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline_against_brute_force(spark):
    import duckdb
    from tokenizers import Tokenizer

    con = duckdb.connect()
    docs = {k: (t, lang) for k, t, lang in con.execute(f"SELECT doc_id, text, lang FROM '{DATA}/documents.parquet'").fetchall()}
    docs = {k: v for k, v in docs.items() if good(*v)}
    docs = first_of_each(without_shared_lines(docs))
    bench = [t for _, t in con.execute(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall() if t and t.strip()]
    parts = [tuple([w for w in clean(x) if w] for x in decontam.split_item(t)) for t in bench]
    shares = bm25_shares([" ".join(w for w in clean(t) if w) for t in bench])
    stride = max(8, *(sum(map(len, p)) for p in parts))
    assert stride <= decontam.PART
    docs = {k: v for k, v in docs.items() if not leaks(v[0], parts, shares, stride)}

    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, DATA).collect():
        pieces[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    assert set(pieces) == set(docs)
    tok = Tokenizer.from_file(packing.default_vocabulary())
    for k, (text, _) in docs.items():
        ids, at = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(pieces[k], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or at & (at - 1) == 0

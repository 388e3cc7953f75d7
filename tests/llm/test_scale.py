"""What must not depend on sizes: benchmark shards, pages of one template, empty inputs, folders."""

import json
import random

import numpy as np
import pytest

import corpus_pipeline
from tapeworks.llm import chat, common, components, decontam, simhash, url_filter


def benchmark(spark, n=60):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    items = [(k, f"Which {' '.join(rng.choices(words, k=14))} did the {rng.choice(words)} see? It saw {' '.join(rng.choices(words, k=6))}.") for k in range(n)]
    items.append((900, " ".join(rng.choices(words, k=200)) + ". " + " ".join(rng.choices(words, k=40)) + "."))
    return items, words


@pytest.mark.parametrize("most", [150, 400])
def test_scores_do_not_depend_on_shards(spark, monkeypatch, most):
    items, words = benchmark(spark)
    rng, docs = random.Random(4), []
    for k in range(150):
        around = " ".join(rng.choices(words, k=40))
        own = rng.choice(items)[1].split()
        for j in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = "other"
        more = rng.choice(items)[1] if k % 7 == 0 else ""
        docs.append((k, f"{around} {' '.join(own)} {around} {more}"))
    docs += [(500, None), (501, "")]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    said = lambda: {(r.doc_id, r.item_id, round(r.score, 9), round(r.question, 9), round(r.answer, 9), r.passage_start) for r in decontam.leaks(table, bench).collect()}
    whole = said()
    clean = {r.doc_id for r in decontam.clean(table, bench).collect()}
    monkeypatch.setattr(decontam, "MAX_WORDS", most)
    assert len(list(decontam._shards(bench, "item_id", "text"))) > 2
    assert said() == whole and len(whole) > 100
    found = decontam.find_leaks(table, bench)
    assert found.count() == len(docs) and found.select("doc_id").distinct().count() == len(docs)
    assert {r.doc_id for r in decontam.clean(table, bench).collect()} == clean == {k for k, _ in docs} - {r[0] for r in whole}


def test_statistics_of_a_whole_benchmark_are_those_of_its_index(spark):
    items, _ = benchmark(spark)
    one = decontam.Index(items)
    [other] = decontam._shards(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert (one.items, one.mean, one.stride, dict(one.df)) == (other.items, other.mean, other.stride, other.df)
    assert [x.stride for x in decontam._shards(spark.createDataFrame([], "item_id long, text string"), "item_id", "text")] == [8]


def sets_of(spark, sets):
    rows = [(k, bytes(simhash.sketch(x).tobytes()), len(x)) for k, x in enumerate(sets)]
    sketches = spark.createDataFrame(rows, "node long, sketch binary, size long")
    hashes = spark.createDataFrame([(k, bytes(x.tobytes())) for k, x in enumerate(sets)], "node long, hashes binary")
    return sketches, lambda wanted: hashes.join(wanted, "node", "left_semi")


def roots(links, n):
    got = {r.node: r.root for r in components.components(links).collect()}
    return [got.get(k, k) for k in range(n)]


def brute(sets, similarity):
    root = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("share", [0.5, 0.7, 0.79])
def test_pages_of_one_template_are_not_compared(spark, monkeypatch, share):
    """Alike, but under the limit: no shingle makes any two of them meet, whatever their number."""
    rng, met = np.random.default_rng(1), []
    template = rng.integers(0, 2**64, 200, dtype=np.uint64)
    own = round(200 * (1 - share) / (2 * share)) + 1
    sets = [np.sort(np.concatenate([template, rng.integers(0, 2**64, own, dtype=np.uint64)])) for _ in range(300)]
    plain = simhash._met
    monkeypatch.setattr(simhash, "_met", lambda m, *a: met.append(m.count()) or plain(m, *a))
    sketches, of = sets_of(spark, sets)
    assert roots(simhash.similar(sketches, of, 0.8, block=32), 300) == list(range(300))
    assert sum(met) == 0


def test_rare_shingles_lose_no_link(spark):
    """Families of one template with drifting parts, of many sizes, near the limit on both sides."""
    rng = np.random.default_rng(7)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    template, sets = fresh(100), []
    for _ in range(24):
        family = fresh(60)
        for _ in range(8):
            keep = family[rng.random(60) < rng.choice([0.7, 0.9, 1.0])]
            sets.append(np.unique(np.concatenate([template[: rng.choice([60, 100])], keep, fresh(int(rng.integers(0, 25)))])))
    members = spark.createDataFrame([(1, k, k, len(x), bytes(simhash.sketch(x).tobytes()), bytes(x.tobytes()), 1 / 16) for k, x in enumerate(sets)], "k long, node long, root long, size long, sketch binary, hashes binary, w double")
    want = brute([set(x.tolist()) for x in sets], 0.8)
    assert 20 < len(set(want)) < len(sets)
    assert roots(simhash.rare_links(members, 0.0, 0.8), len(sets)) == want
    sketches, of = sets_of(spark, sets)
    assert roots(simhash.similar(sketches, of, 0.8, spark.createDataFrame([(k, k + 1) for k in range(len(sets) - 1)], "a long, b long"), block=16), len(sets)) == want


def test_a_hot_shingle_among_unlike_texts(spark):
    """All texts share a rare shingle by chance of their sizes; blocks meet, and links are those of all pairs."""
    rng = np.random.default_rng(9)
    hot = rng.integers(0, 2**64, 3, dtype=np.uint64)
    sets = [np.unique(np.concatenate([hot, rng.integers(0, 2**64, 6, dtype=np.uint64)])) for _ in range(120)]
    sets += [np.unique(np.concatenate([x[:-1], rng.integers(0, 2**64, 1, dtype=np.uint64)])) for x in sets[:40]]
    members = spark.createDataFrame([(1, k, k, len(x), bytes(simhash.sketch(x).tobytes()), bytes(x.tobytes()), 1 / 16) for k, x in enumerate(sets)], "k long, node long, root long, size long, sketch binary, hashes binary, w double")
    want = brute([set(x.tolist()) for x in sets], 0.8)
    assert len(set(want)) < len(sets) and roots(simhash.rare_links(members, 0.0, 0.8), len(sets)) == want


def test_pipeline_of_no_documents_and_of_null_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = "The committee met on the first day of the month, and it was agreed that all of the work should go on as it had been planned by them before. " * 3
    for name, rows in (("none", []), ("nulls", [(None, prose, "en", None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (3, prose.replace("month", "year"), None, "s", 5)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert out.count() == 0 if name == "none" else {r.doc_id for r in out.collect()} <= {None, 3}


def test_only_a_local_session_may_do_without_a_shared_folder():
    class Session:
        def __init__(self, **conf):
            self.conf = self
            self.said = conf

        def get(self, key, default=None):
            return self.said.get(key, default)

        def set(self, key, value):
            self.said[key] = value

    cluster = Session(**{"spark.master": "spark://host:7077"})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)
    with pytest.raises(ValueError):
        common.shared_dir(Session(**{"spark.master": "local-cluster[2,1,1024]"}))
    assert common.shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    own = Session(**{"spark.master": "local[4]"})
    assert common.shared_dir(own) == own.said["spark.checkpoint.dir"]


def test_scratch_deletes_what_is_not_kept(spark):
    with common.scratch(spark) as kept:
        a, b = common.written(spark.range(3), "a"), common.written(spark.range(4), "b")
        kept.append(b)
    assert b.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(a._tw_path).count()
    common.discard(b)


def test_rounds_of_a_long_chain_are_bounded(spark, monkeypatch):
    """Ninety hosts in a row: rounds end at the bound, and near scores are those of the closed form."""
    made, plain = [], url_filter.written
    monkeypatch.setattr(url_filter, "written", lambda df, name: made.append(name) or plain(df, name))
    edges = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(90)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0)], "host string, trust double, distrust double")
    got = {r.host: r.trust for r in url_filter.propagate(edges, seeds, 6).collect()}
    assert made.count("host-scores") == 6
    assert all(abs(got[f"h{k}"] - 0.15 * 0.85**k) < 1e-12 for k in range(6)) and set(got) == {f"h{k}" for k in range(7)}
    assert url_filter.propagate.__defaults__ == (57,) and url_filter.DAMPING**57 < 1e-4


# Chat -------------------------------------------------------------------------------------------------------------------

RECORDS = [
    ({"system": "S", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("system", "S"), ("user", "a"), ("assistant", "b")], []),
    ({"instruction": "i", "output": "o", "history": [["q1", "a1"], ["q2", "a2"]]}, [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"), ("user", "i"), ("assistant", "o")], []),
    ({"instruction": "i", "input": "n", "output": "o", "history": [["q1", "a1"]], "system": "S"}, [("system", "S"), ("user", "q1"), ("assistant", "a1"), ("user", "i\n\nn"), ("assistant", "o")], []),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}, {"role": "assistant", "content": "z"}]}, [("user", "x\ny"), ("assistant", "z")], []),
    ({"messages": [{"role": "assistant", "content": None, "tool_calls": [{"name": "f", "args": "{}"}]}]}, [("assistant", "")], ["messages[].tool_calls[].args", "messages[].tool_calls[].name"]),
    ({"prompt": [{"role": "user", "content": "p"}], "chosen": [{"role": "assistant", "content": "c"}], "rejected": [{"role": "assistant", "content": "r"}]}, [("user", "p"), ("assistant", "c")], ["rejected[].content", "rejected[].role"]),
    ({"prompt": "p", "chosen": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "c"}]}, [("user", "p"), ("assistant", "c")], ["prompt"]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "see"}, {"type": "image", "url": "u"}]}]}, [(None, None)], None),
    ({"question": "q", "answer": "a", "source": "s", "meta": {"k": 1}}, [("user", "q"), ("assistant", "a")], ["meta.k", "source"]),
]


def leaves(x):
    if isinstance(x, dict):
        return [(f"{k}{p}" if p.startswith("[") or not p else f"{k}.{p}", v) for k, y in x.items() for p, v in leaves(y)]
    if isinstance(x, list):
        return [("[]" + (p if p.startswith("[") or not p else "." + p), v) for y in x for p, v in leaves(y)]
    return [("", x)]


def test_no_leaf_of_a_record_is_lost(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)]
    out = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string")).orderBy("conv_id", "turn").collect()
    for k, (record, want, rest) in enumerate(RECORDS):
        own = [r for r in out if r.conv_id == k]
        said = " ".join(r.text or "" for r in own) + " ".join(r.role or "" for r in own)
        if rest is not None:
            assert [(r.role, r.text) for r in own] == want and all(r.unmapped == rest for r in own)
        for path, value in leaves(record):
            named = isinstance(value, str) and (value in said or value in ("text", "human", "gpt"))
            assert value is None or named or any(path == p for r in own for p in r.unmapped) or own[0].layout is None and str(value) in said
    paths = {(r.layout, r.path) for r in chat.unmapped_paths(spark.createDataFrame([(1, json.dumps(RECORDS[8][0]))], "conv_id long, record string").transform(chat.canonical_turns)).collect()}
    assert paths == {("question", "meta.k"), ("question", "source")}

"""The stored text index and the incremental refresh: equal to the full computation, and reading no more than they must."""

import os
import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeworks.functions.steps import Mean
from tapeworks.operators import checks as V, incremental as I, indicators as W, text_index as TI
from tapeworks.schema import QUOTE
from tapeworks.sources import io as S

START = dt.datetime(2024, 1, 1)


# The index --------------------------------------------------------------------------------------------------------------


def answers(rows, queries, k):
    """rows (doc_id, text) by brute force: {(query_id, rank, doc_id, score)}."""
    counts = {}
    for key, text in rows:
        if key is not None:
            counts.setdefault(key, Counter()).update(w for w in re.split(r"[\W_]+", (text or "").lower()) if w)
    df = Counter(w for c in counts.values() for w in c)
    out = set()
    for q, text in queries:
        terms = {w for w in re.split(r"[\W_]+", text.lower()) if w in df}
        found = {d: round(sum(c[w] * math.log(len(counts) / df[w]) for w in terms), 4) for d, c in counts.items() if terms & c.keys()}
        out |= {(q, rank + 1, d, s) for rank, (d, s) in enumerate(sorted(found.items(), key=lambda e: (-e[1], e[0]))[:k])}
    return out


def corpus(n, first=0):
    rng = random.Random(n + first)
    words = ["alpha", "Beta", "gamma's", "délta", "x1", "the", "the", "THE", "rare%d" % (first % 7)]
    return [(first + k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for k in range(n)]


QUERIES = [(1, "the alpha"), (2, "beta Beta délta"), (3, "nothing here"), (4, "rare0 s"), (5, ""), (6, "x1")]


@pytest.fixture
def small_slots(monkeypatch):
    monkeypatch.setattr(TI, "SLOT", 16)


def found(spark, path, k=5):
    out = TI.search_index(spark, path, spark.createDataFrame(QUERIES, "query_id int, query string"), k).collect()
    assert all(r.snippet is not None for r in out)
    return {(r.query_id, r.rank, r.doc_id, r.score) for r in out}


def test_index_of_segments_and_merged(spark, tmp_path, small_slots):
    path, rows = str(tmp_path / "index"), []
    for first, n in ((0, 150), (1000, 60), (2000, 5)):
        part = [*corpus(n, first), (None, "the alpha the"), (first + 500, "the the alpha x1")]
        TI.add_segment(spark.createDataFrame(part, "doc_id long, text string"), path)
        rows += part
        assert found(spark, path) == answers(rows, QUERIES, 5)
    TI.merge_segments(spark, path)
    assert found(spark, path) == answers(rows, QUERIES, 5)
    assert TI.vacuum(spark, path) == 3 and TI.vacuum(spark, path) == 0
    assert found(spark, path, 2) == answers(rows, QUERIES, 2)
    said = {r.term: (r.documents, r.occurrences) for r in TI.term_statistics(spark, path).collect()}
    texts = [Counter(w for w in re.split(r"[\W_]+", t.lower()) if w) for k, t in rows if k is not None]
    assert said == {w: (sum(w in c for c in texts), sum(c[w] for c in texts)) for c in texts for w in c}


def test_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert TI.search_index(spark, path, spark.createDataFrame(QUERIES, "query_id int, query string")).count() == 0
    TI.add_segment(none, path)
    TI.add_segment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), path)
    assert found(spark, path) == set()
    TI.add_segment(spark.createDataFrame([(3, "alpha")], "doc_id long, text string"), path)
    assert {r[:3] for r in found(spark, path)} == {(1, 1, 3)}


def test_search_reads_only_ranges_with_its_terms(spark, tmp_path, monkeypatch):
    path, rng = str(tmp_path / "index"), random.Random(1)
    words = [f"{a}{b}word" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghij"]
    monkeypatch.setattr(TI, "SLOT", 8)
    TI.add_segment(spark.createDataFrame([(k, " ".join(rng.choices(words, k=30))) for k in range(200)], "doc_id long, text string"), path)
    _, segments = TI._manifest(spark, path)
    ranges = segments[0].ranges
    wanted = spark.createDataFrame([("aaword",), ("absent",)], "term string")
    read = TI.wanted_ranges(segments, wanted)[segments[0].segment]
    assert len(ranges) > 2 and set(read) == {r.range for r in ranges if r.low <= "aaword" <= r.high or r.low <= "absent" <= r.high} and len(read) < len(ranges)
    blocks = TI._read(spark, path, segments[0], "blocks", read)
    assert len({f.split("range=")[1].split("/")[0] for f in blocks.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) == len(read)
    plan = TI.search_index(spark, path, spark.createDataFrame([(1, "aaword")], "query_id int, query string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [range" in plan.replace("isnotnull(range", "range") or "range#" in plan
    assert "text" not in plan.split("== Physical Plan ==")[1]


def test_blocks_are_bounded_and_their_heads_are_right(spark, tmp_path, small_slots):
    path = str(tmp_path / "index")
    TI.add_segment(spark.createDataFrame([(k * 7 - 100, "hot " * (k % 5 + 1)) for k in range(400)], "doc_id long, text string"), path)
    _, segments = TI._manifest(spark, path)
    blocks = TI._all(spark, path, segments, "blocks").collect()
    assert len(blocks) > 15 and max(b.n for b in blocks) < 60
    assert sum(b.n for b in blocks) == 400 and all(b.n == len(b.ids) == len(b.counts) and b.top == max(b.counts) and min(b.ids) == 0 for b in blocks)


# The refresh ------------------------------------------------------------------------------------------------------------


def quotes(spark, change=lambda s, day, k: 0.0, days=6, symbols="abc", drop=lambda s, day, k: False):
    rows = []
    for s in symbols:
        for day in range(days):
            for k in range(9):
                if not drop(s, day, k):
                    price = 50 + 5 * math.sin((day * 9 + k) * 0.7 + ord(s)) + change(s, day, k)
                    rows.append((s, START + dt.timedelta(days=day, minutes=k), day * 9 + k, price, 100, None, None, None, None, None))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, QUOTE)


def full(rows):
    out = W.ema(W.macd(W.rsi(W.sma(rows, 20))), 12)
    return {tuple(r) for r in out.select("symbol", "seq", "price", "sma_20", "ema_12", "rsi", "macd", "macd_signal", "macd_histogram").collect()}


def refreshed(spark, out):
    return {tuple(r) for r in I.results(spark, out).select("symbol", "seq", "price", "sma", "ema", "rsi", "macd", "macd_signal", "macd_histogram").collect()}


def replace(rows, lake, *days):
    S.recompute(rows, lake, [(START + dt.timedelta(days=d)).strftime("%Y-%m-%d") for d in days], F.lit("X"))


def test_refresh_equals_the_full_computation_and_reads_what_changed(spark, tmp_path):
    lake, out = str(tmp_path / "lake"), str(tmp_path / "out")
    S.write_lake(quotes(spark), lake, F.lit("X"))
    first = I.refresh(spark, lake, out, buckets=2)
    assert (first.days, first.symbols, first.quotes) == (6, 3, 162) and refreshed(spark, out) == full(quotes(spark))
    nothing = I.refresh(spark, lake, out, buckets=2)
    assert (nothing.days, nothing.symbols, nothing.quotes) == (0, 0, 0)

    replace(quotes(spark), lake, 2)  # the same quotes in new files
    same = I.refresh(spark, lake, out, buckets=2)
    assert (same.days, same.symbols, same.quotes) == (1, 0, 0) and refreshed(spark, out) == full(quotes(spark))

    changed = quotes(spark, lambda s, day, k: 3.0 * (s == "b" and day == 3 and k == 4))
    replace(changed, lake, 3)
    one = I.refresh(spark, lake, out, buckets=2)
    assert (one.days, one.symbols, one.quotes) == (1, 1, 27) and refreshed(spark, out) == full(changed)


def test_refresh_of_late_removed_and_new_rows(spark, tmp_path):
    lake, out = str(tmp_path / "lake"), str(tmp_path / "out")
    late = lambda s, day, k: s == "a" and day == 1 and k > 5
    S.write_lake(quotes(spark, days=4, symbols="ab", drop=late), lake, F.lit("X"))
    I.refresh(spark, lake, out, buckets=2)
    replace(quotes(spark, days=4, symbols="ab"), lake, 1)
    assert I.refresh(spark, lake, out, buckets=2).quotes == 27 and refreshed(spark, out) == full(quotes(spark, days=4, symbols="ab"))

    more = quotes(spark, days=5, symbols="abc", drop=lambda s, day, k: s == "b" and day >= 2)  # b ends early, c and a day are new
    replace(more, lake, 0, 1, 2, 3, 4)
    done = I.refresh(spark, lake, out, buckets=2)
    assert refreshed(spark, out) == full(more) and (done.symbols, done.quotes) == (3, 45 + 9)
    I.vacuum(spark, out)
    assert refreshed(spark, out) == full(more) and I.refresh(spark, lake, out, buckets=2).days == 0


def test_refresh_after_a_changed_factor(spark, tmp_path):
    lake, out, rows = str(tmp_path / "lake"), str(tmp_path / "out"), quotes(spark, days=4)
    S.write_lake(rows, lake, F.lit("X"))
    factors = lambda x: spark.createDataFrame([("a", START + dt.timedelta(days=2), x), ("c", START + dt.timedelta(days=1), 0.5)], "symbol string, ex_ts timestamp, factor double")
    adjusted = lambda x: full(V.adjusted_price(rows, factors(x)).withColumn("price", F.col("adjusted_price")).drop("adjusted_price"))
    I.refresh(spark, lake, out, factors(0.9), buckets=2)
    assert refreshed(spark, out) == adjusted(0.9)
    done = I.refresh(spark, lake, out, factors(0.8), buckets=2)
    assert (done.days, done.symbols, done.quotes) == (0, 1, 36) and refreshed(spark, out) == adjusted(0.8)


def test_a_refresh_has_more_tasks_than_buckets(spark, tmp_path, monkeypatch):
    """A bucket with many quotes is dealt to several tasks by symbol, at first and when later days are made again."""
    monkeypatch.setattr(I, "TASK_ROWS", 40, raising=False)
    lake, out, names = str(tmp_path / "lake"), str(tmp_path / "out"), "abcdefghijkl"
    S.write_lake(quotes(spark, symbols=names), lake, F.lit("X"))
    tasks = lambda run: len({f.split("-")[1] for _, _, found in os.walk(run) for f in found if f.startswith("part-")})
    assert I.refresh(spark, lake, out, buckets=2).quotes == 648
    (first,) = (tmp_path / "out" / "rows").iterdir()
    assert tasks(first) > 4 and refreshed(spark, out) == full(quotes(spark, symbols=names))
    changed = quotes(spark, lambda s, day, k: 2.0 * (day == 2), symbols=names)
    replace(changed, lake, 2)
    assert I.refresh(spark, lake, out, buckets=2).quotes == 432 and refreshed(spark, out) == full(changed)


def test_mean_goes_on_from_its_state():
    a, b = Mean(4), Mean(4)
    for k in range(30):
        b = Mean(4).load(b.state())
        assert a.push(k * 1.37) == b.push(k * 1.37)


def test_a_segment_of_one_slot_is_counted_by_several_tasks_and_made_once(spark, tmp_path):
    """Texts are dealt by document, and the pass that finds the ranges reads blocks instead of making them again."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id") % 50)).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little text would be put in one task anyway
    try:
        tasks = TI._postings(docs, 1).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for batch in rows:
            made.add(batch.num_rows)
            yield batch

    blocks = TI._blocks(TI._postings(docs, 1))
    TI._write(spark, str(tmp_path / "index"), blocks.mapInArrow(seen, blocks.schema), docs.select("doc_id", F.col("text").alias("snippet")), 400, 1)
    assert made.value == 51
    (segment,) = os.listdir(tmp_path / "index" / "segments")
    assert sorted(os.listdir(tmp_path / "index" / "segments" / segment)) == ["blocks", "docs"]

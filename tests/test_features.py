"""Calendar jobs, mergeable sketches, table functions over any table, topics of several domains, nested analysis in chunks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tapeworks.functions.steps import Bands, Ema, Macd, Mean, Rsi
from tapeworks.operators import calendar as C, risk as A, sketches as K
from tapeworks.plans import sql as Q
from tapeworks.schema import QUOTE
from tapeworks.sources import topics as TP

START = dt.datetime(2024, 1, 1)


# Calendar ---------------------------------------------------------------------------------------------------------------


def on_days(spark, **days):
    rows = [(s, START + dt.timedelta(days=d, hours=k)) for s, ds in days.items() for d in ds for k in (9, 15)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp")


@pytest.fixture(scope="module")
def calendar(spark):
    holidays = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2024, 1, 6),)], "day date")
    return C.sessions(spark, F.lit("2024-01-01"), F.lit("2024-01-19"), holidays)


def test_sessions(calendar):
    rows = calendar.orderBy("day").collect()
    assert [r.day.day for r in rows] == [1, 2, 4, 5, 8, 9, 10, 11, 12, 15, 16, 17, 18, 19] and [r.session for r in rows] == list(range(1, 15))


def test_runs_and_gaps(spark, calendar):
    # a: over a holiday and a weekend without a gap; b: two gaps; c: only off days; d: one session
    q = on_days(spark, a=[0, 1, 3, 4, 7, 8], b=[0, 4, 5, 9, 10, 18], c=[5, 6, 2], d=[10])
    day = lambda d: d.day
    runs = {(r.symbol, day(r.first_day), day(r.last_day), r.sessions) for r in C.session_runs(q, calendar).collect()}
    assert runs == {("a", 1, 9, 6), ("b", 1, 1, 1), ("b", 5, 5, 1), ("b", 10, 11, 2), ("b", 19, 19, 1), ("d", 11, 11, 1)}
    gaps = {(r.symbol, day(r.first_day), day(r.last_day), r.sessions) for r in C.missing_sessions(q, calendar).collect()}
    assert gaps == {("b", 2, 4, 2), ("b", 8, 9, 2), ("b", 12, 18, 5)}
    ends = {(r.symbol, day(r.first_day), day(r.last_day), r.sessions) for r in C.missing_sessions(q, calendar, until_end=True).collect()}
    assert ends == gaps | {("a", 10, 19, 8), ("d", 12, 19, 6)}
    assert {(r.symbol, r.quotes) for r in C.off_session(q, calendar).collect()} == {("b", 2), ("c", 6)}
    assert C.missing_sessions(q.limit(0), calendar).count() == 0


def test_next_session_knows_holidays(spark, calendar):
    q = on_days(spark, a=[1, 2, 4, 5, 6, 17, 18])
    got = {r.ts.day: r.next_session and r.next_session.day for r in C.next_session(q, calendar).collect()}
    assert got == {2: 4, 3: 4, 5: 8, 6: 8, 7: 8, 18: 19, 19: None}


# Sketches ---------------------------------------------------------------------------------------------------------------


def test_merged_sketches_over_any_days(spark):
    rng = random.Random(4)
    rows = [(START + dt.timedelta(days=rng.randrange(10)), rng.choice("xy"), rng.randrange(3000), rng.gauss(0, 1) if k % 50 else None) for k in range(20_000)]
    kept = K.daily_sketches(spark.createDataFrame(rows, "ts timestamp, kind string, who long, v double"), ["kind"], "ts", "who", "v")
    for first, last in ((0, 9), (3, 3), (2, 6)):
        days = kept.filter(F.col("day").between(F.lit((START + dt.timedelta(days=first)).date()), F.lit((START + dt.timedelta(days=last)).date())))
        for r in K.estimates(K.merged(days, ["kind"]), ["kind"], {"middle": 0.5, "high_tail": 0.9}).collect():
            own = [(w, v) for t, k, w, v in rows if k == r.kind and first <= (t - START).days <= last]
            values = sorted(v for _, v in own if v is not None)
            share = lambda x: sum(v <= x for v in values) / len(values)
            assert r.rows == len(own) and (r.low, r.high) == (values[0], values[-1])
            assert abs(r.distinct - len({w for w, _ in own})) <= 1 + 0.03 * len({w for w, _ in own})
            assert abs(share(r.middle) - 0.5) < 0.03 and abs(share(r.high_tail) - 0.9) < 0.03


# Table functions --------------------------------------------------------------------------------------------------------


@pytest.fixture
def bars(spark):
    Q.register_table_functions(spark)
    rng = random.Random(9)
    rows = [(s, START + dt.timedelta(minutes=k), round(rng.uniform(5, 9), 2) if k % 17 else None, f"n{k}", k) for s in "ab" for k in range(70)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "symbol string, ts timestamp, close double, note string, number int").createOrReplaceTempView("bars")
    return sorted(rows)


@pytest.mark.parametrize(
    "call, step, names",
    [
        ("ema(TABLE(bars), period => 5, price => 'close')", lambda: Ema(5), ["ema"]),
        ("ema(TABLE(bars), price => 'close')", lambda: Ema(12), ["ema"]),
        ("sma(TABLE(bars), 3, price => 'close')", lambda: Mean(3), ["sma"]),
        ("rsi(TABLE(bars), period => 4, price => 'close')", lambda: Rsi(4), ["rsi"]),
        ("macd(TABLE(bars), fast => 3, slow => 7, signal => 2, price => 'close')", lambda: Macd(3, 7, 2), ["macd", "macd_signal", "macd_histogram"]),
        ("bollinger(TABLE(bars), period => 6, k => 2.5, price => 'close')", lambda: Bands(6, 2.5), ["bb_upper", "bb_middle", "bb_lower"]),
    ],
)
def test_table_functions(spark, bars, call, step, names):
    out = spark.sql(f"SELECT * FROM {call}")
    assert out.columns == ["symbol", "ts", "close", "note", "number", *names]
    want = set()
    for s in "ab":
        push = step().push
        for row in (r for r in bars if r[0] == s):
            made = (None,) * len(names) if row[2] is None else push(row[2])
            want.add((*row, *(made if isinstance(made, tuple) else (made,))))
    assert {tuple(r) for r in out.collect()} == want


@pytest.mark.parametrize("call", ["ema(TABLE(bars))", "ema(TABLE(bars), period => 0, price => 'close')", "ema(TABLE(bars), period => 2.5, price => 'close')", "ema(TABLE(SELECT *, 1d AS ema FROM bars), price => 'close')", "ema(TABLE(SELECT close AS price FROM bars))"])
def test_wrong_calls_of_table_functions(spark, bars, call):
    with pytest.raises(Exception, match="no column|whole number|already"):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_table_functions_take_batches_and_nest(spark, bars):
    """Rows go to Python and back as Arrow batches, also in nested calls, with all columns of the table and null symbols."""
    rows = [(None if r[0] == "a" else r[0], *r[1:], [r[4], None]) for r in bars]
    spark.createDataFrame(rows, "symbol string, ts timestamp, close double, note string, number int, list array<int>").createOrReplaceTempView("lists")
    out = spark.sql("SELECT * FROM macd(TABLE(SELECT * FROM ema(TABLE(lists), period => 5, price => 'close')), fast => 3, slow => 7, price => 'ema')")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPythonUDTF") == 2 and "BatchEvalPythonUDTF" not in plan
    want = set()
    for s in (None, "b"):
        first, second = Ema(5), Macd(3, 7)
        for row in (r for r in rows if r[0] == s):
            mean = None if row[2] is None else first.push(row[2])
            want.add(repr((*row, mean, *((None,) * 3 if mean is None else second.push(mean)))))
    assert {repr(tuple(r)) for r in out.collect()} == want


# Topics -----------------------------------------------------------------------------------------------------------------


def message(version, payload, source="s"):
    return json.dumps({"version": version, "source": source, "payload": payload if isinstance(payload, str) else json.dumps(payload)})


CASES = [
    ("quotes", message("1", {"symbol": "A", "ts": "2024-01-02 10:00:00", "seq": 1, "price": 2.5, "volume": 3, "new": 1}), None),
    ("quotes", message("2", {"symbol": "A", "at_ms": 1704189600000, "seq": 2, "last": 3.5, "bid": 1.0, "ask": 2.0}), None),
    ("quotes", message("3", {"instrument": {"symbol": "B"}, "at_ms": 1704189600000, "seq": 3, "last": 1.0, "size": 9}), None),
    ("quotes", message("2", {"symbol": "A", "at_ms": 1704189600000, "seq": 4, "last": -3.5}), "Price must be positive"),
    ("quotes", message("2", {"symbol": "", "at_ms": 1704189600000, "seq": 4, "last": -3.5}), "Symbol cannot be empty"),
    ("quotes", message("2", {"symbol": "A", "at_ms": 1704189600000, "last": 3.5, "bid": 3.0, "ask": 2.0}), "Bid is above ask"),
    ("quotes", message("2", {"symbol": "A", "at_ms": "soon", "last": 3.5}), "Message does not fit the schema"),
    ("quotes", message("1", "{not json"), "Message does not fit the schema"),
    ("quotes", message("7", {"symbol": "A"}), "Unknown version"),
    ("quotes", "torn {", "Message is no envelope"),
    ("quotes", "", "Message is no envelope"),
    ("weather", message("1", {}), "Unknown topic"),
    ("news", message("1", {"id": 1, "text": "hello", "lang": "en"}), None),
    ("news", message("2", {"id": 2, "body": " ", "language": "en", "origin": "o"}), "Text is empty"),
    ("announcements", message("1", {"id": 5, "symbol": "A", "title": "t", "published": "2024-01-02"}), None),
    ("announcements", message("1", {"id": 5, "symbol": "A"}), "Title is empty"),
    ("financials", message("2", {"symbol": "A", "year": 2023, "quarter": 4, "item": "sales", "thousands": 1.5}), None),
    ("financials", message("1", {"symbol": "A", "period": "2023Q4", "item": "sales"}), "Amount is missing"),
    ("fundflow", message("1", {"symbol": "A", "day": "2024-01-02", "net": -4.0}), None),
    ("fundflow", message("2", {"symbol": "A", "day": "2024-01-02", "inflow": -4.0}), "Flow is negative"),
]


def test_every_message_has_one_place_and_a_reason(spark):
    rows = {r.value: r for r in TP.normalised(spark.createDataFrame([c[:2] for c in CASES], "type string, value string")).collect()}
    assert {v: rows[v].reason for _, v, _ in CASES} == {v: why for _, v, why in CASES}
    one, two, three = (rows[CASES[k][1]] for k in range(3))
    assert (one.quotes.price, one.quotes.bid, one.unknown_fields) == (2.5, None, ["new"]) and two.quotes.ts == three.quotes.ts == one.quotes.ts
    assert (three.quotes.symbol, three.quotes.volume, three.news) == ("B", 9, None)
    assert tuple(rows[CASES[16][1]].financials) == ("A", "2023Q4", "sales", 1500.0)
    assert (rows[CASES[18][1]].fundflow.inflow, rows[CASES[18][1]].fundflow.outflow) == (0.0, 4.0)


def test_messages_are_copied_no_more_often_with_more_versions(spark):
    plan = lambda registry: TP.normalised(spark.createDataFrame([], "type string, value string"), registry)._jdf.queryExecution().executedPlan().toString()
    one = {"news": TP.Domain(TP.REGISTRY["news"].columns, TP.REGISTRY["news"].checks, {"2": TP.REGISTRY["news"].versions["2"]})}
    all_of_them, least = plan(TP.REGISTRY), plan(one)
    assert all_of_them.count("Project [") <= least.count("Project [") + 1
    assert all_of_them.count("from_json") == 1 + sum(len(d.versions) for d in TP.REGISTRY.values())


def test_topics_stream_over_batches_and_a_restart(spark, tmp_path):
    for part in (CASES[::2], CASES[1::2]):
        for kind in {c[0] for c in part}:
            lines = spark.createDataFrame([(c[1],) for c in part if c[0] == kind], "value string")
            lines.coalesce(1).write.mode("append").text(f"{tmp_path}/in/raw_{kind}")
        TP.ingest(TP.raw_topics(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c")
    got = {n: TP.normalized_table(spark, f"{tmp_path}/out", n).count() for n in TP.REGISTRY}
    assert got == {n: sum(c[0] == n and c[2] is None for c in CASES) for n in TP.REGISTRY}
    bad = sorted((r.type, r.reason) for r in TP.quarantine_table(spark, f"{tmp_path}/out").collect())
    assert bad == sorted((c[0], c[2]) for c in CASES if c[2])
    hashes = [r.payload_hash for r in TP.normalized_table(spark, f"{tmp_path}/out", "quotes").collect()]
    assert len(set(hashes)) == 3 and all(len(h) == 64 for h in hashes)


# Nested analysis --------------------------------------------------------------------------------------------------------


def test_nested_analysis_in_chunks(spark):
    rows = [(s, START + dt.timedelta(minutes=k), k, 50.0 + (k * 7 + ord(s)) % 13, 1, None, None, None, None, None) for s, n in (("a", 95), ("b", 30), ("c", 1)) for k in range(n)]
    q = spark.createDataFrame(rows, QUOTE)
    whole = {r.symbol: r for r in A.analyse(q, nested=True).collect()}
    parts = A.analyse(q, nested=True, chunk=30).orderBy("symbol", "chunk").collect()
    assert [(r.symbol, r.chunk, r.first, len(r.indicators[0]["values"])) for r in parts] == [("a", 0, 0, 30), ("a", 1, 30, 30), ("a", 2, 60, 30), ("a", 3, 90, 5), ("b", 0, 0, 30), ("c", 0, 0, 1)]
    for s, one in whole.items():
        for k in range(4):
            for field in ("timestamps", "values"):
                assert [x for r in parts if r.symbol == s for x in r.indicators[k][field]] == one.indicators[k][field]
        assert {(r.recommendation, r.risk_metrics.volatility) for r in parts if r.symbol == s and s == "a"} <= {(one.recommendation, one.risk_metrics.volatility)}

"""Ordered stream operators: any order of arrival, late rows, the alert book, and how much a task holds."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import indicators as W
from tapeworks.streaming import ordered as O, stream as T


class Value:
    def __init__(self):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map(dict):
    getValue = dict.__getitem__
    containsKey = dict.__contains__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class Handle:
    def __init__(self):
        self.timers = set()

    getValueState = lambda self, *a: Value()
    getMapState = lambda self, *a: Map()

    def registerTimer(self, ms):
        self.timers.add(ms)


class Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def drive(op, batches, most=None):
    """Batches (rows, watermark in ms after it) through the operator for one key, as Spark calls it."""
    handle, watermark, out, seen = Handle(), 0, [], []
    op.init(handle)
    step = op.step
    op.step = lambda key, rows: (seen.append(len(rows)), step(key, rows))[1]
    for rows, after in [*batches, (None, None)]:
        if rows is not None and len(rows):
            out += list(op.handleInputRows(("s",), iter([rows.iloc[: len(rows) // 2], rows.iloc[len(rows) // 2 :]]), Times(watermark)))
        for ms in sorted(t for t in handle.timers if t <= watermark):
            out += list(op.handleExpiredTimer(("s",), Times(watermark), None))
            handle.timers.discard(ms)
        watermark = after
    assert most is None or max(seen) <= most
    return pd.concat(out) if out else pd.DataFrame(columns=list(op.out))


def ticks(n, seed=0):
    rng = random.Random(seed)
    return pd.DataFrame({"at": [1_000_000 * (k // 2) for k in range(n)], "seq": range(n), "price": [float(rng.randrange(1, 50)) for _ in range(n)], "volume": 1})


END = 10**9


@pytest.mark.parametrize("width", [3_000_000, O.HOUR])
def test_rows_in_any_order_give_the_ordered_result(width):
    rows = ticks(400)
    want = drive(O.Changes(width), [(rows, END), (None, END)])
    assert want["change"].isna().sum() == 1 and not want["late"].any() and want["seq"].tolist() == list(range(400))
    for seed in range(4):
        mixed = rows.sample(frac=1, random_state=seed)
        cuts = sorted(random.Random(seed).sample(range(400), 5))
        parts = [mixed.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, 400])]
        got = drive(O.Changes(width), [*((p, 0) for p in parts[:-1]), (parts[-1], END), (None, END)])
        assert got.reset_index(drop=True).equals(want.reset_index(drop=True))


def test_rows_held_back_and_late_rows():
    rows = ticks(100)
    got = drive(O.Changes(2_000_000), [(rows.iloc[:60], 20_000), (rows.iloc[60:80], 30_000), (rows.iloc[[5, 33, 70]].assign(seq=lambda r: r["seq"] + 1000), 30_000), (rows.iloc[80:], END), (None, END)])
    assert got["late"].tolist().count(True) == 2 and set(got[got["late"]]["seq"]) == {1005, 1033}
    on_time = got[~got["late"].astype(bool)]
    assert on_time["seq"].tolist() == [*range(72), 1070, *range(72, 100)]


def test_a_step_sees_one_bucket_at_most():
    rows = ticks(20_000)
    out = drive(O.Live(20, 10_000_000), [(rows, END), (None, END)], most=20)
    assert len(out) == 20_000


def books(events):
    """(alert_id, at) of all that fire, by brute force."""
    open_, out = {}, []
    for at, kind, alert, price in events:
        if kind == "tick":
            for a, (side, target) in sorted(open_.items()):
                if price >= target if side == "above" else price <= target:
                    out.append((a, at, price))
                    del open_[a]
        elif kind == "cancel":
            open_.pop(alert, None)
        else:
            open_[alert] = (kind, price)
    return sorted(out)


def test_book_against_brute_force():
    rng = random.Random(6)
    for round_ in range(30):
        events = []
        for at in range(300):
            kind = rng.choice(["tick", "tick", "above", "below", "cancel"])
            events.append((at * 1000, kind, None if kind == "tick" else f"a{rng.randrange(25)}", float(rng.randrange(20)) if kind != "cancel" else None))
        frame = pd.DataFrame({"at": [e[0] for e in events], "turn": [int(e[1] == "tick") for e in events], "seq": 0, "kind": [e[1] for e in events], "alert_id": [e[2] for e in events], "price": [e[3] for e in events]})
        cut = rng.randrange(300)
        got = drive(O.Book(rng.choice([7_000, O.HOUR])), [(frame.iloc[:cut].sample(frac=1, random_state=1), cut), (frame.iloc[cut:].sample(frac=1, random_state=2), END), (None, END)])
        assert sorted(zip(got["alert_id"], got["at"], got["price"])) == books(events)


def test_a_hundred_thousand_alerts_of_one_symbol():
    n, rng = 100_000, np.random.default_rng(1)
    alerts = pd.DataFrame({"at": 0, "turn": 0, "seq": range(n), "kind": np.where(np.arange(n) % 2, "above", "below"), "alert_id": [f"a{k}" for k in range(n)], "price": rng.uniform(0, 100, n)})
    some = pd.DataFrame({"at": np.arange(1, 2001) * 1000, "turn": 1, "seq": range(2000), "kind": "tick", "alert_id": None, "price": 50 + 20 * np.sin(np.arange(2000) / 50)})
    began = time.time()
    out = drive(O.Book(), [(alerts, 0), (some, END), (None, END)])
    assert time.time() - began < 30
    high, low = some["price"].max(), some["price"].min()
    assert len(out) == ((alerts["kind"] == "above") & (alerts["price"] <= high)).sum() + ((alerts["kind"] == "below") & (alerts["price"] >= low)).sum()


def test_late_alert_counts_from_the_watermark():
    tick = lambda at, price: (at, 1, 0, "tick", None, price)
    frame = lambda *rows: pd.DataFrame(rows, columns=["at", "turn", "seq", "kind", "alert_id", "price"])
    out = drive(O.Book(), [(frame(tick(1_000_000, 9.0)), 5_000), (frame((2_000_000, 0, 0, "above", "x", 5.0), tick(3_000_000, 8.0), tick(6_000_000, 7.0)), END), (None, END)])
    assert out[["alert_id", "at", "price", "late"]].astype(object).where(out[["alert_id", "at", "price", "late"]].notna(), None).values.tolist() == [[None, 3_000_000, 8.0, True], ["x", 6_000_000, 7.0, False]]


def test_stream_with_late_rows_is_counted(spark, tmp_path):
    T.use_rocksdb(spark)
    at = "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 10)"
    rows = spark.range(600).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("symbol"), F.expr(at).alias("ts"), F.col("id").alias("seq"), (F.col("id") * 7 % 11).cast("double").alias("price"), F.lit(1).cast("long").alias("volume"))
    late = (F.col("seq") < 300) & (F.col("seq") % 10 == 0)
    seen = O.Lateness()
    spark.streams.addListener(seen)
    try:
        for part in (rows.filter(~late), rows.filter(late), T.closing_row(rows)):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = O.counted(T.stream_tick_changes(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "1 minute"), "changes")
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        until = time.time() + 20
        while seen.counts.get("changes", (0, 0))[0] < 600 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {r.symbol: r.late for r in O.late_counts(out).collect()} == {"s0": 10, "s1": 10, "s2": 10}
    assert seen.counts["changes"] == (600, 30)
    want = {(r.symbol, r.seq, r.change) for r in T.tick_changes(rows.filter(~late)).collect()}
    assert {(r.symbol, r.seq, r.change) for r in out.filter("not late").collect()} == want


def test_live_sma_is_the_batch_one():
    prices = [2.675, 1.005, 0.125, 2.5, 3.00005] * 30
    rows = pd.DataFrame({"at": [k * 1_000_000 for k in range(150)], "seq": range(150), "price": prices})
    from tapeworks.functions.steps import Mean

    mean = Mean(20)
    assert drive(O.Live(20), [(rows, END), (None, END)])["sma"].tolist() == [mean.push(p) for p in prices]


def test_first_hits_compares_no_tick_with_an_alert(spark):
    rng = random.Random(2)
    rows = [(f"s{k % 3}", k, k, float(rng.randrange(30))) for k in range(400)]
    alerts = [(f"a{k}", f"s{k % 4}", rng.choice(["above", "below"]), float(rng.randrange(-3, 34)) if k % 9 else None, k % 5 > 0) for k in range(120)]
    q = spark.createDataFrame(rows, "symbol string, t long, seq long, price double").withColumn("ts", F.timestamp_seconds("t"))
    table = spark.createDataFrame(alerts, "alert_id string, symbol string, alert_type string, target_price double, active boolean")
    out = T.first_hits(q, table)
    want = set()
    for a, s, kind, target, active in alerts:
        hits = [(t, p) for x, t, _, p in rows if x == s and target is not None and active and (p >= target if kind == "above" else p <= target)]
        want |= {(a, s, *min(hits))} if hits else set()
    assert {(r.alert_id, r.symbol, int(r.ts.timestamp()), r.price) for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_batch_and_live_indicators_share_their_steps(spark):
    assert W.Ema is O.Ema and W.Macd is O.Macd


class Calls:
    """A state that counts the calls to it."""

    def __init__(self, inner, count):
        self.inner, self.count = inner, count

    def __getattr__(self, name):
        def call(*a):
            self.count.append(name)
            return getattr(self.inner, name)(*a)

        return call


def test_a_key_with_few_rows_calls_its_state_a_few_times(monkeypatch):
    """However many buckets of time the rows are in."""
    count, value, held = [], Handle.getValueState, Handle.getMapState
    monkeypatch.setattr(Handle, "getValueState", lambda self, *a: Calls(value(self, *a), count))
    monkeypatch.setattr(Handle, "getMapState", lambda self, *a: Calls(held(self, *a), count))
    rows = ticks(200)
    out = drive(O.Live(20, 2_000_000), [(rows.iloc[:100], 40_000), (rows.iloc[100:], END), (None, END)])
    assert out["seq"].tolist() == list(range(200)) and len(count) <= 16


@pytest.mark.parametrize("few", [0, 7, 60, 1000])
@pytest.mark.parametrize("kind", [O.Changes, lambda width: O.Live(20, width)])
def test_rows_held_together_or_in_buckets_give_the_same(monkeypatch, few, kind):
    rows, cuts = ticks(300), [0, 40, 110, 190, 300]
    parts = [rows.sample(frac=1, random_state=3).iloc[a:b] for a, b in zip(cuts, cuts[1:])]
    early = [rows.iloc[a:b].sample(frac=1, random_state=4) for a, b in zip(cuts, cuts[1:])]
    want = drive(kind(O.HOUR), [(rows, END), (None, END)]).reset_index(drop=True)
    monkeypatch.setattr(O, "FEW", few)
    for arrivals, marks in ((parts, [0, 0, 0, END]), (early, [20_000, 50_000, 90_000, END])):
        got = drive(kind(4_000_000), [*zip(arrivals, marks), (None, END)]).reset_index(drop=True)
        assert got["seq"].tolist() == list(range(300)) and not got["late"].any()
        pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_changes_after_a_price_of_zero(spark, tmp_path):
    """As IEEE division has them, like the reference and the SQL: infinite, and NaN from zero to zero."""
    T.use_rocksdb(spark)
    prices = [5.0, 0.0, 3.0, -0.0, 3.0, 0.0, 0.0, 4.0]
    rows = spark.createDataFrame([("s", k, k, p, 1) for k, p in enumerate(prices)], "symbol string, t long, seq long, price double, volume long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    want = ["None", "-100.0", "inf", "-100.0", "-inf", "-100.0", "nan", "inf"]
    said = lambda df: [str(r.change_percent) for r in df.orderBy("seq").collect()]
    assert said(T.tick_changes(rows)) == want
    for part in (rows.filter("seq < 4"), rows.filter("seq >= 4"), T.closing_row(rows)):
        part.select(rows.columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = T.stream_tick_changes(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "1 minute")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert said(spark.read.parquet(f"{tmp_path}/out").filter("symbol <> ''")) == want

"""Hand cases, literal restatements and properties of the market-data operators."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from tapeworks.functions import expr as X
from tapeworks.functions.steps import Ema, Macd, Rsi, rounded
from tapeworks.operators import checks as V, filters as L, indicators as W, risk as A
from tapeworks.schema import QUOTE
from tapeworks.sources import io as S

START = dt.datetime(2024, 1, 1)

# Prices, texts and expected results of the literal cases that the engine must agree with.


def quotes(spark, **prices):
    rows = [(s, START + dt.timedelta(days=k), k, float(p), 100 * (k + 1), None, None, None, None, None) for s, ps in prices.items() for k, p in enumerate(ps)]
    return spark.createDataFrame(rows[::-1], QUOTE)


def column(df, name, symbol=None):
    rows = df.filter(F.col("symbol") == symbol) if symbol else df
    return [r[name] for r in rows.orderBy("ts", "seq").collect()]


def test_sma(spark):
    q = quotes(spark, a=[1, 2, 3, 4, 5], b=[7, 8])
    assert column(W.sma(q, 3), "sma_3", "a") == [0.0, 0.0, 2.0, 3.0, 4.0]
    assert column(W.sma(q, 3), "sma_3", "b") == [0.0, 0.0]
    with pytest.raises(ValueError):
        W.sma(q, 0)


def test_ema_and_macd(spark):
    assert column(W.ema(quotes(spark, a=[10, 11, 12]), 3), "ema_3") == [10.0, 10.5, 11.25]
    r = W.macd(quotes(spark, a=[5])).first()
    assert (r.macd, r.macd_signal, r.macd_histogram) == (0.0, 0.0, 0.0)


def test_rsi(spark):
    known = [44, 44.5, 45, 44.8, 45.2, 45.8, 46.2, 46.5, 46, 45.8, 45.5, 45.2, 44.8, 44.5, 44]
    q = quotes(spark, a=known, flat=[3] * 15, short=[1] * 14)
    out = W.rsi(q)
    assert column(out, "rsi", "a") == [0.0] * 14 + [50.0]
    assert column(out, "rsi", "flat") == [0.0] * 14 + [100.0]
    assert column(out, "rsi", "short") == [0.0] * 14
    assert column(W.rsi_signals(quotes(spark, a=[100, 101, 102])), "signal") == ["Buy"] * 3


def test_bollinger_of_equal_prices(spark):
    out = W.bollinger(quotes(spark, a=[4] * 5), 3)
    assert [tuple(r) for r in out.orderBy("ts").select("bb_upper", "bb_middle", "bb_lower").collect()] == [(0.0,) * 3] * 2 + [(4.0,) * 3] * 3


def test_steps_restated():
    prices = [50 + 10 * math.sin(k / 3) + k % 7 for k in range(200)]
    gains = [max(b - a, 0.0) for a, b in zip(prices, prices[1:])]
    losses = [max(a - b, 0.0) for a, b in zip(prices, prices[1:])]
    g, s, want = sum(gains[:14]) / 14, sum(losses[:14]) / 14, [0.0] * 14
    for k in range(14, 200):
        want.append(100.0 if s == 0 else rounded(100 - 100 / (1 + g / s), 4))
        if k < 199:
            g, s = (g * 13 + gains[k]) / 14, (s * 13 + losses[k]) / 14
    step = Rsi()
    assert [step.push(p) for p in prices] == want
    assert all(0 <= x <= 100 for x in want)
    a, b = Macd(), Macd()
    for k, p in enumerate(prices):  # state carried over is the same as one run
        b = Macd().load(b.state())
        assert a.push(p) == b.push(p)
    assert rounded(0.49999999999999994, 0) == 0.0 and rounded(-2.5, 0) == -3.0
    e = Ema(3)
    assert [e.push(x) for x in (10.0, 11.0, 12.0)] == [10.0, 10.5, 11.25]


def test_fold_does_not_depend_on_batches_or_order(spark):
    q = quotes(spark, a=range(1, 60), b=[k % 5 + 1 for k in range(80)])
    want = sorted(map(str, W.all_indicators(q).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(str, W.all_indicators(q.orderBy(F.rand(1))).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_indicators_shuffles_once(spark):
    plan = W.all_indicators(quotes(spark, a=[1, 2, 3]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Sort ") + plan.count("Sort [symbol") <= 2


def test_risk_and_votes(spark):
    q = quotes(spark, one=[5], two=[5, 4], rising=[100, 101, 102, 103, 104], flat=[7] * 20)
    r = {x.symbol: x for x in A.analyse(q).collect()}
    assert (r["one"].volatility, r["one"].sharpe, r["one"].max_drawdown, r["one"].recommendation) == (0.0, None, 0.0, "Hold")
    assert math.isnan(r["two"].volatility) and r["two"].sharpe is None and abs(r["two"].max_drawdown - 0.2) < 1e-12
    assert r["rising"].recommendation == "Buy" and r["rising"].confidence == 100.0 and r["rising"].beta is None
    nested = {x.symbol: x for x in A.analyse(q, nested=True).collect()}["rising"]
    assert [i.name for i in nested.indicators] == ["RSI(14)", "SMA(20)", "SMA(50)", "MACD(12,26,9)"] and len(nested.indicators[0].signals) == 5


def test_expressions(spark):
    row = spark.range(1).select(
        X.round_to(F.lit(3.14159), 2).alias("a"), X.percent_change(F.lit(100.0), F.lit(110.0)).alias("b"), X.percent_change(F.lit(0.0), F.lit(1.0)).alias("c"),
        X.safe_divide(F.lit(10.0), F.lit(2.0), 0.0).alias("d"), X.safe_divide(F.lit(10.0), F.lit(0.0), -1.0).alias("e"), X.safe_truncate(F.lit("hello world"), 5).alias("f"),
        X.trim_whitespace(F.lit(" hello　 world ")).alias("g"), X.format_currency(F.lit(-1.5), F.lit("usd")).alias("h"),
    ).first()
    assert tuple(row) == (3.14, 10.0, 0.0, 5.0, -1.0, "he...", "helloworld", "$-1.50")
    valid = spark.createDataFrame([("AAPL",), ("",), ("TOO_LONG_SYMBOL_12345",), ("中中中中",), ("中中中",), ("A\n",)], "s string").select(X.is_valid_symbol(F.col("s")))
    assert [r[0] for r in valid.collect()] == [True, False, False, False, True, False]


def test_calendar_and_session(spark):
    days = spark.createDataFrame([(dt.datetime(2024, 1, d, 9, 30),) for d in (4, 5, 6, 7)], "ts timestamp")
    assert [r[0].day for r in days.select(X.next_trading_day(F.col("ts"))).collect()] == [5, 8, 8, 8]
    times = [(14, 29, 0), (14, 30, 0), (20, 59, 0), (21, 0, 59), (21, 1, 0)]
    q = spark.createDataFrame([(dt.datetime(2024, 1, 2, *t),) for t in times], "ts timestamp")
    assert L.trading_session(q).count() == 3


def test_validation(spark):
    q = quotes(spark, a=[150, 0, 1000000, 1000000.01, float("nan")])
    now = F.to_timestamp(F.lit("2030-01-01"))
    got = column(V.check_price_range(V.validate(q, now)), "reject_reason"), column(V.check_price_range(q), "range_reason")
    assert got[0] == [None, "Price must be positive", None, None, None]
    assert got[1] == [None, "Price must be positive", None, "Price seems unreasonably high", None]


def test_adjusted_price_uses_later_factors_only(spark):
    q = quotes(spark, a=[10, 20, 30])
    f = spark.createDataFrame([("a", START + dt.timedelta(days=1), 0.5)], "symbol string, ex_ts timestamp, factor double")
    assert [round(x, 9) for x in column(V.adjusted_price(q, f), "adjusted_price")] == [5.0, 20.0, 30.0]


def test_latest_of_unknown_symbol(spark):
    q = quotes(spark, a=[1, 2])
    got = {r.symbol: r.price for r in L.latest(q, spark.createDataFrame([("a",), ("x",)], "symbol string")).collect()}
    assert got == {"a": 2.0, "x": None}


def test_entry_imports_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['tapeworks.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'w1_sma' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_fold_refuses_rows_out_of_order_and_starts_anew_for_each_symbol(spark):
    import pyarrow as pa

    from tapeworks.operators.indicators import _Segments

    batch = lambda rows: pa.RecordBatch.from_pydict({"symbol": [r[0] for r in rows], "ts": pa.array([r[1] for r in rows], pa.timestamp("us")), "seq": [r[2] for r in rows]})
    cut = _Segments()
    assert list(cut(batch([("a", 1, 1), ("a", 1, 2), ("b", 0, 1)]))) == [(False, 0, 2), (False, 2, 3)]
    assert list(cut(batch([("b", 0, 1), ("c", 5, 1)]))) == [(True, 0, 1), (False, 1, 2)]
    with pytest.raises(ValueError):
        list(cut(batch([("c", 4, 9)])))
    with pytest.raises(ValueError):
        list(_Segments()(batch([("a", 2, 1), ("a", 1, 1)])))


def test_too_many_strategies_are_refused(spark, monkeypatch):
    from tapeworks.operators import indicators

    monkeypatch.setattr(indicators, "MAX_STRATEGIES", 2)
    quotes = spark.createDataFrame([("a", None, 1, 2.0)], "symbol string, ts timestamp, seq bigint, price double")
    many = spark.createDataFrame([(str(k), {}) for k in range(3)], "id string, params map<string,double>")
    with pytest.raises(ValueError):
        indicators.indicators_by_strategy(quotes, many)
    with pytest.raises(ValueError):
        indicators.indicators_by_strategy(quotes, spark.createDataFrame([("x", {"sma_short": 0.0})], "id string, params map<string,double>"))


def test_a_hot_day_of_the_lake_is_dealt_to_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from tapeworks.sources import io

    rows = spark.range(20000).select(F.lit("hot").alias("symbol"), F.timestamp_seconds(1704067200 + F.col("id")).alias("ts"), F.col("id").alias("seq"), F.lit(1.5).alias("price"))
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_lake(rows, str(tmp_path / "lake"), F.lit("X"), overwrite=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert len(list((tmp_path / "lake" / "exchange=X" / "dt=2024-01-01").glob("*.parquet"))) > 1
    io.recompute(rows.filter("seq < 5"), str(tmp_path / "lake"), ["2024-01-01"], F.lit("X"))
    assert spark.read.parquet(str(tmp_path / "lake")).count() == 5


def test_local_folders_only_in_local_sessions():
    from tapeworks.sources import io

    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        io.shared_folder(Session, "x")


def test_normalise_maps_closes_and_epoch_times_and_leaves_the_rest_null(spark):
    from tapeworks.sources import io

    raw = spark.createDataFrame([("AAPL", 1704067200123, 101.5, 7)], "s string, at bigint, c double, v bigint")
    out = io.normalise(raw, symbol="s", ts="at", close="c", volume="v")
    assert [f.name for f in out.schema.fields] == [f.name for f in QUOTE.fields]
    r = out.first()
    assert (r.symbol, r.price, r.volume, r.seq, r.bid, r.low) == ("AAPL", 101.5, 7, None, None, None)
    assert out.select(F.unix_millis("ts").alias("m")).first().m == 1704067200123


def test_scratch_deletes_what_was_staged(spark):
    from tapeworks.sources import io as S

    before = len(S._staged)
    with S.scratch(spark):
        kept = S.staged(spark.range(5), "five")
        assert kept.count() == 5 and len(S._staged) == before + 1
        path = S._staged[-1]
    assert len(S._staged) == before
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_risk_with_prices_of_zero(spark):
    """By IEEE division, as in the reference and the SQL: returns from zero are infinite, so volatility and Sharpe are NaN."""
    r = {x.symbol: x for x in A.analyse(quotes(spark, mid=[5, 0, 3, 4], first=[0, 3, 4], still=[7] * 4)).collect()}
    for name in ("mid", "first"):
        assert math.isnan(r[name].volatility) and math.isnan(r[name].sharpe)
    assert r["mid"].max_drawdown == 1.0 and math.isnan(r["first"].max_drawdown) and r["mid"].recommendation == "Sell"
    assert r["still"].volatility == 0.0 and r["still"].sharpe is None


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_an_export_of_everything_has_no_folder_for_each_symbol(spark, tmp_path, kind):
    """Folders are for symbols that are asked for; both forms hold all rows, and a symbol's rows lie in order."""
    q = quotes(spark, **{f"s{k:03}": [k + 1, k + 2, k + 3] for k in range(200)})
    export = S.export_csv if kind == "csv" else S.export_json
    everything, some = str(tmp_path / "all"), str(tmp_path / "some")
    export(q, everything)
    export(q, some, symbols=["s007", "s100"])
    files = [f for f in os.listdir(everything) if f.startswith("part-")]
    assert 0 < len(files) <= 4 and not [f for f in os.listdir(everything) if f.startswith("symbol_dir")]
    assert sorted(f for f in os.listdir(some) if f.startswith("symbol_dir")) == ["symbol_dir=s007", "symbol_dir=s100"]
    read = lambda path: spark.read.schema("symbol string, price double").json(path) if kind == "json" else spark.read.option("header", True).csv(path).selectExpr("symbol", "cast(price as double) price")
    assert sorted(map(tuple, read(everything).collect())) == sorted((r.symbol, r.price) for r in q.collect())
    assert sorted(map(tuple, read(f"{some}/*/").collect())) == sorted((r.symbol, r.price) for r in q.filter("symbol in ('s007', 's100')").collect())
    for f in files:
        said = [tuple(r) for r in read(f"{everything}/{f}").collect()]
        assert said == sorted(said)

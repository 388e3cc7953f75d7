"""The registered queries, (spark, sf_dir) -> DataFrame, and DuckDB SQL with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import expr as X
from ..functions.expr import round_to as r
from ..operators import calendar as C, checks as V, filters as L, incremental as I, indicators as W, risk as A, search as D, sketches as K, text_index as TI
from ..schema import QUOTE
from ..sources import io as S, topics as TP
from ..streaming import stream as T
from . import sql as Q

NOW = "2024-01-05"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _quotes(spark: SparkSession, d: str, calm: bool = False) -> DataFrame:
    return S.quotes_from_events(spark, d, calm)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _industries(spark: SparkSession, d: str) -> DataFrame:
    nation, region = _table(spark, d, "nation"), _table(spark, d, "region")
    dim = nation.join(region, nation.n_regionkey == region.r_regionkey)
    users = _table(spark, d, "events").select("user_id").distinct()
    return users.join(dim, users.user_id % 25 == dim.n_nationkey).select(F.col("user_id").cast("string").alias("symbol"), F.col("r_name").alias("industry"))


_CALM = "round((100::DOUBLE + value / 100::DOUBLE) * 100::DOUBLE) / 100::DOUBLE"


def _with(calm: bool = False) -> str:
    p = _CALM if calm else "value"
    return f"""quotes AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts, event_id AS seq, {p} AS price, event_id % 1000 + 1 AS volume,
      {p} - 0.01::DOUBLE AS bid, {p} + 0.01::DOUBLE AS ask, {p} - 0.1::DOUBLE AS open, {p} + 0.2::DOUBLE AS high, {p} - 0.3::DOUBLE AS low, event_type, props FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn, count(*) OVER (PARTITION BY symbol) AS n,
      price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS move, lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS prev FROM quotes)"""


def _r(x: str, p: int = 4) -> str:
    return f"round(({x}) * {10**p}::DOUBLE) / {10**p}::DOUBLE"


def _ma(n: int) -> str:
    return f"CASE WHEN rn >= {n} THEN {_r(f'avg(price) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)')} ELSE 0.0::DOUBLE END"


_EMA = lambda n, v="price": f"SELECT symbol, rn, {v} AS v FROM r WHERE rn = 1 UNION ALL SELECT r.symbol, r.rn, {_r(f'(r.{v} - e.v) * (2::DOUBLE / {n + 1}::DOUBLE) + e.v')} FROM e{n} e JOIN r ON r.symbol = e.symbol AND r.rn = e.rn + 1"


def _rsi_sql(p: int = 14, name: str = "rsi") -> str:
    step = lambda side: f"CASE WHEN r.rn < {p + 1} THEN x.{side[0]} + greatest({side[1]}, 0::DOUBLE) WHEN r.rn = {p + 1} THEN (x.{side[0]} + greatest({side[1]}, 0::DOUBLE)) / {p}::DOUBLE ELSE (x.{side[0]} * {p - 1}::DOUBLE + greatest({side[1]}, 0::DOUBLE)) / {p}::DOUBLE END"
    return f"""{name}0 AS (
      SELECT symbol, rn, 0::DOUBLE AS g, 0::DOUBLE AS l FROM r WHERE rn = 1
      UNION ALL SELECT r.symbol, r.rn, {step(("g", "r.move"))}, {step(("l", "-r.move"))}
      FROM {name}0 x JOIN r ON r.symbol = x.symbol AND r.rn = x.rn + 1),
    {name} AS (SELECT symbol, rn, CASE WHEN rn < {p + 1} THEN 0.0::DOUBLE WHEN l = 0 THEN 100.0::DOUBLE ELSE {_r('100::DOUBLE - 100::DOUBLE / (1::DOUBLE + g / l)')} END AS rsi FROM {name}0)"""


def _macd_sql(fast: int = 12, slow: int = 26, signal: int = 9, name: str = "macd") -> str:
    weight = lambda n: f"(2::DOUBLE / {n + 1}::DOUBLE)"
    return f"""{name} AS (
      SELECT symbol, rn, price AS f, price AS s, 0::DOUBLE AS line, 0::DOUBLE AS sig FROM r WHERE rn = 1
      UNION ALL SELECT symbol, rn, f, s, line, {_r(f'(line - sig) * {weight(signal)} + sig')} FROM (
        SELECT symbol, rn, f, s, {_r('f - s')} AS line, sig FROM (
          SELECT r.symbol, r.rn, {_r(f'(r.price - m.f) * {weight(fast)} + m.f')} AS f, {_r(f'(r.price - m.s) * {weight(slow)} + m.s')} AS s, m.sig
          FROM {name} m JOIN r ON r.symbol = m.symbol AND r.rn = m.rn + 1)))"""


def _bands_sql(n: int, k: float, name: str) -> str:
    w = f"(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    edge = lambda sign: f"CASE WHEN rn >= {n} THEN {_r(f'middle {sign} {k}::DOUBLE * sqrt(v + (a - middle) * (a - middle))')} ELSE 0 END"
    return f"""{name} AS (SELECT symbol, rn, middle AS bb_middle, {edge('+')} AS bb_upper, {edge('-')} AS bb_lower
      FROM (SELECT symbol, rn, {_ma(n)} AS middle, avg(price) OVER {w} AS a, var_pop(price) OVER {w} AS v FROM r))"""


_RSI, _MACD = _rsi_sql(), _macd_sql()
_HISTOGRAM = _r("(line - sig) * 1000::DOUBLE")

# Windows -------------------------------------------------------------------------------------------------------------


@_query(f"WITH {_with()} SELECT symbol, seq, {_ma(20)} AS sma_20 FROM r")
def w1_sma(spark, d):
    return W.sma(_quotes(spark, d), 20).select("symbol", "seq", "sma_20")


@_query(f"WITH {_with()} SELECT symbol, seq, {_ma(14)} AS moving_average FROM r")
def w2_moving_average(spark, d):
    return W.moving_average(_quotes(spark, d), 14).select("symbol", "seq", r(F.col("moving_average")).alias("moving_average"))


@_query(f"WITH RECURSIVE {_with()}, e12 AS ({_EMA(12)}) SELECT e.symbol, r.seq, e.v AS ema_12 FROM e12 e JOIN r USING (symbol, rn)")
def w3_ema(spark, d):
    return W.ema(_quotes(spark, d), 12).select("symbol", "seq", "ema_12")


@_query(f"WITH RECURSIVE {_with()}, {_RSI} SELECT symbol, seq, rsi FROM rsi JOIN r USING (symbol, rn)")
def w4_rsi(spark, d):
    return W.rsi(_quotes(spark, d)).select("symbol", "seq", "rsi")


_BB = f"""WITH {_with()}, m AS (SELECT symbol, seq, rn, {_ma(20)} AS bb_middle,
      avg(price) OVER w AS a, var_pop(price) OVER w AS v FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    s AS (SELECT *, sqrt(v + (a - bb_middle) * (a - bb_middle)) AS sd FROM m)
    SELECT symbol, seq, bb_middle, CASE WHEN rn >= 20 THEN {_r('bb_middle + 2::DOUBLE * sd')} ELSE 0 END AS bb_upper,
      CASE WHEN rn >= 20 THEN {_r('bb_middle - 2::DOUBLE * sd')} ELSE 0 END AS bb_lower FROM s"""


@_query(_BB)
def w5_bollinger(spark, d):
    return W.bollinger(_quotes(spark, d)).select("symbol", "seq", "bb_middle", "bb_upper", "bb_lower")


@_query(f"WITH RECURSIVE {_with()}, {_MACD} SELECT symbol, seq, line AS macd, sig AS macd_signal, {_r('(line - sig) * 1000::DOUBLE')} AS macd_histogram FROM macd JOIN r USING (symbol, rn)")
def w6_macd(spark, d):
    return W.macd(_quotes(spark, d)).select("symbol", "seq", "macd", "macd_signal", "macd_histogram")


@_query(f"WITH RECURSIVE {_with()}, {_RSI} SELECT symbol, seq, rsi, CASE WHEN rsi > 70 THEN 'Sell' WHEN rsi < 30 THEN 'Buy' ELSE 'Hold' END AS signal FROM rsi JOIN r USING (symbol, rn)")
def w7_rsi_signals(spark, d):
    return W.rsi_signals(_quotes(spark, d)).select("symbol", "seq", "rsi", "signal")


_ALL = ["sma_short", "sma_long", "rsi", "macd", "macd_signal", "macd_histogram", "bb_upper", "bb_middle", "bb_lower"]


@_query(
    f"WITH RECURSIVE {_with()}, {_RSI}, {_MACD}, {_bands_sql(20, 2.0, 'bands')}, m AS (SELECT symbol, rn, seq, {_ma(20)} AS sma_short, {_ma(50)} AS sma_long FROM r) "
    f"SELECT symbol, seq, sma_short, sma_long, rsi, line AS macd, sig AS macd_signal, {_HISTOGRAM} AS macd_histogram, bb_upper, bb_middle, bb_lower FROM m JOIN rsi USING (symbol, rn) JOIN macd USING (symbol, rn) JOIN bands USING (symbol, rn)"
)
def w8_all_indicators(spark, d):
    return W.all_indicators(_quotes(spark, d)).select("symbol", "seq", *_ALL)


_FAST = {"rsi_period": 7.0, "sma_short": 5.0, "sma_long": 30.0, "macd_fast": 5.0, "macd_slow": 13.0, "macd_signal": 4.0, "bb_period": 10.0, "bb_k": 1.5}


@_query(
    f"WITH RECURSIVE {_with()}, {_RSI}, {_MACD}, {_bands_sql(20, 2.0, 'bands')}, {_rsi_sql(7, 'rsi7')}, {_macd_sql(5, 13, 4, 'macd5')}, {_bands_sql(10, 1.5, 'bands10')}, "
    f"m AS (SELECT symbol, rn, seq, {_ma(20)} AS s20, {_ma(50)} AS s50, {_ma(5)} AS s5, {_ma(30)} AS s30 FROM r) "
    f"SELECT symbol, 'default' AS strategy, seq, s20 AS sma_short, s50 AS sma_long, rsi, line AS macd, sig AS macd_signal, {_HISTOGRAM} AS macd_histogram, bb_upper, bb_middle, bb_lower FROM m JOIN rsi USING (symbol, rn) JOIN macd USING (symbol, rn) JOIN bands USING (symbol, rn) "
    f"UNION ALL SELECT symbol, 'fast', seq, s5, s30, rsi, line, sig, {_HISTOGRAM}, bb_upper, bb_middle, bb_lower FROM m JOIN rsi7 USING (symbol, rn) JOIN macd5 USING (symbol, rn) JOIN bands10 USING (symbol, rn)"
)
def w9_strategies(spark, d):
    s = spark.createDataFrame([("default", {}), ("fast", _FAST)], "id string, params map<string,double>")
    return W.indicators_by_strategy(_quotes(spark, d), s).select("symbol", "strategy", "seq", *_ALL)


@_query(
    f"WITH {_with()}, x AS (SELECT *, move / prev AS ret FROM r) SELECT symbol, seq, round(CASE WHEN rn > 20 THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252::DOUBLE) END, 4) AS rolling_volatility FROM x"
)
def w10_rolling_volatility(spark, d):
    return W.rolling_volatility(_quotes(spark, d, calm=True).select("*")).select("symbol", "seq", F.round("rolling_volatility", 4).alias("rolling_volatility"))


SQL["w10_rolling_volatility"] = SQL["w10_rolling_volatility"].replace(_with(), _with(True))

# Risk ----------------------------------------------------------------------------------------------------------------

_RISK = """g AS (SELECT symbol, count(*) AS n, stddev_samp(move / prev) * sqrt(252::DOUBLE) AS vol,
      (arg_max(price, rn) / arg_min(price, rn) - 1) * 252::DOUBLE / count(*) AS annual FROM r GROUP BY symbol),
    dd AS (SELECT symbol, max((top - price) / top) AS max_drawdown FROM (SELECT symbol, price, max(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS top FROM r) GROUP BY symbol),
    risk AS (SELECT symbol, n, CASE WHEN n < 2 THEN 0 WHEN n = 2 THEN 'nan'::DOUBLE ELSE vol END AS volatility, CASE WHEN n > 2 AND vol > 0 THEN (annual - 0.02::DOUBLE) / vol END AS sharpe, max_drawdown FROM g JOIN dd USING (symbol))"""


@_query(f"WITH {_with(True)} SELECT symbol, seq, round(move / prev, 6) AS ret FROM r")
def a1_returns(spark, d):
    return A.returns(_quotes(spark, d, True)).select("symbol", "seq", F.round("ret", 6).alias("ret"))


@_query(f"WITH {_with(True)}, {_RISK} SELECT symbol, n, round(volatility, 6) AS volatility, round(max_drawdown, 6) AS max_drawdown, round(sharpe, 4) AS sharpe FROM risk")
def a2_a4_risk_metrics(spark, d):
    return A.risk_metrics(_quotes(spark, d, True)).select("symbol", "n", F.round("volatility", 6).alias("volatility"), F.round("max_drawdown", 6).alias("max_drawdown"), F.round("sharpe", 4).alias("sharpe"))


def _analysis_sql(calm: bool) -> str:
    return f"""WITH RECURSIVE {_with(calm)}, {_RSI}, {_MACD}, {_RISK},
    last AS (SELECT r.symbol, arg_max(rsi.rsi, rn) AS rsi, arg_max(line, rn) AS line, max(CASE WHEN rn = greatest(n - 8, 1) THEN line END) AS before FROM r JOIN rsi USING (symbol, rn) JOIN macd USING (symbol, rn) GROUP BY r.symbol),
    v AS (SELECT *, ((rsi < 30)::INT + (line > before)::INT) AS b, ((rsi > 70)::INT + (NOT line > before)::INT + (max_drawdown > 0.2)::INT) AS s FROM last JOIN risk USING (symbol)),
    w AS (SELECT *, CASE WHEN volatility > 0.5 THEN b // 2 ELSE b END AS buy FROM v)
    SELECT symbol, n, round(volatility, 6) AS volatility, round(sharpe, 4) AS sharpe, round(max_drawdown, 6) AS max_drawdown,
      CASE WHEN buy > s THEN 'Buy' WHEN s > buy THEN 'Sell' ELSE 'Hold' END AS recommendation, 100.0::DOUBLE AS confidence FROM w"""


def _analysis(spark, d, calm):
    out = A.analyse(_quotes(spark, d, calm))
    return out.select("symbol", "n", F.round("volatility", 6).alias("volatility"), F.round("sharpe", 4).alias("sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"), "recommendation", "confidence")


@_query(_analysis_sql(True))
def a5_a7_analysis(spark, d):
    return _analysis(spark, d, True)


@_query(_analysis_sql(False))
def a7_analysis_wild(spark, d):
    return _analysis(spark, d, False)


_NESTED = _analysis_sql(True).partition("    SELECT symbol, n, round(volatility")[0]


@_query(
    f"""{_NESTED}, k AS (SELECT r.symbol, r.rn, rsi, {_ma(20)} AS s20, {_ma(50)} AS s50, line FROM r JOIN rsi USING (symbol, rn) JOIN macd USING (symbol, rn)),
    x AS (SELECT symbol, rn, unnest(['RSI(14)', 'SMA(20)', 'SMA(50)', 'MACD(12,26,9)']) AS name, unnest([rsi, s20, s50, line]) AS value FROM k)
    SELECT x.symbol, name, rn - 1 AS position, value, CASE WHEN name = 'RSI(14)' THEN CASE WHEN value > 70 THEN 'Sell' WHEN value < 30 THEN 'Buy' ELSE 'Hold' END END AS signal,
      round(volatility, 6) AS volatility, round(max_drawdown, 6) AS max_drawdown, CASE WHEN buy > s THEN 'Buy' WHEN s > buy THEN 'Sell' ELSE 'Hold' END AS recommendation FROM x JOIN w USING (symbol)"""
)
def a7_analysis_nested(spark, d):
    """In chunks of 40 positions, so that most symbols have several rows."""
    out = A.analyse(_quotes(spark, d, True), nested=True, chunk=40).select("symbol", "first", "risk_metrics", "recommendation", F.explode("indicators").alias("i"))
    each = out.select("*", F.posexplode("i.values").alias("position", "value"))
    risk = [F.round(f"risk_metrics.{c}", 6).alias(c) for c in ("volatility", "max_drawdown")]
    return each.select("symbol", F.col("i.name").alias("name"), (F.col("first") + F.col("position")).alias("position"), "value", F.get("i.signals", "position").alias("signal"), *risk, "recommendation")


@_query(
    f"""WITH {_with(True)}, c AS (SELECT symbol, ts::DATE AS day, arg_max(price, (ts, seq)) AS close FROM quotes GROUP BY ALL),
    m AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM c), k AS (SELECT day, avg(ret) AS market FROM m WHERE ret IS NOT NULL GROUP BY day)
    SELECT symbol, round(CASE WHEN count(*) > 1 THEN covar_samp(ret, market) / var_samp(market) END, 4) AS beta FROM m JOIN k USING (day) WHERE ret IS NOT NULL GROUP BY symbol"""
)
def a8_beta(spark, d):
    return A.beta(_quotes(spark, d, True)).select("symbol", F.round("beta", 4).alias("beta"))


@_query(
    f"WITH {_with()} SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close, sum(volume)::BIGINT AS volume, round(sum(price * volume) / sum(volume), 4) AS vwap FROM r GROUP BY ALL"
)
def a9_bars(spark, d):
    return A.bars(_quotes(spark, d)).select("symbol", F.date_format("start", "yyyy-MM-dd").alias("day"), "open", "high", "low", "close", "volume", F.round("vwap", 4).alias("vwap"))


@_query(
    f"""WITH {_with()}, x AS (SELECT r.symbol, r_name AS industry, strftime(ts, '%Y-%m-%d') AS day, coalesce(price * volume * sign(move), 0) AS flow FROM r JOIN nation ON symbol::INT % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT industry, symbol, day, round(sum(flow), 2) AS flow FROM x GROUP BY ROLLUP (industry, symbol, day)"""
)
def a10_fund_flow(spark, d):
    out = A.fund_flow(_quotes(spark, d), _industries(spark, d))
    return out.select("industry", "symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("flow", 2).alias("flow"))


# Sources and sinks ---------------------------------------------------------------------------------------------------


@_query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def s1_parquet_scan(spark, d):
    S.register_history(spark, f"{d}/events.parquet")
    return Q.query(spark, "SELECT event_type, count(*) AS n FROM historical_data GROUP BY event_type")


@_query("SELECT count(*)::BIGINT AS events, 0::BIGINT AS quotes FROM events")
def s2_empty_table(spark, d):
    S.register_stock_quotes(spark)
    S.register_history(spark, f"{d}/events.parquet")
    return Q.query(spark, "SELECT (SELECT count(*) FROM historical_data) AS events, (SELECT count(*) FROM stock_quotes) AS quotes")


@_query(f"WITH {_with()} SELECT symbol, seq, price, volume, round(bid, 4) AS bid, round(ask, 4) AS ask, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low FROM quotes")
def s3_normalise(spark, d):
    return _quotes(spark, d).select("symbol", "seq", "price", "volume", *[F.round(c, 4).alias(c) for c in ("bid", "ask", "open", "high", "low")])


_folder = S.shared_folder


@_query(f"WITH {_with()} SELECT symbol, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, price, volume, round(open, 4) AS open, round(high, 4) AS high, round(CASE WHEN seq % 3 <> 0 THEN low END, 4) AS low FROM quotes")
def s4_csv_export(spark, d):
    path = _folder(spark, "csv")
    S.export_csv(_quotes(spark, d).withColumn("low", F.when(F.col("seq") % 3 != 0, F.col("low"))), path)
    schema = "symbol string, timestamp string, price double, volume bigint, open double, high double, low double"
    back = spark.read.option("header", True).schema(schema).csv(path)
    return back.select("symbol", "timestamp", "price", "volume", *[F.round(c, 4).alias(c) for c in ("open", "high", "low")])


@_query(f"WITH {_with()} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, price, volume, round(CASE WHEN seq % 3 <> 0 THEN bid END, 4) AS bid, round(ask, 4) AS ask, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low FROM quotes")
def s5_json_export(spark, d):
    path = _folder(spark, "json")
    S.export_json(_quotes(spark, d).withColumn("bid", F.when(F.col("seq") % 3 != 0, F.col("bid"))), path)
    back = spark.read.schema(QUOTE).json(path)
    return back.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "price", "volume", *[F.round(c, 4).alias(c) for c in ("bid", "ask", "open", "high", "low")])


@_query(
    """SELECT '{"event_id":' || event_id || ',"event_type":' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE '"' || event_type || '"' END || ',"half":' || (event_id % 1000) || '.5,"at":"'
    || strftime(ts, '%Y-%m-%d') || '","flag":' || (event_id % 2 = 0)::VARCHAR || ',"list":[' || event_id || ',null]}' AS json FROM events"""
)
def s6_rows_to_json(spark, d):
    e, k = _table(spark, d, "events"), F.col("event_id")
    kind = F.when(k % 4 != 0, F.col("event_type")).alias("event_type")
    return S.rows_to_json(e.select("event_id", kind, (k % 1000 + 0.5).alias("half"), F.to_date("ts").alias("at"), (k % 2 == 0).alias("flag"), F.array("event_id", F.lit(None).cast("long")).alias("list")))


def _streamed(spark, rows: DataFrame, pipeline, name: str, parts: int = 3, last: DataFrame | None = None, arrivals: list[DataFrame] | None = None) -> DataFrame:
    """Run a streaming pipeline over rows that arrive in parts by time, or as ``arrivals`` says, and read its Parquet sink.

    After every part the query ends; the next part is read by a new query from the same checkpoint, so state is carried over
    micro-batches and restarts. ``last`` is a part of its own.
    """
    T.use_rocksdb(spark)
    base = _folder(spark, name)
    cuts = rows.select(F.percentile_approx(F.unix_micros("ts"), [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    at = F.unix_micros("ts")
    edges = [None, *cuts, None]
    arrivals = arrivals or [rows.filter((F.lit(True) if a is None else at > a) & (F.lit(True) if b is None else at <= b)) for a, b in zip(edges, edges[1:])]
    for part in [*arrivals, *([last] if last is not None else [])]:
        part.repartition(4).write.mode("append").parquet(f"{base}/in")
        out = pipeline(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start(f"{base}/out")
        query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@_query(f"WITH {_with()} SELECT symbol, seq, price, 'test' AS source, '1' AS version, NULL AS quarantine_reason FROM quotes WHERE price > 0 AND seq % 50 <> 0 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, CASE WHEN seq % 50 = 0 THEN 'Message does not fit the schema' ELSE 'Price must be positive' END FROM quotes WHERE seq % 50 = 0 OR price <= 0")
def s7_topic_ingest(spark, d):
    """JSON messages, one in fifty of them broken, to the good rows with their envelope and the quarantined ones with their reason."""
    base, rows = _folder(spark, "topic"), _quotes(spark, d)
    message = F.when(F.col("seq") % 50 == 0, F.lit('{"symbol": 5')).otherwise(F.to_json(F.struct(*rows.columns)))
    rows.select(message.alias("value")).write.text(f"{base}/raw_quotes")
    S.ingest_topic(S.topic_stream(spark, "quotes", path=base), F.to_timestamp(F.lit("2100-01-01")), "test", f"{base}/normalized_quotes", f"{base}/quarantine", f"{base}/c")
    good, bad = (spark.read.parquet(f"{base}/{n}") for n in ("normalized_quotes", "quarantine"))
    none = F.lit(None).cast("string")
    sound = good.filter("ingest_ts is not null and length(payload_hash) = 64").select("symbol", "seq", "price", "source", "version", none.alias("quarantine_reason"))
    return sound.unionByName(bad.select("quarantine_reason"), allowMissingColumns=True)


_MIXED = f"""WITH {_with()}, q AS (SELECT 'quotes' AS type, CASE WHEN seq % 31 = 0 THEN '9' ELSE (seq % 3 + 1)::VARCHAR END AS version, price AS amount,
      CASE WHEN seq % 41 = 0 THEN 'Message is no envelope' WHEN seq % 31 = 0 THEN 'Unknown version' WHEN seq % 29 = 0 THEN 'Message does not fit the schema' WHEN price <= 0 THEN 'Price must be positive' WHEN seq % 3 > 0 AND seq % 23 = 0 THEN 'Bid is above ask' END AS reason, seq % 41 = 0 AS torn FROM quotes),
    n AS (SELECT 'news' AS type, (doc_id % 2 + 1)::VARCHAR AS version, doc_id::DOUBLE AS amount, CASE WHEN doc_id % 7 = 0 OR trim(coalesce(text, ''), ' ') = '' THEN 'Text is empty' END AS reason, false AS torn FROM documents),
    f AS (SELECT 'fundflow' AS type, (o_orderkey % 2 + 1)::VARCHAR AS version, round(o_totalprice, 2) AS amount, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 9 = 0 THEN 'Flow is negative' END AS reason, false AS torn FROM orders),
    u AS (SELECT 'weather' AS type, '1' AS version, n_nationkey::DOUBLE AS amount, 'Unknown topic' AS reason, false AS torn FROM nation),
    x AS (SELECT * FROM q UNION ALL SELECT * FROM n UNION ALL SELECT * FROM f UNION ALL SELECT * FROM u)
    SELECT type, CASE WHEN torn THEN NULL ELSE version END AS version, reason, count(*)::BIGINT AS n, round(sum(CASE WHEN reason IS NULL THEN amount ELSE 0 END), 2) AS amount FROM x GROUP BY ALL"""


@_query(_MIXED)
def s7_domains(spark, d):
    """Quotes in three versions, news and fund flows in two, and a topic that nobody knows, in one stream; some messages are bad."""
    base, q = _folder(spark, "topics"), _quotes(spark, d)
    envelope = lambda version, payload: F.to_json(F.struct(version.alias("version"), F.lit("test").alias("source"), payload.alias("payload")))
    seq, ms = F.col("seq"), F.unix_millis("ts").alias("at_ms")
    ask = F.when(seq % 23 == 0, F.col("bid") - 1).otherwise(F.col("ask")).alias("ask")
    shapes = [
        F.to_json(F.struct("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "seq", F.col("price").alias("price"), "volume", F.lit("x").alias("desk"))),
        F.to_json(F.struct("symbol", ms, "seq", F.col("price").alias("last"), "volume", "bid", ask)),
        F.to_json(F.struct(F.struct("symbol", F.lit("X").alias("exchange")).alias("instrument"), ms, "seq", F.col("price").alias("last"), F.col("volume").alias("size"), "bid", ask)),
    ]
    payload = F.when(seq % 3 == 0, shapes[0]).when(seq % 3 == 1, shapes[1]).otherwise(shapes[2])
    payload = F.when(seq % 29 == 0, F.lit('{"symbol": {"deep": 1}, "instrument": 3, "at_ms": "x"}')).otherwise(payload)
    said = F.when(seq % 41 == 0, F.lit("torn {")).otherwise(envelope(F.when(seq % 31 == 0, "9").otherwise((seq % 3 + 1).cast("string")), payload))
    q.select(said.alias("value")).write.text(f"{base}/in/raw_quotes")
    doc, body = _table(spark, d, "documents"), F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    news = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("doc_id").alias("id"), body.alias("text"), "lang"))).otherwise(F.to_json(F.struct(F.col("doc_id").alias("id"), body.alias("body"), F.col("lang").alias("language"), F.col("source").alias("origin"))))
    doc.select(envelope((F.col("doc_id") % 2 + 1).cast("string"), news).alias("value")).write.text(f"{base}/in/raw_news")
    o, key, total = _table(spark, d, "orders"), F.col("o_orderkey"), F.round("o_totalprice", 2)
    who, day = F.col("o_custkey").cast("string").alias("symbol"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    flow = F.when(key % 2 == 0, F.to_json(F.struct(who, day, (-total).alias("net")))).otherwise(F.to_json(F.struct(who, day, F.when(key % 9 == 0, -1.0).otherwise(total).alias("inflow"), F.lit(0.0).alias("outflow"))))
    o.select(envelope((key % 2 + 1).cast("string"), flow).alias("value")).write.text(f"{base}/in/raw_fundflow")
    _table(spark, d, "nation").select(envelope(F.lit("1"), F.lit("{}")).alias("value")).write.text(f"{base}/in/raw_weather")
    TP.ingest(TP.raw_topics(spark, f"{base}/in"), f"{base}/out", f"{base}/c")
    amounts = {"quotes": F.col("price"), "news": F.col("id").cast("double"), "fundflow": F.col("inflow") + F.col("outflow")}
    none = F.lit(None).cast("string").alias("reason")
    rows = TP.quarantine_table(spark, f"{base}/out").select("type", "version", "reason", F.lit(0.0).alias("amount"))
    for name, amount in amounts.items():
        rows = rows.union(TP.normalized_table(spark, f"{base}/out", name).select(F.lit(name), "version", none, amount))
    return rows.groupBy("type", "version", "reason").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@_query(f"WITH {_with()} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, sum(volume)::BIGINT AS volume FROM quotes GROUP BY ALL")
def s8_s9_lake(spark, d):
    """The lake's first day is written with wrong volumes, and recomputed."""
    path, quotes = _folder(spark, "lake"), _quotes(spark, d)
    first = quotes.agg(F.date_format(F.min("ts"), "yyyy-MM-dd")).first()[0]
    wrong = F.when(F.to_date("ts") == F.lit(first).cast("date"), F.col("volume") + 7).otherwise(F.col("volume"))
    S.write_lake(quotes.withColumn("volume", wrong), path, F.lit("X"), overwrite=True)
    S.recompute(quotes, path, [first], F.lit("X"))
    return spark.read.parquet(path).groupBy(F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


_REFRESHED = ["ema", "rsi", "macd", "macd_signal", "macd_histogram"]
_REFRESHED_SQL = f"WITH RECURSIVE {_with()}, {_RSI}, {_MACD}, e12 AS ({_EMA(12)}) SELECT symbol, seq, {_ma(20)} AS sma, e12.v AS ema, rsi, line AS macd, sig AS macd_signal, {_HISTOGRAM} AS macd_histogram FROM r JOIN rsi USING (symbol, rn) JOIN macd USING (symbol, rn) JOIN e12 USING (symbol, rn)"


@_query(_REFRESHED_SQL)
def s9_incremental(spark, d):
    """Indicators of a lake that first lacks some quotes and has a day of wrong prices; both are mended, each followed by a refresh."""
    lake, out, quotes = _folder(spark, "lake"), _folder(spark, "refreshed"), _quotes(spark, d)
    middle = quotes.agg(F.date_format(F.timestamp_micros(F.percentile_approx(F.unix_micros("ts"), 0.5)), "yyyy-MM-dd")).first()[0]
    on = F.to_date("ts") == F.lit(middle).cast("date")
    late = on & (F.col("seq") % 3 == 0)
    S.write_lake(quotes.filter(~late).withColumn("price", F.when(on, F.col("price") + 1).otherwise(F.col("price"))), lake, F.lit("X"))
    I.refresh(spark, lake, out, buckets=4)
    for rows in (quotes.filter(~late), quotes):
        S.recompute(rows, lake, [middle], F.lit("X"))
        I.refresh(spark, lake, out, buckets=4)
    return I.results(spark, out).select("symbol", "seq", "sma", *_REFRESHED)


# Filters -------------------------------------------------------------------------------------------------------------


@_query(f"WITH {_with()} SELECT symbol, seq, price FROM quotes WHERE symbol IN ('1', '2', '3')")
def f1_symbols(spark, d):
    return L.by_symbols(_quotes(spark, d), ["1", "2", "3"]).select("symbol", "seq", "price")


@_query(f"WITH {_with()} SELECT symbol, seq FROM quotes WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def f2_time_range(spark, d):
    return L.time_range(_quotes(spark, d), F.to_timestamp(F.lit("2024-01-05")), F.to_timestamp(F.lit("2024-01-10"))).select("symbol", "seq")


@_query(f"WITH {_with()} SELECT symbol, seq FROM quotes WHERE hour(ts) * 60 + minute(ts) BETWEEN 870 AND 1260")
def f3_session(spark, d):
    return L.trading_session(_quotes(spark, d)).select("symbol", "seq")


@_query(f"WITH {_with()} SELECT symbol, max_by(seq, rn) AS seq, max_by(price, rn) AS price FROM r GROUP BY symbol UNION ALL SELECT 'none', NULL, NULL")
def f4_latest(spark, d):
    quotes = _quotes(spark, d)
    wanted = quotes.select("symbol").distinct().union(spark.createDataFrame([("none",)], "symbol string"))
    return L.latest(quotes, wanted).select("symbol", "seq", "price")


@_query(f"WITH {_with()} SELECT symbol, seq FROM quotes WHERE price > 10 ORDER BY ts, seq LIMIT 50 OFFSET 100")
def f5_page(spark, d):
    return L.page(_quotes(spark, d), 50, 2, F.col("price") > 10).select("symbol", "seq")


@_query(f"WITH {_with()}, a AS (SELECT ts, seq FROM quotes ORDER BY ts, seq LIMIT 1 OFFSET 100) SELECT symbol, q.seq FROM quotes q, a WHERE price > 10 AND (q.ts > a.ts OR q.ts = a.ts AND q.seq > a.seq) ORDER BY q.ts, q.seq LIMIT 50")
def f5_next_page(spark, d):
    quotes = _quotes(spark, d)
    last = L.page(quotes, 1, 100).select("ts", "seq").first()
    return L.next_page(quotes, 50, F.lit(last.ts), F.lit(last.seq), F.col("price") > 10).select("symbol", "seq")


@_query(f"WITH {_with(True)}, {_RISK} SELECT symbol, round(volatility, 6) AS volatility FROM risk ORDER BY volatility DESC, symbol LIMIT 10")
def f6_top_symbols(spark, d):
    return L.top_symbols(A.risk_metrics(_quotes(spark, d, True)), "volatility", 10).select("symbol", F.round("volatility", 6).alias("volatility"))


# Scalar functions in their jobs --------------------------------------------------------------------------------------


@_query("SELECT event_id, round(value * 10::DOUBLE) / 10::DOUBLE AS rounded, CASE WHEN value = 0 THEN 0 ELSE round((value * 1.1::DOUBLE - value) / value * 100, 6) END AS percent, CASE WHEN event_id % 3 = 0 THEN -1::DOUBLE ELSE round(value / (event_id % 3), 6) END AS divided FROM events")
def x1_x3_numbers(spark, d):
    e, v = _table(spark, d, "events"), F.col("value")
    return e.select("event_id", X.round_to(v, 1).alias("rounded"), F.round(X.percent_change(v, v * 1.1), 6).alias("percent"), F.round(X.safe_divide(v, (F.col("event_id") % 3).cast("double"), -1.0), 6).alias("divided"))


@_query("SELECT event_id, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS at, strftime(ts + to_days(CASE isodow(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END), '%Y-%m-%d %H:%M:%S') AS next_session FROM events")
def x4_x6_times(spark, d):
    f = "yyyy-MM-dd HH:mm:ss"
    at = F.to_utc_timestamp(X.from_epoch_millis(F.col("event_id") * 1000), F.current_timezone())
    return _table(spark, d, "events").select("event_id", F.date_format(at, f).alias("at"), F.date_format(X.next_trading_day(F.col("ts").cast("timestamp")), f).alias("next_session"))


@_query(
    r"SELECT s_suppkey, CASE WHEN octet_length(encode(s_name)) <= 12 THEN s_name ELSE substr(s_name, 1, 9) || '...' END AS short, regexp_replace(s_name, '\s', '', 'g') AS trimmed, octet_length(encode(s_name)) <= 10 AND regexp_full_match(s_name, '[\p{L}\p{N}.]+') AS valid, '$' || printf('%.2f', s_acctbal) AS money FROM supplier"
)
def x7_x10_texts(spark, d):
    s, name = _table(spark, d, "supplier"), F.col("s_name")
    return s.select("s_suppkey", X.safe_truncate(name, 12).alias("short"), X.trim_whitespace(name).alias("trimmed"), X.is_valid_symbol(name).alias("valid"), X.format_currency(F.col("s_acctbal"), F.lit("usd")).alias("money"))


# A session calendar: weekdays without every month's 15th and last Friday of January 2024; symbols trade on it with gaps.
_SESSIONS = f"""{_with()}, c AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM quotes), (SELECT max(ts)::DATE FROM quotes), INTERVAL 1 DAY))::DATE AS day)
      WHERE isodow(day) < 6 AND day(day) <> 15 AND day <> DATE '2024-01-26'),
    h AS (SELECT DISTINCT symbol, ts::DATE AS day FROM quotes), p AS (SELECT symbol, day, n FROM h JOIN c USING (day))"""


def _calendar(spark, quotes):
    first, last = quotes.agg(F.min(F.to_date("ts")).cast("string"), F.max(F.to_date("ts")).cast("string")).first()
    span = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    holidays = spark.range(1).select(F.explode(span).alias("day")).filter((F.day("day") == 15) | (F.col("day") == F.lit("2024-01-26").cast("date")))
    return C.sessions(spark, F.lit(first), F.lit(last), holidays)


def _days(rows, *columns):
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


@_query(f"WITH {_SESSIONS}, g AS (SELECT symbol, n, lag(n) OVER (PARTITION BY symbol ORDER BY n) AS before FROM p) SELECT symbol, strftime(a.day, '%Y-%m-%d') AS first_day, strftime(b.day, '%Y-%m-%d') AS last_day, (g.n - before - 1)::BIGINT AS sessions FROM g JOIN c a ON a.n = before + 1 JOIN c b ON b.n = g.n - 1 WHERE g.n - before > 1")
def x6_missing_sessions(spark, d):
    q = _quotes(spark, d)
    return _days(C.missing_sessions(q, _calendar(spark, q)), "first_day", "last_day")


@_query(f"WITH {_SESSIONS}, g AS (SELECT *, n - row_number() OVER (PARTITION BY symbol ORDER BY n) AS island FROM p) SELECT symbol, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*)::BIGINT AS sessions FROM g GROUP BY symbol, island")
def x6_session_runs(spark, d):
    q = _quotes(spark, d)
    return _days(C.session_runs(q, _calendar(spark, q)), "first_day", "last_day")


@_query(f"WITH {_SESSIONS} SELECT symbol, seq, strftime((SELECT min(day) FROM c WHERE day > ts::DATE), '%Y-%m-%d') AS next_session FROM quotes")
def x6_next_session(spark, d):
    q = _quotes(spark, d)
    return _days(C.next_session(q, _calendar(spark, q)).select("symbol", "seq", "next_session"), "next_session")


@_query(f"WITH {_SESSIONS} SELECT symbol, count(*)::BIGINT AS quotes FROM quotes WHERE ts::DATE NOT IN (SELECT day FROM c) GROUP BY symbol")
def x6_off_session(spark, d):
    q = _quotes(spark, d)
    return C.off_session(q, _calendar(spark, q))


# Quality -------------------------------------------------------------------------------------------------------------


def _raw(spark, d):
    q = _quotes(spark, d)
    return q.withColumns({"symbol": F.when(F.col("seq") % 5 == 0, "").when(F.col("seq") % 5 == 1, " a b ").otherwise(F.col("symbol")), "price": F.when(F.col("seq") % 7 == 0, -F.col("price")).when(F.col("seq") % 11 == 0, F.lit(2e6)).otherwise(F.col("price"))})


_RAW = "raw AS (SELECT seq, ts, volume, CASE seq % 5 WHEN 0 THEN '' WHEN 1 THEN ' a b ' ELSE symbol END AS symbol, CASE WHEN seq % 7 = 0 THEN -price WHEN seq % 11 = 0 THEN 2e6::DOUBLE ELSE price END AS price FROM quotes)"
_REASON = f"CASE WHEN symbol = '' THEN 'Symbol cannot be empty' WHEN price <= 0 THEN 'Price must be positive' WHEN ts > TIMESTAMP '{NOW}' THEN 'Timestamp cannot be in the future' END"


@_query(f"WITH {_with()}, {_RAW} SELECT seq, {_REASON} AS reject_reason, CASE WHEN price <= 0 THEN 'Price must be positive' WHEN price > 1000000 THEN 'Price seems unreasonably high' END AS range_reason FROM raw")
def v1_v2_validation(spark, d):
    return V.check_price_range(V.validate(_raw(spark, d), F.to_timestamp(F.lit(NOW)))).select("seq", "reject_reason", "range_reason")


@_query(f"WITH {_with()}, {_RAW} SELECT seq, replace(symbol, ' ', '') AS symbol, CASE WHEN symbol = '' THEN 'Symbol is not valid' END AS symbol_reason FROM raw")
def v3_symbols(spark, d):
    return V.clean_symbols(_raw(spark, d)).select("seq", "symbol", "symbol_reason")


@_query(f"WITH {_with()}, {_RAW} SELECT seq, coalesce({_REASON}, CASE WHEN price > 1000000 THEN 'Price seems unreasonably high' END) IS NOT NULL AS bad FROM raw")
def v4_quarantine(spark, d):
    good, bad = V.quarantine_split(_raw(spark, d), F.to_timestamp(F.lit(NOW)))
    return good.select("seq", F.lit(False).alias("bad")).union(bad.select("seq", F.lit(True)))


@_query(
    f"""WITH {_with()}, h AS (SELECT symbol, ts, seq, price, CASE WHEN seq % 3 = 0 THEN bid END AS bid, CASE WHEN seq % 4 = 0 THEN open END AS open FROM quotes)
    SELECT seq, round(last_value(bid IGNORE NULLS) OVER w, 4) AS bid, round(coalesce(last_value(open IGNORE NULLS) OVER w, price), 4) AS open FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"""
)
def v5_fill(spark, d):
    holes = _quotes(spark, d).withColumns({"bid": F.when(F.col("seq") % 3 == 0, F.col("bid")), "open": F.when(F.col("seq") % 4 == 0, F.col("open"))})
    return V.fill_missing(holes).select("seq", F.round("bid", 4).alias("bid"), F.round("open", 4).alias("open"))


@_query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS symbol, event_type FROM events")
def v6_duplicates(spark, d):
    e = _table(spark, d, "events").select(F.col("user_id").cast("string").alias("symbol"), "event_type")
    return V.remove_duplicates(e).select("symbol", "event_type")


@_query(f"WITH {_with()} SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS staged, count(*) FILTER (seq % 10 <> 0)::BIGINT AS kept, count(*) FILTER (seq % 10 = 0)::BIGINT AS missing FROM quotes GROUP BY ALL")
def v7_reconcile(spark, d):
    q = _quotes(spark, d)
    return V.reconcile(q, q.filter("seq % 10 <> 0")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@_query(f"WITH {_with()} SELECT seq, CASE WHEN symbol::INT % 25 = 0 THEN 'unknown' ELSE r_name END AS industry FROM quotes JOIN nation ON symbol::INT % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def v8_industry(spark, d):
    known = _industries(spark, d).filter(F.col("symbol").cast("int") % 25 != 0)
    return V.map_industry(_quotes(spark, d), known).select("seq", "industry")


@_query(f"WITH {_with()}, f AS (SELECT symbol, ts AS ex_ts, 0.9::DOUBLE AS factor FROM quotes WHERE seq % 20 = 0) SELECT seq, round(price * power(0.9::DOUBLE, (SELECT count(*) FROM f WHERE f.symbol = quotes.symbol AND ex_ts > ts)), 4) AS adjusted_price FROM quotes")
def v9_adjusted(spark, d):
    q = _quotes(spark, d)
    factors = q.filter("seq % 20 = 0").select("symbol", F.col("ts").alias("ex_ts"), F.lit(0.9).alias("factor"))
    return V.adjusted_price(q, factors).select("seq", F.round("adjusted_price", 4).alias("adjusted_price"))


_WANTED = [(1, "the of and"), (2, "que los"), (3, "licensed apache license")]


@_query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents),
    q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'of'), (1, 'and'), (2, 'que'), (2, 'los'), (3, 'licensed'), (3, 'apache'), (3, 'license')) v(query_id, term)),
    tf AS (SELECT term, doc_id, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT query_id, doc_id, round(sum(tf * ln((SELECT count(*) FROM documents)::DOUBLE / df)), 4) AS score FROM tf JOIN df USING (term) JOIN q USING (term) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT query_id, rank, doc_id, score FROM k WHERE rank <= 10"""
)
def d1_search(spark, d):
    wanted = spark.createDataFrame(_WANTED, "query_id int, query string")
    return D.search(_table(spark, d, "documents"), wanted).select("query_id", "rank", "doc_id", "score")


def _indexed(spark, d, name: str) -> str:
    """An index of all documents in two segments: the even ids, then the odd ones."""
    path, docs = _folder(spark, name), _table(spark, d, "documents")
    for k in (0, 1):
        TI.add_segment(docs.filter(F.pmod("doc_id", F.lit(2)) == k), path)
    return path


@_query(SQL["d1_search"])
def d1_index_search(spark, d):
    """The same answers from a stored index of two segments."""
    path = _indexed(spark, d, "index")
    return TI.search_index(spark, path, spark.createDataFrame(_WANTED, "query_id int, query string")).select("query_id", "rank", "doc_id", "score")


@_query(SQL["d1_search"])
def d1_index_merged(spark, d):
    """And after the segments have been merged and the old files deleted."""
    path = _indexed(spark, d, "merged")
    TI.merge_segments(spark, path)
    TI.vacuum(spark, path)
    return TI.search_index(spark, path, spark.createDataFrame(_WANTED, "query_id int, query string")).select("query_id", "rank", "doc_id", "score")


@_query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents), t AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY ALL)
    SELECT term, count(*)::BIGINT AS documents, sum(tf)::BIGINT AS occurrences, max(tf)::BIGINT AS most FROM t GROUP BY term"""
)
def d1_index_terms(spark, d):
    """Every term that the index knows."""
    return TI.term_statistics(spark, _indexed(spark, d, "terms"))


# Streams -------------------------------------------------------------------------------------------------------------

_DAY = 24 * T.HOUR
_TICKS = f"WITH {_with()} SELECT symbol, seq, round(move, 6) AS change, round(move / prev * 100, 6) AS change_percent FROM r"


def _changes(rows):
    return rows.select("symbol", "seq", F.round("change", 6).alias("change"), F.round("change_percent", 6).alias("change_percent"))


@_query(_TICKS)
def t1_changes(spark, d):
    return _changes(T.tick_changes(_quotes(spark, d)))


@_query(_TICKS)
def t1_changes_stream(spark, d):
    q = _quotes(spark, d)
    out = _streamed(spark, q, lambda s: T.stream_tick_changes(s, width=_DAY), "changes", last=T.closing_row(q))
    return _changes(out.filter("symbol <> '' and not late"))


@_query(_TICKS)
def t1_shuffled_stream(spark, d):
    """Each part holds rows of all times in no order, within the lateness that is allowed: the changes are those of the ordered ticks."""
    q = _quotes(spark, d)
    parts = [q.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == k) for k in range(3)]
    out = _streamed(spark, q, lambda s: T.stream_tick_changes(s, "400 days", _DAY), "shuffled", last=T.closing_row(q, delay="400 days"), arrivals=parts)
    return _changes(out.filter("symbol <> '' and not late"))


_LATE = "x AS (SELECT *, seq % 25 = 0 AND ts < (SELECT to_timestamp((epoch(min(ts)) + epoch(max(ts))) / 2) AT TIME ZONE 'UTC' FROM quotes) AS late FROM quotes)"


@_query(f"WITH {_with()}, {_LATE}, y AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol, late ORDER BY ts, seq) AS move FROM x) SELECT symbol, count(*) FILTER (late)::BIGINT AS late, count(*) FILTER (NOT late)::BIGINT AS on_time, round(coalesce(sum(abs(move)) FILTER (NOT late), 0), 4) AS moved FROM y GROUP BY symbol")
def t1_late_rows(spark, d):
    """Some rows of the first half arrive after all others: they are counted by symbol and change no other row."""
    q = _quotes(spark, d)
    low, high = q.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    late = F.coalesce((F.col("seq") % 25 == 0) & (F.unix_micros("ts") < F.lit(((low or 0) + (high or 0)) / 2)), F.lit(False))
    out = _streamed(spark, q, lambda s: T.stream_tick_changes(s, width=_DAY), "late", last=T.closing_row(q), arrivals=[q.filter(~late), q.filter(late)]).filter("symbol <> ''")
    moved = F.round(F.coalesce(F.sum(F.when(~F.col("late"), F.abs("change"))), F.lit(0.0)), 4).alias("moved")
    return out.groupBy("symbol").agg(F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("on_time"), moved)


_SUBS = "subs AS (SELECT c AS client_id, symbol FROM (SELECT DISTINCT symbol FROM quotes), range(3) t(c) WHERE symbol::INT % 3 = c OR c = 0)"


def _subscriptions(spark, quotes):
    each = quotes.select("symbol").distinct().crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "client_id")))
    on = each.filter((F.col("symbol").cast("int") % 3 == F.col("client_id")) | (F.col("client_id") == 0))
    said = on.select("client_id", F.array("symbol").alias("symbols"), F.lit(None).cast("string").alias("action"), F.lit(1).alias("at"))
    gone = each.filter("client_id = 1 and cast(symbol as int) % 3 = 0").select("client_id", F.array("symbol").alias("symbols"), F.lit("unsubscribe").alias("action"), F.lit(2).alias("at"))
    return T.current_subscriptions(said.union(gone))


@_query(f"WITH {_with()}, {_SUBS} SELECT client_id, seq FROM subs JOIN quotes USING (symbol)")
def t2_subscriptions(spark, d):
    q = _quotes(spark, d)
    return T.for_subscribers(q, _subscriptions(spark, q)).select("client_id", "seq")


@_query(f"WITH {_with()}, {_SUBS} SELECT symbol, count(DISTINCT client_id)::BIGINT AS subscribers FROM subs GROUP BY symbol")
def t8_subscribers(spark, d):
    return T.subscriber_counts(_subscriptions(spark, _quotes(spark, d)))


@_query(f"WITH {_with()} SELECT symbol, seq, consumer FROM quotes, (VALUES ('a'), ('b')) v(consumer)")
def t3_fan_out(spark, d):
    q, base = _quotes(spark, d), _folder(spark, "fan")
    q.write.mode("overwrite").parquet(f"{base}/in")
    stream = spark.readStream.schema(q.schema).parquet(f"{base}/in")
    sink = lambda name: lambda df, k: df.select("symbol", "seq", F.lit(name).alias("consumer")).write.mode("overwrite").parquet(f"{base}/{name}/{k}")
    for query in T.fan_out(stream, {n: sink(n) for n in ("a", "b")}, f"{base}/c"):
        query.processAllAvailable()
        query.stop()
    return spark.read.parquet(f"{base}/a/*", f"{base}/b/*")


@_query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS symbol, event_type FROM events")
def t4_dedup_stream(spark, d):
    q = _table(spark, d, "events").select(F.col("user_id").cast("string").alias("symbol"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows = V.payload_hash(q, ["symbol", "event_type"])
    return _streamed(spark, rows, lambda s: T.dedup_stream(s, "400 days"), "dedup").select("symbol", "event_type")


@_query(f"WITH RECURSIVE {_with()}, {_RSI}, {_MACD}, e12 AS ({_EMA(12)}) SELECT symbol, seq, {_ma(20)} AS sma, e12.v AS ema, rsi, line AS macd, sig AS macd_signal, {_HISTOGRAM} AS macd_histogram FROM r JOIN rsi USING (symbol, rn) JOIN macd USING (symbol, rn) JOIN e12 USING (symbol, rn)")
def t5_live_indicators(spark, d):
    q = _quotes(spark, d)
    out = _streamed(spark, q, lambda s: T.stream_indicators(s, width=_DAY), "live", last=T.closing_row(q))
    return out.filter("symbol <> '' and not late").select("symbol", "seq", "sma", "ema", "rsi", "macd", "macd_signal", "macd_histogram")


_ALERTS = "alerts AS (SELECT symbol || '_' || (1704067200 + k) AS alert_id, symbol, CASE k WHEN 0 THEN 'above' ELSE 'below' END AS alert_type, CASE k WHEN 0 THEN avg(price) * 2 ELSE avg(price) / 4 END AS target FROM quotes, range(2) t(k) GROUP BY symbol, k)"


def _alerts(quotes):
    mean = quotes.groupBy("symbol").agg(F.avg("price").alias("m"))
    at = F.to_timestamp(F.lit("2024-01-01"))
    one = lambda kind, target, secs: mean.select("symbol", target.alias("target_price"), F.lit(kind).alias("alert_type"), (at + F.expr(f"INTERVAL {secs} SECONDS")).alias("created_at"), F.lit(True).alias("active"))
    return T.alert_table(one("above", F.col("m") * 2, 0).union(one("below", F.col("m") / 4, 1)).union(one("below", F.col("m") * 0, 1)))


_HITS = f"WITH {_with()}, {_ALERTS}, h AS (SELECT alert_id, r.symbol, rn, seq, price FROM r JOIN alerts a ON r.symbol = a.symbol AND ((alert_type = 'above' AND price >= target) OR (alert_type = 'below' AND price <= target))) SELECT alert_id, arg_min(price, rn) AS price FROM h GROUP BY alert_id"


@_query(_HITS)
def t6_alerts(spark, d):
    q = _quotes(spark, d)
    return T.first_hits(q, _alerts(q)).select("alert_id", "price")


def _alert_stream(spark, d, name: str, more: DataFrame | None = None) -> DataFrame:
    """Hits of the alert book: alerts are set a day before the first tick, and arrive as a stream of their own; ``more`` are later actions."""
    q = _quotes(spark, d)
    table, first = _alerts(q).filter("active"), q.agg(F.min("ts").alias("first"))
    said = table.join(first).select("symbol", (F.col("first") - F.expr("INTERVAL 1 DAY")).alias("ts"), "alert_id", F.col("alert_type").alias("action"), "target_price")
    said = said if more is None else said.unionByName(more)
    path = f"{_folder(spark, name)}/alerts"
    said.write.parquet(path)
    run = lambda s: T.fire_once(s, spark.readStream.schema(said.schema).parquet(path), width=_DAY)
    return _streamed(spark, q, run, name, last=T.closing_row(q)).filter("symbol <> '' and not late").select("alert_id", "price")


@_query(_HITS)
def t6_alerts_stream(spark, d):
    return _alert_stream(spark, d, "alerts")


_CANCELLED = "CASE WHEN symbol::INT % 2 = 0 THEN (SELECT min(ts) FROM quotes) + INTERVAL 36 HOUR ELSE TIMESTAMP '2100-01-01' END"


@_query(_HITS.replace("price <= target)))", f"price <= target)) AND r.ts < {_CANCELLED.replace('symbol', 'r.symbol')})"))
def t6_alerts_cancelled(spark, d):
    """The alerts of every other symbol are cancelled a day and a half after the first tick."""
    q = _quotes(spark, d)
    even = _alerts(q).filter("active and cast(symbol as int) % 2 = 0").join(q.agg((F.min("ts") + F.expr("INTERVAL 36 HOURS")).alias("ts")))
    return _alert_stream(spark, d, "cancelled", even.select("symbol", "ts", "alert_id", F.lit("cancel").alias("action"), F.lit(None).cast("double").alias("target_price")))


@_query(SQL["a9_bars"].replace(", round(sum(price * volume) / sum(volume), 4) AS vwap", ""))
def t7_bars_stream(spark, d):
    """All bars, the last day's too: a closing row ends the stream."""
    q = _quotes(spark, d)
    bars = _streamed(spark, q, T.stream_bars, "bars", last=T.closing_row(q)).filter("symbol <> ''")
    return bars.select("symbol", F.date_format("start", "yyyy-MM-dd").alias("day"), "open", "high", "low", "close", "volume")


# Relational surface --------------------------------------------------------------------------------------------------


def _sql(name: str, spark_text: str, duck_text: str | None = None, oracle: bool = True):
    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            if t in spark_text:
                _table(spark, d, t).createOrReplaceTempView(t)
        return Q.query(spark, spark_text)

    run.__name__ = name
    QUERIES[name] = run
    if oracle:
        SQL[name] = duck_text or spark_text


_sql("q2_filter", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS kind FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.02 AND 0.08 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%'")
_sql(
    "q3_joins",
    """SELECT 'left' AS kind, c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
    UNION ALL SELECT 'inner', c_custkey, count(*) FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
    UNION ALL SELECT 'right', o_orderkey, count(c_custkey) FROM (SELECT * FROM customer WHERE c_nationkey < 5) c RIGHT JOIN orders ON c_custkey = o_custkey GROUP BY o_orderkey
    UNION ALL SELECT 'full', coalesce(s_nationkey, c_nationkey), count(*) FROM (SELECT * FROM supplier WHERE s_nationkey < 15) s FULL JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey > 10) c ON s_nationkey = c_nationkey GROUP BY coalesce(s_nationkey, c_nationkey)""",
)
_sql("q4_semi_anti", "SELECT c_custkey, true AS has FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
_sql("q5_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, s_suppkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN supplier ON s_nationkey = a.n_nationkey")
_sql("q5_cross", "SELECT r_name, n_name, r_regionkey = n_regionkey AS own FROM region CROSS JOIN nation")
_sql("q5_range_join", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_acctbal BETWEEN n_nationkey * 400 - 1000 AND n_nationkey * 400 - 500")
_sql("q6_group", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
_REGIONS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_sql("q7_grouping_sets", f"SELECT r_name, n_name, count(*) AS n FROM {_REGIONS} GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())")
_sql("q7_cube", f"SELECT r_name, c_mktsegment, count(*) AS n, CAST(grouping(r_name) AS INT) AS all_regions FROM {_REGIONS} GROUP BY CUBE (r_name, c_mktsegment)")
_sql("q7_rollup", f"SELECT r_name, n_name, round(sum(c_acctbal), 2) AS balance FROM {_REGIONS} GROUP BY ROLLUP (r_name, n_name)")
_sql("q8_approximate", "SELECT event_type, approx_count_distinct(user_id) AS users, percentile_approx(value, 0.5) AS middle FROM events GROUP BY event_type", oracle=False)
_sql(
    "q8_tolerance",
    """SELECT event_type, abs(approx_count_distinct(user_id, 0.02) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS users_near,
    sum(CASE WHEN value <= middle THEN 1 ELSE 0 END) BETWEEN 0.49 * count(*) AND 0.51 * count(*) + 1 AS middle_near
    FROM events JOIN (SELECT event_type AS t, percentile_approx(value, 0.5, 1000) AS middle FROM events GROUP BY event_type) m ON event_type = t GROUP BY event_type""",
    "SELECT event_type, true AS users_near, true AS middle_near FROM events GROUP BY event_type",
)
@_query(
    """WITH w AS (SELECT event_type, user_id, value, ((ts::DATE - (SELECT min(ts)::DATE FROM events)) // 7)::INT AS week FROM events)
    SELECT event_type, week, count(*)::BIGINT AS rows, min(value) AS low, max(value) AS high, true AS users_near, true AS middle_near FROM w GROUP BY ALL"""
)
def q8_merged_sketches(spark, d):
    """Sketches by day and type, written, then merged by week; their estimates are held against the exact values of the week."""
    e = _table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = S.staged(K.daily_sketches(e, ["event_type"], "ts", "user_id", "value"), "sketches")
    first = kept.agg(F.min("day").cast("string")).first()[0]
    week = lambda c: F.floor(F.date_diff(c, F.lit(first).cast("date")) / 7).cast("int").alias("week")
    by = ["event_type", "week"]
    found = K.estimates(K.merged(kept.withColumn("week", week(F.col("day"))), by), by, {"middle": 0.5})
    exact = e.withColumn("week", week(F.to_date("ts")))
    users = exact.groupBy(*by).agg(F.count_distinct("user_id").alias("users"))
    below = exact.join(found.select(*by, "middle"), by).groupBy(*by).agg(F.count_if(F.col("value") <= F.col("middle")).alias("upto"), F.count_if(F.col("value") < F.col("middle")).alias("under"))
    near = [(F.abs(F.col("distinct") - F.col("users")) <= 1 + 0.05 * F.col("users")).alias("users_near"), ((F.col("upto") >= 0.48 * F.col("rows") - 1) & (F.col("under") <= 0.52 * F.col("rows") + 1)).alias("middle_near")]
    return found.join(users, by).join(below, by).select(*by, "rows", "low", "high", *near)


_sql(
    "q9_windows",
    """SELECT o_custkey, o_orderkey, row_number() OVER w AS number, rank() OVER w AS place, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dense, ntile(4) OVER w AS quarter,
    lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
    count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 20000 PRECEDING AND 20000 FOLLOWING) AS near, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS around
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""",
)
_sql("q9_top_per_group", "SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) x WHERE n <= 3")
_sql("q10_top", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10 OFFSET 5")
_sql("q11_sets", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
_sql("q12_subqueries", "WITH m AS (SELECT o_custkey AS c, avg(o_totalprice) AS a FROM orders GROUP BY o_custkey) SELECT o_orderkey FROM orders JOIN m ON o_custkey = c WHERE o_totalprice > a AND o_totalprice > (SELECT min(o_totalprice) FROM orders)")
_sql(
    "q13_functions",
    "SELECT event_id, upper(event_type) AS kind, date_format(date_trunc('MONTH', ts), 'yyyy-MM-dd') AS month, length(props) AS n, size(split(event_type, 'e')) AS parts, sqrt(abs(value)) AS root FROM events",
    "SELECT event_id, upper(event_type) AS kind, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, length(props)::INT AS n, len(string_split(event_type, 'e'))::INT AS parts, sqrt(abs(value)) AS root FROM events",
)


_sql(
    "q13_nested",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, array_max(array(event_id, user_id, 500)) AS top, element_at(map('a', event_id, 'b', user_id), 'b') AS b, size(map_keys(map('a', 1, 'b', 2))) AS keys, array_join(array_sort(array(event_type, 'm')), '-') AS sorted, array_contains(split(event_type, 'i'), 'cl') AS cut FROM events",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, list_max([event_id, user_id, 500]) AS top, map {'a': event_id, 'b': user_id}['b'] AS b, 2 AS keys, array_to_string(list_sort([event_type, 'm']), '-') AS sorted, list_contains(string_split(event_type, 'i'), 'cl') AS cut FROM events",
)


@_query("SELECT 1 AS test_column, count(*)::BIGINT AS n FROM events")
def q1_adhoc(spark, d):
    S.register_history(spark, f"{d}/events.parquet")
    return Q.query(spark, "SELECT 1 AS test_column, count(*) AS n FROM historical_data")


def _quotes_view(spark, d) -> None:
    Q.register_table_functions(spark)
    _quotes(spark, d).createOrReplaceTempView("quotes")


@_query(SQL["w3_ema"].replace("ema_12", "ema"))
def u1_table_functions(spark, d):
    _quotes_view(spark, d)
    return Q.query(spark, "SELECT symbol, seq, ema FROM ema(TABLE(SELECT symbol, ts, seq, price FROM quotes))")


@_query(
    f"WITH RECURSIVE {_with()}, e5 AS ({_EMA(5)}), e26 AS ({_EMA(26)}), {_rsi_sql(7, 'rsi7')}, {_bands_sql(10, 1.5, 'bands10')} SELECT symbol, seq, price, volume, event_type, e5.v AS fast, e26.v AS slow, rsi, bb_upper, bb_middle, bb_lower "
    "FROM r JOIN e5 USING (symbol, rn) JOIN e26 USING (symbol, rn) JOIN rsi7 USING (symbol, rn) JOIN bands10 USING (symbol, rn)"
)
def u1_periods_of_table_functions(spark, d):
    """Periods are the call's; all columns of the table stay, and calls nest."""
    _quotes_view(spark, d)
    _table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type").createOrReplaceTempView("kinds")
    return Q.query(
        spark,
        """WITH q AS (SELECT symbol, ts, seq, price AS last, volume, event_type FROM quotes JOIN kinds USING (seq)),
        a AS (SELECT * EXCEPT (ema), ema AS fast FROM ema(TABLE(q), period => 5, price => 'last')),
        b AS (SELECT * EXCEPT (ema), ema AS slow FROM ema(TABLE(a), period => 26, price => 'last')),
        c AS (SELECT * FROM rsi(TABLE(b), price => 'last', period => 7))
        SELECT symbol, seq, last AS price, volume, event_type, fast, slow, rsi, bb_upper, bb_middle, bb_lower FROM bollinger(TABLE(c), period => 10, k => 1.5, price => 'last')""",
    )


def _table_function(name: str, columns: str, sql: str):
    def run(spark, d):
        _quotes_view(spark, d)
        return Q.query(spark, f"SELECT symbol, seq, {columns} FROM {name}(TABLE(SELECT symbol, ts, seq, price FROM quotes))")

    run.__name__ = f"u1_{name}_table_function"
    _query(sql)(run)


_table_function("rsi", "rsi", SQL["w4_rsi"])
_table_function("macd", "macd, macd_signal, macd_histogram", SQL["w6_macd"])

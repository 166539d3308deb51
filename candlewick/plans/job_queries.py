"""Queries that SQL cannot express: stores, streams, models, folds. Their folders are in the shared checkpoint folder."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import calibration, checks, execution, features, monitor, regimes, resample, signals
from ..session import cut, shared_folder
from ..sources import bars as B
from ..sources.store import AppendTable, FeatureStore, VersionedStore
from ..streaming import jobs, live
from .desk_queries import k07_alerts
from .market import F_BASE, V, rounded
from .regime_queries import series
from .registry import DAILY, SQL, W, intraday, query, roll
from .search_queries import BASE, PICK, SIMS, SLOTS, a13_top_trials, base


def shared(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(DAILY + " SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, CAST(2 AS BIGINT) AS versions, true AS intact FROM bars WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1999-12-31' GROUP BY symbol")
def a04_a10_store(spark, sf_dir):
    """Write twice, list, read the latest within a range, check integrity."""
    store = VersionedStore(spark, shared(spark, "store"))
    b = B.daily_bars(spark, sf_dir)
    store.write(b.filter("ts < TIMESTAMP '1998-01-01'"))
    store.write(b, metadata={"source": "daily"})
    read = store.read(start="1996-01-01", end="1999-12-31").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    intact = store.integrity().groupBy("symbol").agg(F.count(F.lit(1)).alias("versions"), F.bool_and("intact").alias("intact"))
    return read.join(intact, "symbol")


@query(DAILY + F_BASE + f""", f2 AS (SELECT *, {roll('avg', 'up', 14)} AS ag, {roll('avg', 'down', 14)} AS al, {roll('avg', 'tr', 14)} AS atr FROM f1), f3 AS (SELECT *, CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100.0 END AS rsi FROM f2)
SELECT symbol, count(*) AS n, count(rsi) AS n_rsi, round(avg(atr), 6) AS mean_atr FROM f3 GROUP BY symbol""")
def a06_a07_f19_feature_store(spark, sf_dir):
    """Register, compute, store and get features with lineage."""
    fs = FeatureStore(VersionedStore(spark, shared(spark, "features")))
    fs.register(features.Pipeline("small", [features.returns(1), features.rsi(14), features.atr(14)]))
    fs.compute_and_store(B.daily_bars(spark, sf_dir), "small")
    return fs.get("small").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("rsi_14").alias("n_rsi"), F.round(F.avg("atr_14"), 6).alias("mean_atr"))


@query(DAILY + V.replace("GAP", "259200") + """, t AS (SELECT symbol, tf, count(*) AS total, count(*) FILTER (n = 0) AS passed, count(*) FILTER (n > 0 AND severity = 'critical') AS critical, count(*) FILTER (n > 0 AND severity = 'error') AS error,
  count(*) FILTER (n > 0 AND severity = 'warning') AS warning, count(*) FILTER (n > 0 AND severity = 'critical') > 0 AS has_critical FROM dq GROUP BY symbol, tf)
SELECT t.*, check_name, n = 0 AS ok, severity, n::BIGINT AS n, round(detail, 6) AS detail FROM t JOIN dq USING (symbol, tf)""")
def a14_json_report(spark, sf_dir):
    """The quality report, totals and checks, written as JSON and read back."""
    out = shared(spark, "report")
    checks.full_report(checks.suite(B.daily_bars(spark, sf_dir))).write.json(out)
    kept = "symbol string, tf string, total long, passed long, critical long, error long, warning long, has_critical boolean"
    back = spark.read.schema(kept + ", checks array<struct<check_name:string,passed:boolean,severity:string,n:bigint,detail:double>>").json(out)
    return rounded(back.withColumn("c", F.explode("checks")).select("symbol", "tf", "total", "passed", "critical", "error", "warning", "has_critical", "c.check_name", F.col("c.passed").alias("ok"), "c.severity", "c.n", "c.detail"))


@query(DAILY + ", e AS (SELECT symbol, max(ts) AS m FROM bars GROUP BY symbol) SELECT symbol, count(*) AS n, round(sum(volume), 3) AS volume, round(avg(close), 6) AS mean_close, min(ts) AS first_ts FROM bars JOIN e USING (symbol) WHERE ts >= m - INTERVAL 3650 DAYS GROUP BY symbol")
def a01_a02_landed(spark, sf_dir):
    """A1 A2: bars put down as CSV under foreign names, read by schema, standardised, within ten years."""
    root = shared(spark, "landed")
    b = B.daily_bars(spark, sf_dir)
    b.select(*(F.col(ours).alias(theirs) for theirs, ours in B.LANDED.items())).write.option("header", True).csv(root)
    return rounded(B.landed(spark, root, "daily").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.avg("close").alias("mean_close"), F.min("ts").alias("first_ts")), 6, volume=3)


@query("SELECT user_id AS correlation_id, event_type AS event, count(*) AS n, min(date_trunc('millisecond', ts)) AS first_ts, max(date_trunc('millisecond', ts)) AS last_ts, round(sum(value), 4) AS amount FROM events GROUP BY ALL")
def a17_json_log(spark, sf_dir):
    """Events as JSON log lines, read by schema and gathered by correlation id."""
    root = shared(spark, "log")
    e = B.table(spark, sf_dir, "events")
    e.select(F.col("ts").cast("timestamp").alias("timestamp"), F.lit("INFO").alias("level"), F.col("event_type").alias("event"), F.col("user_id").alias("correlation_id"), F.struct(F.col("event_id").alias("order_id"), F.col("value").alias("amount")).alias("details")).write.json(root)
    return rounded(monitor.log_summary(monitor.read_log(spark, root)), 4)


@query(SQL["k07_alerts"])
def a16_json_alerts(spark, sf_dir):
    """The alerts written as JSON and read back."""
    return monitor.json_round_trip(k07_alerts(spark, sf_dir), shared(spark, "alerts"))


@query("""WITH RECURSIVE f AS (SELECT 'P' || (l_suppkey % 5) AS portfolio, p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END::DOUBLE AS qty, l_extendedprice / l_quantity AS price, l_shipdate AS ts FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, row_number() OVER (PARTITION BY portfolio, symbol ORDER BY ts, qty, price) AS k FROM f),
r(portfolio, symbol, k, q, av, re) AS (
  SELECT portfolio, symbol, k, qty, price::DOUBLE, 0.0::DOUBLE FROM n WHERE k = 1
  UNION ALL SELECT n.portfolio, n.symbol, n.k, q + qty,
    CASE WHEN q * qty >= 0 THEN CASE WHEN q + qty <> 0 THEN (av * q + price * qty) / (q + qty) ELSE 0 END WHEN abs(qty) > abs(q) THEN price ELSE av END,
    CASE WHEN q * qty < 0 THEN re + least(abs(qty), abs(q)) * (price - av) * sign(q) ELSE re END
  FROM r JOIN n ON n.portfolio = r.portfolio AND n.symbol = r.symbol AND n.k = r.k + 1)
SELECT portfolio, symbol, q AS qty, round(CASE WHEN q <> 0 THEN av ELSE 0 END, 4) AS avg_price, round(re, 2) AS realized FROM r QUALIFY row_number() OVER (PARTITION BY portfolio, symbol ORDER BY k DESC) = 1""")
def s13_positions(spark, sf_dir):
    """Average cost with flips, from line items as signed fills."""
    t = B.table(spark, sf_dir, "lineitem").join(B.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return rounded(execution.average_cost(t.select(F.concat(F.lit("P"), F.col("l_suppkey") % 5).alias("portfolio"), F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), (sign * F.col("l_quantity")).cast("double").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))), 4, realized=2)


def predictor_rows(spark, sf_dir):
    """The predictor's rows, worked out once: fits and forecasts read them many times."""
    return cut(calibration.training_frame(regimes.detect(series(spark, sf_dir))))


def _fitted(spark, sf_dir, kind="forest"):
    """The predictor's rows, and a model of them: None where no symbol has enough rows."""
    frame = predictor_rows(spark, sf_dir)
    return frame, None if frame.isEmpty() else calibration.fit_regime_model(frame, kind)


@query()
def r14_r16_forest(spark, sf_dir):
    """A forest of 100 trees of depth 10 fitted on the first 80 per cent; its confusion, recall, precision and accuracy on the rest."""
    frame, model = _fitted(spark, sf_dir)
    if model is None:
        return spark.createDataFrame([], "label string, predicted string, n long, recall double, precision double, accuracy double")
    return calibration.confusion(calibration.forecast(model, frame.filter("NOT train")))


@query()
def r15_importances(spark, sf_dir):
    """The features that the forest leans on most."""
    _, model = _fitted(spark, sf_dir)
    if model is None:
        return spark.createDataFrame([], "rank int, feature string, importance double")
    return calibration.importances(model, spark)


@query()
def r14_boosted(spark, sf_dir):
    """Boosted trees, 100 rounds of depth 6 at rate 0.1, one ensemble against the rest for each label; on the last 20 per
    cent by symbol the accuracy, the mean confidence, and the mean logarithm of the probability of what came.
    """
    frame, model = _fitted(spark, sf_dir, "boosted")
    if model is None:
        return spark.createDataFrame([], "symbol string, n long, accuracy double, confidence double, log_likelihood double")
    f = calibration.forecast(model, frame.filter("NOT train"))
    of = F.lit(None).cast("double")
    for k in model.stages[0].labels:
        of = F.when(F.col("label") == k, F.col(f"p_{k}")).otherwise(of)
    return f.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"), F.avg(F.ln(F.greatest(of, F.lit(1e-12)))).alias("log_likelihood"))


@query()
def r18_isotonic(spark, sf_dir):
    """Isotonic calibration of the regime probabilities against the label five bars ahead, fitted on the first 80 per cent; mean squared error on the rest before and after."""
    frame = predictor_rows(spark, sf_dir)
    if frame.isEmpty():
        return spark.createDataFrame([], "symbol string, n long, brier_before double, brier_after double")
    out = calibration.isotonic(frame, list(regimes.REGIMES), "train").filter("NOT train")
    error = lambda c: sum((F.avg((F.col(f"{c}_{k}") - (F.col("label") == k).cast("double")) ** 2) for k in regimes.REGIMES), F.lit(0.0))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), error("p").alias("brier_before"), error("c").alias("brier_after"))


@query()
def r19_platt(spark, sf_dir):
    """Logistic scaling of a length score against the quality labels, fitted on documents of even ids; error on odd ones."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(0.99), 0.01 + F.log1p(F.char_length("text")) / 12).alias("p"))
    x = d.join(B.table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select("doc_id", F.col("quality").alias("y")), "doc_id").filter("p IS NOT NULL")
    out = calibration.platt(x, fit_on="doc_id % 2 = 0").filter("doc_id % 2 = 1")
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier_before"), F.avg((F.col("calibrated") - F.col("y")) ** 2).alias("brier_after"))


def _ticks(spark, sf_dir):
    return jobs.tick_stream(spark, f"{sf_dir}/events.parquet*")


def _run(spark, stream, name):
    return jobs.run_once(stream, shared(spark, name), shared(spark, f"{name}-state"))


#: Ticks, and the latest time, which the watermark is behind.
TICKS = "WITH e AS (SELECT event_id, ts, event_type AS symbol, value AS price, max(date_trunc('millisecond', ts)) OVER () AS top FROM events)"


@query(TICKS + " SELECT symbol, date_trunc('hour', ts) AS ts, first(price ORDER BY e.ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY e.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM e GROUP BY 1, 2 HAVING date_trunc('hour', e.ts) + INTERVAL 1 HOUR <= any_value(top) - INTERVAL 10 MINUTES")
def t1_stream_bars(spark, sf_dir):
    return _run(spark, jobs.stream_bars(_ticks(spark, sf_dir)), "bars")


@query(TICKS + """, w AS (SELECT symbol, price, top, date_trunc('day', ts) + INTERVAL 1 DAY * k AS z FROM e, (VALUES (1), (2)) AS v(k)),
g AS (SELECT symbol, z AS ts, avg(price) AS mean, stddev_samp(price) AS deviation, count(*)::DOUBLE AS count FROM w GROUP BY 1, 2 HAVING z <= any_value(top) - INTERVAL 1 HOUR)
SELECT ts, symbol, unnest(['mean', 'deviation', 'count']) AS name, round(unnest([mean, deviation, count]), 6) AS value FROM g""")
def t2_stream_metrics(spark, sf_dir):
    return rounded(_run(spark, jobs.stream_metrics(_ticks(spark, sf_dir)), "metrics"), 6)


@query(TICKS + """, r AS (SELECT symbol, min(price) AS lo, max(price) AS hi FROM e WHERE ts < TIMESTAMP '2024-01-11' GROUP BY symbol),
h AS (SELECT symbol, ts, price, lo, hi, least(floor((price - lo) / (hi - lo) * 50), 49)::INT AS bin, top FROM e JOIN r USING (symbol) WHERE price >= lo AND price <= hi AND hi > lo),
a AS (SELECT symbol, bin, count(*) AS a FROM h WHERE ts < TIMESTAMP '2024-01-11' GROUP BY ALL),
b AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 1 DAY * k AS z, bin, count(*) AS b FROM h, range(1, 8) AS t(k) WHERE date_trunc('day', ts) + INTERVAL 1 DAY * k <= top - INTERVAL 1 HOUR GROUP BY ALL),
w AS (SELECT DISTINCT symbol, z FROM b), f AS (SELECT coalesce(b.symbol, x.symbol) AS symbol, coalesce(b.z, x.z) AS z, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT w.*, bin, a FROM w JOIN a USING (symbol)) x FULL JOIN b ON b.symbol = x.symbol AND b.z = x.z AND b.bin = x.bin),
g AS (SELECT symbol, z, b / sum(b) OVER o + 1e-10 AS p, a / sum(a) OVER o + 1e-10 AS q FROM f WINDOW o AS (PARTITION BY symbol, z))
SELECT z AS ts, symbol, 'kl' AS name, round(sum(p * ln(p / q)), 6) AS value, sum(p * ln(p / q)) > 0.1 AS drift FROM g GROUP BY symbol, z""")
def t2_stream_drift(spark, sf_dir):
    """Weekly windows, a day apart, against the histogram of the first ten days; the sink is keyed by the number of the batch."""
    root = shared(spark, "drift")
    past = B.ticks_of(spark, sf_dir).filter("ts < TIMESTAMP '2024-01-11'").select(F.col("symbol").alias("key"), F.col("price").alias("value"))
    ranges = past.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    sink = jobs.drift_sink(monitor.histogram(past, ranges, ["key"]), root)
    jobs.run_batches(jobs.stream_drift(_ticks(spark, sf_dir), ranges, "7 days"), sink, f"{root}/state")
    return rounded(spark.read.schema("ts timestamp, symbol string, name string, value double, drift boolean, batch long").parquet(f"{root}/metrics").drop("batch"))


@query(SQL["a13_top_trials"])
def a13_appended_trials(spark, sf_dir):
    """The best trials added to a table in two appends; a third that is not committed is not there."""
    rows = a13_top_trials(spark, sf_dir)
    table = AppendTable(spark, shared(spark, "trials"), rows.schema)
    part = F.pmod(F.xxhash64("symbol"), F.lit(2))
    table.append(rows.filter(part == 0))
    table.append(rows.filter(part == 1))
    table.stage(rows)
    return table.read()


@query(DAILY + f" SELECT symbol, ts, round({roll('median', 'close', 15)}, 9) AS median_15 FROM bars")
def u01_user_feature(spark, sf_dir):
    """User-defined feature: a median of 15 closes by pandas, in groups of 500 bars with the 14 before them."""
    x = features.grouped_feature(B.daily_bars(spark, sf_dir), "median_15", lambda g: g["close"].rolling(15).median(), reach=14, rows=500)
    return rounded(x.select("symbol", "ts", F.nanvl("median_15", F.lit(None)).alias("median_15")), 9)


@query(BASE + SLOTS + ", " + PICK["iid"] + ", sx AS (SELECT pk.symbol, pk.sim, x FROM pk JOIN base ON pk.symbol = base.symbol AND pk.idx = base.idx), md AS (SELECT symbol, sim, median(x) AS m FROM sx GROUP BY ALL) SELECT symbol, count(*) AS n, round(quantile_cont(m, 0.025), 6) AS low, round(median(m), 6) AS middle, round(quantile_cont(m, 0.975), 6) AS high FROM md GROUP BY symbol")
def u02_user_statistic(spark, sf_dir):
    """User-defined statistic: the median of 1,000 bootstrap samples of trade results."""
    s = resample.user_statistic(base(spark, sf_dir), np.median, SIMS)
    return rounded(s.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *(F.percentile("value", q).alias(k) for k, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975)))))


TIMEFRAMES = ("5min", "hourly", "daily")
#: Rows of (param_id, tf, mn1, mn2, entry, exit, on, off, start).
LIVE = [(p, tf, mn1, mn2, entry, exit_, on, off, 3) for p, mn1, mn2, on, off, levels in ((0, 14, 3, 20, 5, (50.0, 60.0)), (1, 7, 5, 30, 2, (55.0, 70.0))) for tf in TIMEFRAMES for entry, exit_ in (levels,)]
_V = ", ".join(str(r) for r in LIVE)
_K = "(PARTITION BY symbol, tf ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_S = "OVER (PARTITION BY symbol, param_id ORDER BY ts ROWS UNBOUNDED PRECEDING)"
LIVE_SQL = f"""WITH pa(param_id, tf, mn1, mn2, entry, exit, "on", off, start) AS (VALUES {_V}),
sec AS (SELECT * FROM (VALUES ('5min', 300), ('hourly', 3600), ('daily', 86400)) AS s(tf, s)),
b AS (SELECT event_type AS symbol, tf, s, to_timestamp((epoch_us(ts) // (s::BIGINT * 1000000)) * s)::TIMESTAMP AS ts, last(value ORDER BY e.ts, event_id) AS close FROM events e, sec GROUP BY ALL),
d AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol, tf ORDER BY ts), 0) AS m, row_number() OVER (PARTITION BY symbol, tf ORDER BY ts) - 1 AS i, max(ts) OVER () AS top FROM b),
r AS (SELECT *, {', '.join(f"CASE WHEN sum(greatest(-m, 0)) OVER w{n} > 1e-12 THEN 100 - 100 / (1 + sum(greatest(m, 0)) OVER w{n} / sum(greatest(-m, 0)) OVER w{n}) ELSE 0 END AS r{n}" for n in (7, 14))} FROM d WINDOW w7 AS {_K.format(6)}, w14 AS {_K.format(13)}),
q AS (SELECT *, avg(r14) OVER {_K.format(2)} AS r14_3, avg(r7) OVER {_K.format(4)} AS r7_5 FROM r),
y AS (SELECT symbol, param_id, tf, ts + s * INTERVAL 1 SECOND AS ts, CASE WHEN i > 0 THEN CASE mn1 WHEN 14 THEN r14_3 ELSE r7_5 END END AS rsi, entry, exit, ((i - start) % ("on" + off) + "on" + off) % ("on" + off) < "on" AS cy FROM q JOIN pa USING (tf) WHERE ts + s * INTERVAL 1 SECOND < top),
z AS (SELECT symbol, param_id, ts, {', '.join(f"max(rsi) FILTER (tf = '{t}') AS r_{t}, bool_and(rsi < entry AND cy) FILTER (tf = '{t}' AND rsi IS NOT NULL) AS e_{t}, bool_and(rsi > exit OR NOT cy) FILTER (tf = '{t}' AND rsi IS NOT NULL) AS x_{t}" for t in TIMEFRAMES)} FROM y GROUP BY ALL),
v AS (SELECT symbol, param_id, ts, {', '.join(f"last_value({c}_{t} IGNORE NULLS) {_S} AS {c}_{t}" for t in TIMEFRAMES for c in 'rex')} FROM z),
g AS (SELECT symbol, param_id, ts, {', '.join(f'round(r_{t}, 5) AS rsi_{t}' for t in TIMEFRAMES)}, {' AND '.join(f'e_{t}' for t in TIMEFRAMES)} AS enter, {' OR '.join(f'x_{t}' for t in TIMEFRAMES)} AS leave FROM v WHERE {' AND '.join(f'r_{t} IS NOT NULL' for t in TIMEFRAMES)}),
h AS (SELECT *, CASE WHEN enter AND NOT leave THEN 1 WHEN leave AND NOT enter THEN 0 END AS base, sum((enter AND leave)::INT) {_S} AS tog FROM g),
k AS (SELECT *, coalesce(last_value(base - tog IGNORE NULLS) {_S}, 0) AS since FROM h)
SELECT symbol, param_id, ts, {', '.join(f'rsi_{t}' for t in TIMEFRAMES)}, enter, leave, (((since + tog) % 2 + 2) % 2)::INT AS pos FROM k"""


def live_params(spark):
    return spark.createDataFrame(LIVE, "param_id long, tf string, mn1 int, mn2 int, entry double, exit double, on int, off int, start int")


def all_bars(spark, sf_dir):
    """Closes of all three timeframes."""
    out = None
    for tf in TIMEFRAMES:
        b = B.intraday_bars(spark, sf_dir, tf).select("symbol", F.lit(tf).alias("tf"), F.col("ts").cast("timestamp").alias("ts"), "close")
        out = b if out is None else out.unionByName(b)
    return out


@query(LIVE_SQL)
def t3_s15_live_signals(spark, sf_dir):
    """Entries and exits over three timeframes as bars close; the bars come in two parts, each to a run of its own from the same state."""
    root = shared(spark, "live")
    bars = all_bars(spark, sf_dir)
    middle = bars.agg(F.timestamp_seconds((F.unix_timestamp(F.min("ts")) + F.unix_timestamp(F.max("ts"))) / 2)).first()[0]
    for part in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)):
        bars.filter(part).write.mode("append").parquet(f"{root}/bars")
        stream = spark.readStream.schema(bars.schema).parquet(f"{root}/bars")
        out = jobs.run_once(live.multi_timeframe_signals(stream, live_params(spark), TIMEFRAMES), f"{root}/signals", f"{root}/state", jobs.ROCKS)
    return rounded(out, 5)


@query(LIVE_SQL)
def s15_live_batch(spark, sf_dir):
    """The same decisions from the whole history, without a stream."""
    bars = all_bars(spark, sf_dir)
    top = bars.agg(F.max("ts").alias("top"))
    pairs = sorted({(r[2], r[3]) for r in LIVE})
    out = signals.live_positions(bars, live_params(spark), pairs, TIMEFRAMES).join(F.broadcast(top), F.col("ts") < F.col("top")).drop("top")
    return rounded(out, 5)


@query(intraday("hourly", 3600) + f""", m AS (SELECT *, coalesce(close - lag(close) {W}, 0) AS d FROM bars),
g AS (SELECT *, sum(greatest(d, 0)) OVER w AS g, -sum(least(d, 0)) OVER w AS l FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CASE WHEN l > 1e-12 THEN 100 - 100 / (1 + g / l) ELSE 0 END AS rsi FROM g), e AS (SELECT *, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN 0 END AS ev FROM r)
SELECT symbol, ts, round(rsi, 5) AS rsi, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS pos FROM e""")
def t3_s15_stream_signals(spark, sf_dir):
    """Signals on closed bars only."""
    root = shared(spark, "signals")
    B.intraday_bars(spark, sf_dir, "hourly").select("symbol", "ts", "close").write.parquet(f"{root}/bars")
    bars = spark.readStream.schema("symbol string, ts timestamp, close double").parquet(f"{root}/bars")
    return rounded(_run(spark, jobs.stream_signals(bars), "signals"), 5)


@query("SELECT ts, event_type AS symbol, 'price' AS name, value, 480.0::DOUBLE AS threshold, '>' AS comparison, 'critical' AS severity, 'price > 480.0' AS message FROM events WHERE value > 480")
def t4_stream_alerts(spark, sf_dir):
    rules = spark.createDataFrame([("price", 480.0, ">", "critical")], "name string, threshold double, comparison string, severity string")
    m = _ticks(spark, sf_dir).select("ts", "symbol", F.lit("price").alias("name"), F.col("price").alias("value"))
    return _run(spark, jobs.stream_alerts(m, rules), "alerts")


@query("""WITH e AS (SELECT 'P' || (user_id % 5) AS portfolio, event_id, ts, 100000 + sum(value - 250) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS equity FROM events),
p AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY portfolio ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS peak FROM e), d AS (SELECT *, equity / peak - 1 AS drawdown FROM p)
SELECT portfolio, event_id, ts, round(equity, 4) AS equity, round(peak, 4) AS peak, round(drawdown, 7) AS drawdown, max((drawdown < -0.1)::INT) OVER (PARTITION BY portfolio ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS killed FROM d""")
def t5_stream_risk(spark, sf_dir):
    e = _ticks(spark, sf_dir).select("event_id", F.concat(F.lit("P"), F.col("user_id") % 5).alias("portfolio"), "ts", (F.col("price") - 250).alias("change"))
    return rounded(_run(spark, jobs.stream_risk(e), "risk"), 4, drawdown=7)


#: Fills of the exposure query, and its limits.
FILLS = "CASE WHEN event_id % 3 = 0 THEN -2.0 ELSE 1.0 END * (1 + user_id % 3)"
DESK = {"gross": 60_000.0, "net": 30_000.0, "single": 25_000.0, "leverage": 0.9, "drawdown": -0.10}
RUN = "OVER (PARTITION BY portfolio ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH f AS (SELECT event_id, 'P' || (user_id % 5) AS portfolio, event_type AS symbol, date_trunc('millisecond', ts) AS t, ({FILLS})::DOUBLE AS qty, value AS price, max(date_trunc('millisecond', ts)) OVER () AS top FROM events),
b AS (SELECT event_type AS symbol, date_trunc('hour', e.ts) + INTERVAL 1 HOUR AS bar, last(value ORDER BY e.ts, event_id) AS close FROM events e GROUP BY 1, 2),
m AS (SELECT f.*, b.bar, b.close FROM f ASOF LEFT JOIN b ON f.symbol = b.symbol AND f.t >= b.bar),
k AS (SELECT * EXCLUDE (bar, close), CASE WHEN bar > t - INTERVAL 6 HOUR THEN close ELSE price END AS mark, sum(qty) OVER (PARTITION BY portfolio, symbol ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS held FROM m WHERE t < top - INTERVAL 370 MINUTES),
g AS (SELECT k.portfolio, k.event_id, k.t, k.qty * k.price AS paid, s.symbol AS sym, CASE WHEN s.symbol = k.symbol THEN held * mark END AS worth FROM k JOIN (SELECT DISTINCT portfolio, symbol FROM k) s USING (portfolio)),
h AS (SELECT *, coalesce(last_value(worth IGNORE NULLS) OVER (PARTITION BY portfolio, sym ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) AS w FROM g),
x AS (SELECT portfolio, event_id, t, any_value(paid) AS paid, sum(abs(w)) AS gross, sum(w) AS net, max(abs(w)) AS single FROM h GROUP BY ALL),
v AS (SELECT *, 100000 - sum(paid) {RUN} + net AS value FROM x), p AS (SELECT *, greatest(100000, max(value) {RUN}) AS peak, CASE WHEN value > 0 THEN gross / value ELSE 0 END AS leverage FROM v),
d AS (SELECT *, (value - peak) / peak AS drawdown FROM p),
l AS (SELECT *, CASE WHEN gross > 60000 OR leverage > 0.9 OR drawdown < -0.1 THEN 'red' WHEN abs(net) > 30000 OR single > 25000 THEN 'orange' WHEN gross > 54000 THEN 'yellow' ELSE 'green' END AS level FROM d)
SELECT portfolio, event_id, t AS ts, round(gross, 4) AS gross, round(net, 4) AS net, round(leverage, 6) AS leverage, round(value, 4) AS value, round(drawdown, 7) AS drawdown, level, max((level = 'red')::INT) {RUN} = 1 AS killed FROM l""")
def t5_stream_exposure(spark, sf_dir):
    """T5: running exposure of portfolios, marked at the last hourly close within six hours; fills and closes are two streams."""
    root = shared(spark, "exposure")
    B.intraday_bars(spark, sf_dir, "hourly").select("symbol", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("close").alias("price")).write.parquet(f"{root}/closes")
    closes = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(f"{root}/closes")
    fills = _ticks(spark, sf_dir).select("event_id", F.concat(F.lit("P"), F.col("user_id") % 5).alias("portfolio"), "symbol", F.date_trunc("millisecond", "ts").alias("ts"), F.expr(FILLS).alias("qty"), "price")
    out = jobs.run_once(live.stream_exposure(fills, closes, limits=DESK), f"{root}/out", f"{root}/state", jobs.ROCKS)
    return rounded(out, 4, leverage=6, drawdown=7)


@query(TICKS + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, event_id) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS st FROM e), s AS (SELECT *, sum(st) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT symbol, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTES AS end_ts, count(*) AS n FROM s GROUP BY symbol, k HAVING max(ts) + INTERVAL 30 MINUTES <= any_value(top) - INTERVAL 1 HOUR""")
def t6_stream_sessions(spark, sf_dir):
    return _run(spark, jobs.stream_sessions(_ticks(spark, sf_dir)), "sessions")



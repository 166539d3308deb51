"""Queries on market regimes. The series is the 30-bar mean of each brand's daily closes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import frame, over
from ..operators import regimes as R
from ..sources import bars as B
from .market import CLASS, asset_class, rounded
from .registry import DAILY, W, query, roll

NAMES = list(R.REGIMES)
P = ["p_" + k for k in NAMES]


def series(spark, sf_dir):
    b = B.daily_bars(spark, sf_dir)
    return b.select("symbol", "ts", F.avg("close").over(frame(30, "symbol")).alias("close"))


def _case(*rules: tuple[str, int]) -> str:
    return " + ".join(f"CASE WHEN {r} THEN {p} ELSE 0 END" for r, p in rules)


def _sum(n: int, x: str = "lr") -> str:
    return f"CASE WHEN count({x}) OVER f{n} = {n} THEN least(greatest(exp(sum({x}) OVER f{n} * {252 / n!r}) - 1, -1), 10) ELSE 0.0 END"


_ENT = " + ".join(f"CASE WHEN {p} > 0 THEN {p} * ln({p}) ELSE 0 END" for p in P)
_TOP = f"greatest({', '.join(P)})"

REG = (
    DAILY
    + f""",
s0 AS (SELECT symbol, ts, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS close FROM bars),
s1 AS (SELECT *, close / lag(close) {W} - 1 AS ret, row_number() {W} AS i, close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM s0),
up AS (SELECT symbol, ts, sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS g FROM s1 WHERE ret > 0),
dn AS (SELECT symbol, ts, sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS l FROM s1 WHERE ret < 0),
s2 AS (SELECT s1.*, coalesce(g, 0) AS g, coalesce(l, 0) AS l, CASE WHEN ret IS NOT NULL THEN ln(1 + least(greatest(ret, -0.5), 2.0)) END AS lr FROM s1
  ASOF LEFT JOIN up ON s1.symbol = up.symbol AND s1.ts >= up.ts ASOF LEFT JOIN dn ON s1.symbol = dn.symbol AND s1.ts >= dn.ts),
s3 AS (SELECT *, CASE WHEN count(ret) OVER f20 >= 5 THEN stddev_samp(ret) OVER f20 * sqrt(252) ELSE 0.0 END AS realized_vol, CASE WHEN count(ret) OVER f20 = 20 THEN stddev_samp(ret) OVER f20 END AS sd,
  {roll('avg', 'close', 50)} AS fast, {roll('avg', 'close', 200)} AS slow, {_sum(20)} AS ret_20, {_sum(60)} AS ret_60,
  100 - 100 / (1 + g / (abs(l) + 1e-10)) AS rsi, CASE WHEN i >= 20 THEN least(greatest(close / lag(close, 19) {W} - 1, -1), 10) ELSE 0.0 END AS roc_20,
  count(ret) OVER f20 AS nr, avg(ret) OVER f20 AS m1, avg(ret * ret) OVER f20 AS m2, avg(ret * ret * ret) OVER f20 AS m3, CASE WHEN i >= 60 THEN min(drawdown) OVER f60 ELSE 0.0 END AS max_drawdown_60
  FROM s2 WINDOW f20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f60 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
s4 AS (SELECT *, CASE WHEN nr >= 10 AND m2 - m1 * m1 > 0 THEN (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 1.5) ELSE 0.0 END AS skew,
  CASE WHEN lag(sd, 20) {W} > 1e-6 THEN sd / lag(sd, 20) {W} - 1 ELSE 0.0 END AS vol_trend, coalesce(close / fast - 1, 0) AS vs_fast, coalesce(close / slow - 1, 0) AS vs_slow, coalesce(fast / slow - 1, 0) AS ma_trend FROM s3),
s5 AS (SELECT *, {_case(('realized_vol < 0.1', 2), ('ret_20 > 0.15', 3), ('ret_60 > 0.15', 2), ('ma_trend > 0.05', 2), ('rsi > 60', 1))} AS q1,
  {_case(('realized_vol > 0.1', 1), ('ret_20 < -0.1', 3), ('ret_60 < -0.1', 2), ('ma_trend < -0.05', 2), ('rsi < 40', 1), ('drawdown < -0.1', 2))} AS q2,
  {_case(('realized_vol > 0.25', 3), ('abs(ma_trend) < 0.03', 2), ('abs(ret_20) < 0.1', 1), ('vol_trend > 0.5', 2))} AS q3,
  {_case(('realized_vol < 0.1', 3), ('abs(ma_trend) < 0.02', 2), ('abs(ret_20) < 0.05', 2), ('rsi BETWEEN 40 AND 60', 1))} AS q4,
  {_case(('realized_vol > 0.5', 4), ('drawdown < -0.2', 3), ('skew < -1.0', 2), ('ret_20 < -0.3', 3))} AS q5 FROM s4),
s6 AS (SELECT *, {', '.join(f'CASE WHEN q1 + q2 + q3 + q4 + q5 > 0 THEN q{k} / (q1 + q2 + q3 + q4 + q5) ELSE 0.2 END AS {p}' for k, p in enumerate(P, 1))} FROM s5),
s7 AS (SELECT *, CASE {' '.join(f"WHEN {p} = {_TOP} THEN '{n}'" for p, n in zip(P, NAMES, strict=True))} END AS regime, 1 + ({_ENT}) / ln(5) AS confidence FROM s6),
s8 AS (SELECT *, coalesce(regime <> lag(regime) {W}, true) AS is_new FROM s7),
s9 AS (SELECT *, CAST(sum(is_new::INT) OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS run FROM s8),
mv AS (SELECT *, least(row_number() OVER (PARTITION BY symbol, run ORDER BY ts), 252) AS duration, lag(regime) {W} AS fr FROM s9),
tm AS (SELECT *, {', '.join(f"coalesce(count(*) FILTER (fr = '{a}' AND regime = '{b}') OVER m, 0) AS m{j}{k}" for j, a in enumerate(NAMES) for k, b in enumerate(NAMES))} FROM mv
  WINDOW m AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 250 PRECEDING AND CURRENT ROW)),
nx AS (SELECT *, CASE WHEN i < 50 THEN regime {' '.join(f"WHEN regime = '{a}' THEN CASE " + ' '.join(f"WHEN m{j}{k} = greatest({', '.join(f'm{j}{x}' for x in range(5))}) THEN '{b}'" for k, b in enumerate(NAMES)) + ' END' for j, a in enumerate(NAMES))} END AS next_regime,
  CASE WHEN i < 50 THEN 0.7 {' '.join(f"WHEN regime = '{a}' THEN coalesce(m{j}{j} / nullif({' + '.join(f'm{j}{x}' for x in range(5))}, 0), 0)" for j, a in enumerate(NAMES))} END AS stay FROM tm),
rg AS (SELECT *, least(greatest((b * confidence + (1 - confidence)) * stay + (1 - stay), 0.1), 2) AS size FROM (SELECT *, CASE regime WHEN 'bull' THEN 1.2 WHEN 'bear' THEN 0.5 WHEN 'high_volatility' THEN 0.6 WHEN 'low_volatility' THEN 1.0 ELSE 0.2 END AS b FROM nx))"""
)


@query(REG + """ SELECT symbol, ts, round(realized_vol, 6) AS realized_vol, round(vol_trend, 6) AS vol_trend, round(vs_fast, 6) + 0 AS vs_fast, round(vs_slow, 6) + 0 AS vs_slow, round(ma_trend, 6) AS ma_trend, round(ret_20, 5) AS ret_20,
  round(rsi, 5) AS rsi, round(roc_20, 6) AS roc_20, round(drawdown, 6) AS drawdown, round(max_drawdown_60, 6) AS max_drawdown_60 FROM rg""")
def r01_features(spark, sf_dir):
    x = R.features(series(spark, sf_dir))
    return rounded(x.select("symbol", "ts", "realized_vol", "vol_trend", "vs_fast", "vs_slow", "ma_trend", "roc_20", "drawdown", "max_drawdown_60", "ret_20", "rsi"), ret_20=5, rsi=5)


@query(REG + f" SELECT symbol, ts, {', '.join(f'round({p}, 6) AS {p}' for p in P)}, regime, round(confidence, 6) AS confidence, CAST(duration AS BIGINT) AS duration, next_regime, round(stay, 6) AS stay, round(size, 6) AS size FROM rg")
def r02_r11_history(spark, sf_dir):
    """Probabilities, label, confidence, duration, Markov step and size at every bar."""
    return rounded(R.detect(series(spark, sf_dir)).select("symbol", "ts", *P, "regime", "confidence", "duration", "next_regime", "stay", "size"))


@query(REG + " SELECT symbol, ts, round(least(0.95, 0.5 + duration / 100.0), 6) AS pine_stay, round(pow(confidence, 0.3) * pow(least(0.95, 0.5 + duration / 100.0), 0.3) * pow(CASE WHEN ma_trend > 0.05 THEN 0.8 WHEN ma_trend < -0.05 THEN 0.3 ELSE 0.6 END, 0.2) * pow(CASE WHEN realized_vol < 0.10 THEN 0.9 WHEN realized_vol > 0.50 THEN 0.2 ELSE 0.6 END, 0.2), 6) AS score FROM rg")
def r07_r09_display(spark, sf_dir):
    x = R.detect(series(spark, sf_dir)).withColumn("pine_stay", R.stay_by_duration(F.col("duration")))
    return rounded(x.select("symbol", "ts", "pine_stay", R.display_score(F.col("confidence"), F.col("pine_stay"), F.col("ma_trend"), F.col("realized_vol")).alias("score")))


@query(REG + """, v AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol, regime ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS v FROM rg WHERE ret IS NOT NULL AND ret > -1 AND i > 200),
d AS (SELECT *, v / max(v) OVER (PARTITION BY symbol, regime ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM v),
a AS (SELECT symbol, regime, count(*) AS n, avg(ret) * 252 AS ann_return, stddev_samp(ret) * sqrt(252) AS ann_vol, min(dd) AS max_drawdown, avg((ret > 0)::INT::DOUBLE) AS win_rate FROM d GROUP BY ALL),
u AS (SELECT symbol, run, regime, count(*) AS len, run = max(run) OVER (PARTITION BY symbol) AS is_last FROM rg WHERE i > 200 GROUP BY symbol, run, regime),
l AS (SELECT symbol, regime, floor(avg(len))::BIGINT AS avg_duration FROM u WHERE NOT is_last GROUP BY ALL),
ev AS (SELECT symbol, unnest([""" + ", ".join(f"'{n}'" for n in NAMES) + """]) AS regime FROM (SELECT DISTINCT symbol FROM rg))
SELECT ev.symbol, ev.regime, coalesce(n, 0) AS n, round(coalesce(ann_return, 0), 5) AS ann_return, round(CASE WHEN n IS NULL THEN 0 ELSE ann_vol END, 5) AS ann_vol, round(coalesce(max_drawdown, 0), 5) AS max_drawdown, round(coalesce(win_rate, 0), 5) AS win_rate,
  coalesce(avg_duration, 0) AS avg_duration, round(CASE WHEN ann_vol > 0 THEN ann_return / ann_vol ELSE 0 END, 5) AS sharpe
FROM ev LEFT JOIN a ON ev.symbol IS NOT DISTINCT FROM a.symbol AND ev.regime = a.regime LEFT JOIN l ON ev.symbol IS NOT DISTINCT FROM l.symbol AND ev.regime = l.regime""")
def r10_statistics(spark, sf_dir):
    return rounded(R.statistics(R.durations(R.labels(R.scores(R.features(series(spark, sf_dir)))))), 5)


_W14, _W20 = (f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (14, 20))
#: SQL of the predictor's rows: from bar 201 on, with a label, of symbols with 100 of them; the first 80 per cent train.
TRAINING = f"""(SELECT *, row_number() {W} <= floor(0.8 * count(*) OVER (PARTITION BY symbol)) AS train FROM (
  SELECT * REPLACE (avg(ret) {_W20} * 252 AS ret_20, 1 - 1 / (1 + coalesce(sum(ret) FILTER (ret > 0) {_W14}, 0) / (abs(coalesce(sum(ret) FILTER (ret < 0) {_W14}, 0)) + 1e-10)) AS rsi), lead(regime, 5) {W} AS label, duration / 100.0 AS duration_scaled FROM rg)
  WHERE i > 200 AND label IS NOT NULL QUALIFY count(*) OVER (PARTITION BY symbol) >= 100)"""
FRAME = [*P, "confidence", "duration_scaled", "stay", "realized_vol", "ret_20", "skew", "vs_fast", "vs_slow", "rsi", "drawdown"]


@query(REG + f""", f AS {TRAINING}
SELECT symbol, ts, label, train, regime = 'bull' AS is_bull, regime = 'crisis' AS is_crisis, {', '.join(f"round(coalesce({c}, 0), {3 if c in ('skew', 'ret_20') else 5}) + 0 AS {c}" for c in FRAME)} FROM f""")
def r12_features(spark, sf_dir):
    """The predictor's features, label and split, row by row."""
    from ..operators import calibration

    x = calibration.training_frame(R.detect(series(spark, sf_dir)))
    return rounded(x.select("symbol", "ts", "label", "train", (F.col("is_bull") > 0).alias("is_bull"), (F.col("is_crisis") > 0).alias("is_crisis"), *FRAME), 5, skew=3, ret_20=3)


@query(REG + f""", f AS {TRAINING} SELECT symbol, train, regime, label, count(*) AS n FROM f GROUP BY ALL""")
def r12_r13_training_set(spark, sf_dir):
    """Label five bars ahead, chronological split."""
    from ..operators import calibration

    x = calibration.training_frame(R.detect(series(spark, sf_dir)))
    return x.groupBy("symbol", "train", "regime", "label").agg(F.count(F.lit(1)).alias("n"))


@query(REG + f""", f AS (SELECT regime AS pred, unnest([1, 5, 20]) AS horizon, unnest([lead(regime, 1) {W}, lead(regime, 5) {W}, lead(regime, 20) {W}]) AS label FROM rg),
c AS (SELECT horizon, label, pred, count(*) AS n FROM f WHERE label IS NOT NULL GROUP BY ALL)
SELECT horizon, label, pred, n, round(n / sum(n) OVER (PARTITION BY horizon, label), 6) AS recall_share, round(n / sum(n) OVER (PARTITION BY horizon, pred), 6) AS precision_share,
  round(sum(n) FILTER (label = pred) OVER (PARTITION BY horizon) / sum(n) OVER (PARTITION BY horizon), 6) AS accuracy FROM c""")
def r16_accuracy(spark, sf_dir):
    """Confusion, precision, recall and accuracy of the naive forecast at three horizons."""
    from pyspark.sql import Window

    x = R.labels(R.scores(R.features(series(spark, sf_dir))))
    w = over("symbol")
    x = x.select("symbol", F.col("regime").alias("pred"), F.array(*(F.lead("regime", h).over(w) for h in (1, 5, 20))).alias("_l"))
    long = x.select("symbol", "pred", F.posexplode("_l").alias("k", "label"))
    c = long.filter("label IS NOT NULL").groupBy(F.element_at(F.array(F.lit(1), F.lit(5), F.lit(20)), F.col("k") + 1).alias("horizon"), "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    right = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))).over(Window.partitionBy("horizon"))
    return rounded(c.select("horizon", "label", "pred", "n", (F.col("n") / by("horizon", "label")).alias("recall_share"), (F.col("n") / by("horizon", "pred")).alias("precision_share"), (right / by("horizon")).alias("accuracy")))


@query(REG + """, q AS (SELECT * FROM (VALUES ('bull', 1.2), ('low_volatility', 1.0), ('high_volatility', 0.7), ('bear', 0.5), ('crisis', 0.2)) AS q(r, q))
SELECT symbol, ts, round(least(greatest(rg.size * (1 + 0.3 * (b.q - a.q) * confidence), 0.1), 2), 6) AS size FROM rg JOIN q a ON regime = a.r JOIN q b ON next_regime = b.r""")
def r17_forward_size(spark, sf_dir):
    x = R.detect(series(spark, sf_dir))
    return rounded(x.select("symbol", "ts", R.forward_size(F.col("size"), F.col("regime"), F.col("next_regime"), F.col("confidence")).alias("size")))


def pred_rows(x):
    w = over("symbol")
    rows = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lag("regime", h).over(w).alias("regime"), F.lag("confidence", h).over(w).alias("confidence")) for h in (1, 5, 10, 20)))
    return x.select("symbol", "ts", rows.alias("_r")).select("symbol", "ts", F.explode("_r").alias("p")).select("symbol", "ts", "p.*").filter("regime IS NOT NULL")


PRED = REG + f""", pr AS (SELECT symbol, ts, unnest([1, 5, 10, 20]) AS horizon, unnest([lag(regime, 1) {W}, lag(regime, 5) {W}, lag(regime, 10) {W}, lag(regime, 20) {W}]) AS regime,
  unnest([lag(confidence, 1) {W}, lag(confidence, 5) {W}, lag(confidence, 10) {W}, lag(confidence, 20) {W}]) AS confidence FROM rg), pp AS (SELECT * FROM pr WHERE regime IS NOT NULL)"""


@query(PRED + """, b AS (SELECT symbol, ts, regime, count(*) AS votes, avg(confidence) AS conf, count(*) * avg(confidence) AS w, -min(horizon) AS k FROM pp GROUP BY symbol, ts, regime),
a AS (SELECT symbol, ts, sum(votes) AS n, max(votes) AS most, sum(w) AS aw, max(w) AS mw, last(regime ORDER BY w, k) AS consensus, last(conf ORDER BY w, k) AS strength, count(*) - 1 AS n_other FROM b GROUP BY symbol, ts HAVING sum(votes) >= 2),
i AS (SELECT *, sqrt(most / n * CASE WHEN aw > 0 THEN mw / aw ELSE 0 END) AS ix FROM a),
q AS (SELECT *, CASE WHEN ix >= 0.8 AND strength >= 0.7 THEN 'strong' WHEN ix >= 0.6 AND strength >= 0.6 THEN 'moderate' WHEN n_other >= 3 THEN 'conflicting' ELSE 'weak' END AS quality FROM i)
SELECT quality, CASE WHEN quality = 'strong' THEN CASE consensus WHEN 'bull' THEN 'strong_buy' WHEN 'bear' THEN 'strong_sell' WHEN 'crisis' THEN 'risk_off' WHEN 'high_volatility' THEN 'reduce_size' ELSE 'neutral' END
  WHEN quality = 'moderate' THEN CASE consensus WHEN 'bull' THEN 'moderate_buy' WHEN 'bear' THEN 'moderate_sell' ELSE 'cautious' END WHEN quality = 'conflicting' THEN 'no_position' ELSE 'wait' END AS action, count(*) AS n, round(avg(ix), 5) AS mean_index FROM q GROUP BY ALL""")
def r21_r23_agreement(spark, sf_dir):
    x = R.labels(R.scores(R.features(series(spark, sf_dir))))
    a = R.agreement(pred_rows(x), ["symbol", "ts"])
    return rounded(a.groupBy("quality", "action").agg(F.count(F.lit(1)).alias("n"), F.avg("agreement_index").alias("mean_index")), 5)


@query(PRED + """, c AS (SELECT *, (regime <> lag(regime) OVER (PARTITION BY symbol, ts ORDER BY horizon))::INT AS c FROM pp),
a AS (SELECT symbol, ts, count(*) AS n, coalesce(sum(c), 0) AS m, arg_min(regime, horizon) AS s, arg_max(regime, horizon) AS l FROM c GROUP BY symbol, ts)
SELECT symbol, ts, round(CASE WHEN n < 2 THEN 1 ELSE 1 - m / (n - 1) END, 6) AS stability, s AS short, l AS long, CASE WHEN s = l THEN 'stable' WHEN s = 'bear' AND l = 'bull' THEN 'deteriorating' WHEN s = 'bull' AND l = 'bear' THEN 'improving' WHEN s = 'crisis' THEN 'crisis_entry' WHEN l = 'crisis' THEN 'crisis_exit' ELSE 'transitioning' END AS shift FROM a""")
def r22_horizon_shift(spark, sf_dir):
    return rounded(R.horizon_shift(pred_rows(R.labels(R.scores(R.features(series(spark, sf_dir))))), ["symbol", "ts"]))


def two_labels(spark, sf_dir):
    """The label as truth, and one that comes two bars late as the detected one."""
    x = R.labels(R.scores(R.features(series(spark, sf_dir)))).select("symbol", "ts", "regime")
    return x.withColumn("late", F.coalesce(F.lag("regime", 2).over(over("symbol")), F.col("regime")))


TWO = REG + f""", tl AS (SELECT symbol, ts, i, regime, coalesce(lag(regime, 2) {W}, regime) AS late FROM rg), cl AS (SELECT *, regime <> lag(regime) {W} AS ct, late <> lag(late) {W} AS cd FROM tl),
t AS (SELECT symbol, i FROM cl WHERE ct), d AS (SELECT symbol, i FROM cl WHERE cd), sy AS (SELECT DISTINCT symbol FROM tl)"""


@query(TWO + ", la AS (SELECT symbol, avg(coalesce((SELECT min(d.i - t.i) FROM d WHERE d.symbol = t.symbol AND d.i BETWEEN t.i AND t.i + 9), 10)) AS latency FROM t GROUP BY symbol) SELECT symbol, round(coalesce(latency, 0), 6) AS latency FROM sy LEFT JOIN la USING (symbol)")
def r24_latency(spark, sf_dir):
    return rounded(R.latency(two_labels(spark, sf_dir), "regime", "late"))


@query(TWO + """, td AS (SELECT symbol, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM d WHERE d.symbol = t.symbol AND abs(d.i - t.i) <= 3)) AS m FROM t GROUP BY symbol),
dt AS (SELECT symbol, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE d.symbol = t.symbol AND abs(d.i - t.i) <= 3)) AS m FROM d GROUP BY symbol)
SELECT symbol, round(coalesce(1 - dt.m / dt.n, 0), 6) AS false_rate, round(coalesce(dt.m / dt.n, 0), 6) AS true_rate, round(coalesce(1 - td.m / td.n, 0), 6) AS missed_rate FROM sy LEFT JOIN td USING (symbol) LEFT JOIN dt USING (symbol)""")
def r25_transition_rates(spark, sf_dir):
    return rounded(R.transition_rates(two_labels(spark, sf_dir), "regime", "late"))


@query(REG + ", u AS (SELECT symbol, regime, run, count(*) AS len FROM rg GROUP BY ALL) SELECT symbol, regime, round(quantile_cont(len, 0.5), 6) AS half_life FROM u GROUP BY ALL")
def r26_half_life(spark, sf_dir):
    return rounded(R.half_life(R.durations(R.labels(R.scores(R.features(series(spark, sf_dir)))))))


@query(REG + f""", m AS (SELECT symbol, regime AS from_regime, lead(regime) {W} AS to_regime FROM rg), c AS (SELECT symbol, from_regime, to_regime, count(*) AS n FROM m WHERE to_regime IS NOT NULL GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY symbol, from_regime), 6) AS p FROM c""")
def r28_transitions(spark, sf_dir):
    return rounded(R.transitions(R.labels(R.scores(R.features(series(spark, sf_dir))))))


@query(TWO + """, la AS (SELECT symbol, avg(coalesce((SELECT min(d.i - t.i) FROM d WHERE d.symbol = t.symbol AND d.i BETWEEN t.i AND t.i + 9), 10)) AS latency FROM t GROUP BY symbol),
dt AS (SELECT symbol, count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE d.symbol = t.symbol AND abs(d.i - t.i) <= 3)) / count(*) AS hit FROM d GROUP BY symbol),
st AS (SELECT symbol, greatest(1 - 2 * coalesce(sum(ct::INT), 0) / count(*), 0) AS stability FROM cl GROUP BY symbol),
q AS (SELECT symbol, stability, CASE WHEN coalesce(latency, 0) < 2 THEN 25 WHEN latency < 5 THEN 15 WHEN latency < 10 THEN 5 ELSE 0 END + CASE WHEN coalesce(1 - hit, 0) < 0.2 THEN 25 WHEN 1 - hit < 0.4 THEN 15 WHEN 1 - hit < 0.6 THEN 5 ELSE 0 END
  + CASE WHEN hit > 0.8 THEN 25 WHEN hit > 0.6 THEN 15 WHEN hit > 0.4 THEN 5 ELSE 0 END + CASE WHEN stability > 0.7 THEN 25 WHEN stability > 0.5 THEN 15 WHEN stability > 0.3 THEN 5 ELSE 0 END AS score FROM st LEFT JOIN la USING (symbol) LEFT JOIN dt USING (symbol))
SELECT symbol, round(stability, 6) AS stability, score, CASE WHEN score >= 80 THEN 'EXCELLENT' WHEN score >= 60 THEN 'GOOD' WHEN score >= 40 THEN 'ADEQUATE' ELSE 'POOR' END AS quality FROM q""")
def r27_r30_quality(spark, sf_dir):
    x = two_labels(spark, sf_dir)
    y = R.latency(x, "regime", "late").join(R.transition_rates(x, "regime", "late"), "symbol").join(R.stability(x), "symbol")
    score, name = R.detection_quality(F.col("latency"), F.col("false_rate"), F.col("true_rate"), F.col("stability"))
    return rounded(y.select("symbol", "stability", score.alias("score"), name.alias("quality")))


@query(REG + """, a AS (SELECT symbol, regime, avg(ret) AS m, avg(realized_vol) AS v FROM rg GROUP BY ALL),
b AS (SELECT *, CASE regime WHEN 'low_volatility' THEN CASE WHEN v < 0.15 THEN 1.0 ELSE greatest(0, 1 - (v - 0.15) / 0.15) END WHEN 'bull' THEN CASE WHEN v < 0.3 THEN 1.0 ELSE greatest(0, 1 - (v - 0.3) / 0.2) END
  WHEN 'bear' THEN least(1, v / 0.2) WHEN 'high_volatility' THEN least(1, v / 0.4) ELSE least(1, v / 0.5) END AS vp, CASE WHEN regime = 'bull' THEN (m > 0)::INT WHEN regime IN ('bear', 'crisis') THEN (m < 0)::INT END AS sp FROM a)
SELECT symbol, regime, round(CASE WHEN sp IS NULL THEN vp ELSE (vp + sp) / 2 END, 6) AS purity FROM b""")
def r29_purity(spark, sf_dir):
    return rounded(R.purity(R.labels(R.scores(R.features(series(spark, sf_dir))))))


GLOBAL = REG + f""", ca AS (SELECT *, {CLASS} AS asset_class FROM rg)"""


@query(GLOBAL + """, w AS (SELECT *, coalesce(CASE asset_class || '/' || regime WHEN 'equity/bull' THEN 1.0 WHEN 'equity/bear' THEN -1.0 WHEN 'equity/crisis' THEN -2.0 WHEN 'bond/bull' THEN -0.5 WHEN 'bond/bear' THEN 0.5
  WHEN 'commodity/bull' THEN 0.5 WHEN 'commodity/bear' THEN -0.3 WHEN 'crypto/bull' THEN 0.3 WHEN 'crypto/bear' THEN -0.3 END, 0) * confidence AS w FROM ca),
a AS (SELECT ts, count(*) AS n, least(greatest(sum(w), -3), 3) AS s, count(*) FILTER (regime = 'crisis') AS nc, avg(confidence) AS conf,
  greatest(count(*) FILTER (regime = 'bull'), count(*) FILTER (regime = 'bear'), count(*) FILTER (regime = 'high_volatility'), count(*) FILTER (regime = 'low_volatility'), count(*) FILTER (regime = 'crisis')) / count(*) AS sy FROM w GROUP BY ts)
SELECT ts, n, round(s, 5) AS risk_score, round(sy, 6) AS synchronisation, CASE WHEN nc >= 0.5 * n THEN 'crisis' WHEN s > 1 THEN 'risk_on' WHEN s < -1 THEN 'risk_off' WHEN s > 0 AND nc > 0 THEN 'recovery' WHEN s > 0 THEN 'risk_on' ELSE 'mixed' END AS global_regime,
  round(conf * CASE WHEN nc >= 0.5 * n THEN 1 WHEN abs(s) > 1 THEN 1 WHEN s > 0 AND nc > 0 THEN 0.8 WHEN s > 0 THEN 0.7 ELSE 0.6 END, 6) AS confidence FROM a""")
def r31_r32_global(spark, sf_dir):
    x = R.labels(R.scores(R.features(series(spark, sf_dir)))).withColumn("asset_class", asset_class(F.col("symbol")))
    return rounded(R.global_regime(x), risk_score=5)


@query(REG + " SELECT a.ts, least(a.symbol, b.symbol) AS a, greatest(a.symbol, b.symbol) AS b FROM rg a JOIN rg b ON a.ts = b.ts AND a.regime = 'bull' AND b.regime = 'bear'")
def r33_divergent(spark, sf_dir):
    return R.divergent(R.labels(R.scores(R.features(series(spark, sf_dir)))))


@query(REG + ", b AS (SELECT ts, ret AS br FROM rg WHERE symbol = 'Brand#11') SELECT symbol, count(*) AS n, round(coalesce(corr(ret, br), 0), 5) AS correlation FROM rg JOIN b USING (ts) GROUP BY symbol")
def r34_correlation(spark, sf_dir):
    return rounded(R.benchmark_correlation(R.features(series(spark, sf_dir)), "Brand#11"), 5)


@query(REG + f""", rv AS (SELECT *, {roll('stddev_samp', 'ret', 60)} AS vol60 FROM rg), q AS (SELECT symbol, quantile_cont(vol60, 0.33) AS qa, quantile_cont(vol60, 0.67) AS qb FROM rv GROUP BY symbol),
v AS (SELECT rv.*, (vol60 > qa)::INT + (vol60 > qb)::INT AS vol_bin, {roll('avg', 'close', 60)} AS m60 FROM rv JOIN q USING (symbol))
SELECT symbol, vol_bin, CASE WHEN close > m60 * 1.02 THEN 'up' WHEN close < m60 * 0.98 THEN 'down' WHEN m60 IS NOT NULL THEN 'sideways' END AS trend, count(*) AS n FROM v GROUP BY ALL""")
def b30_b31_bins(spark, sf_dir):
    x = R.trend(R.volatility_bins(R.features(series(spark, sf_dir))))
    return x.groupBy("symbol", "vol_bin", "trend").agg(F.count(F.lit(1)).alias("n"))


@query(REG + """ SELECT symbol, regime, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS vol, round(avg((ret > 0)::INT::DOUBLE), 6) AS hit_rate, round(coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0), 6) AS sharpe
FROM rg WHERE ret IS NOT NULL GROUP BY symbol, regime HAVING count(*) >= 10""")
def b32_by_regime(spark, sf_dir):
    x = R.by_regime(R.labels(R.scores(R.features(series(spark, sf_dir)))), "regime")
    return rounded(x)


@query(REG + """, g AS (SELECT symbol, regime, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS s FROM rg WHERE ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
p AS (SELECT symbol, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, CAST(count(*) // 10 AS BIGINT) AS trades, last(regime ORDER BY ts) AS regime, last(stay ORDER BY ts) AS stay, last(confidence ORDER BY ts) AS confidence FROM rg GROUP BY symbol),
d AS (SELECT symbol, stddev_pop(s) AS dispersion, count(*) AS nr FROM g GROUP BY symbol),
f AS (SELECT symbol, CASE WHEN sharpe <= 0 THEN 0.1 ELSE 0.3 + 0.65 / (1 + exp(-2.0 * (sharpe - 1.5))) END AS f1, 0.5 + 0.45 / (1 + exp(-0.02 * (trades - 100))) AS f2, 0.4 + 0.6 / (1 + exp(-2.0 * (trades / (4 * 1.5 * 10 + 1e-6) - 1))) AS f3,
  greatest(0.3, 1 / sqrt(ln(9 + 1))) AS f4, least(greatest((0.5 + 0.3 * stay + 0.2 * confidence) * CASE regime WHEN 'bull' THEN 1.0 WHEN 'bear' THEN 0.9 WHEN 'low_volatility' THEN 0.95 WHEN 'high_volatility' THEN 0.7 ELSE 0.5 END, 0), 1) AS f6,
  CASE WHEN nr < 2 THEN 0.7 ELSE coalesce(greatest(0.3, 1 / (1 + dispersion)), 0.8) END AS f7 FROM p LEFT JOIN d USING (symbol)),
x AS (SELECT symbol, least(greatest(pow(f1, 0.3) * pow(f2, 0.2) * pow(f3, 0.2) * pow(f4, 0.1) * pow(0.7, 0.1) * pow(f6, 0.08) * pow(f7, 0.02), 0), 1) AS pbr FROM f)
SELECT symbol, round(pbr, 6) AS pbr, CASE WHEN pbr >= 0.8 THEN 'very_high' WHEN pbr >= 0.65 THEN 'high' WHEN pbr >= 0.5 THEN 'moderate' WHEN pbr >= 0.35 THEN 'low' ELSE 'very_low' END AS reading FROM x""")
def b33_pbr(spark, sf_dir):
    x = R.detect(series(spark, sf_dir))
    import math

    disp = R.by_regime(x, "regime").groupBy("symbol").agg(F.stddev_pop(F.when(F.col("vol") > 0, F.col("sharpe") * math.sqrt(252))).alias("dispersion"), F.count(F.lit(1)).alias("n_regimes"))
    from ..functions.exprs import div

    p = x.groupBy("symbol").agg((div(F.avg("ret"), F.stddev_samp("ret")) * math.sqrt(252)).alias("sharpe"), F.floor(F.count(F.lit(1)) / 10).alias("trades"), *(F.max_by(n, "ts").alias(n) for n in ("regime", "stay", "confidence")))
    p = p.join(disp, "symbol", "left").withColumns({"params": F.lit(4.0), "models": F.lit(9), "wf": F.lit(None).cast("double")})
    return rounded(R.pbr(p).select("symbol", "pbr", "reading"))


@query("WITH RECURSIVE " + REG.split("WITH ", 1)[1] + f""", e AS (SELECT symbol, ts, row_number() {W} AS k, regime, confidence, pow(confidence, 0.3) * pow(least(0.95, 0.5 + duration / 100.0), 0.3) * pow(CASE WHEN ma_trend > 0.05 THEN 0.8 WHEN ma_trend < -0.05 THEN 0.3 ELSE 0.6 END, 0.2) * pow(CASE WHEN realized_vol < 0.10 THEN 0.9 WHEN realized_vol > 0.50 THEN 0.2 ELSE 0.6 END, 0.2) AS pbr FROM rg),
v AS MATERIALIZED (SELECT symbol, ts, k, CASE WHEN regime = 'bull' AND confidence > 0.6 AND pbr > 0.5 THEN 1 WHEN regime IN ('bear', 'crisis') AND confidence > 0.6 AND pbr > 0.4 THEN -1 ELSE 0 END AS flat,
  CASE WHEN regime = 'bull' AND NOT coalesce(confidence < 0.4, false) THEN 1 ELSE 0 END AS long, CASE WHEN regime IN ('bear', 'crisis') AND NOT coalesce(confidence < 0.4, false) THEN -1 ELSE 0 END AS short FROM e),
m(symbol, k, pos) AS (SELECT DISTINCT symbol, 0::BIGINT, 0 FROM v UNION ALL SELECT v.symbol, v.k, CASE pos WHEN 0 THEN flat WHEN 1 THEN long ELSE short END FROM m JOIN v ON v.symbol = m.symbol AND v.k = m.k + 1)
SELECT symbol, ts, pos, coalesce(pos <> lag(pos) {W}, pos <> 0) AS changed FROM m JOIN v USING (symbol, k)""")
def s14_regime_strategy(spark, sf_dir):
    from ..operators import signals

    x = R.durations(R.labels(R.scores(R.features(series(spark, sf_dir)))))
    x = x.withColumn("pbr", R.display_score(F.col("confidence"), R.stay_by_duration(F.col("duration")), F.col("ma_trend"), F.col("realized_vol")))
    return signals.regime_positions(x, ["symbol"]).select("symbol", "ts", "pos", "changed")


CAL = """WITH p AS (SELECT doc_id, quality AS y, (doc_id * 7919 + 13) % 1000 / 1000.0 * 0.5 + 0.4 * quality AS p FROM labels WHERE quality IS NOT NULL),
b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y, sum((p - y) * (p - y)) AS se FROM p GROUP BY ALL)"""


@query(CAL + " SELECT bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, round(sum(se) OVER () / sum(n) OVER (), 6) AS brier, round(sum(n * abs(mean_p - mean_y)) OVER () / sum(n) OVER (), 6) AS ece, round(max(abs(mean_p - mean_y)) OVER (), 6) AS mce, sum(n * abs(mean_p - mean_y)) OVER () / sum(n) OVER () < 0.1 AND sum(se) OVER () / sum(n) OVER () < 0.25 AS calibrated FROM b")
def r20_reliability(spark, sf_dir):
    """Reliability curve and Brier, ECE, MCE of probabilities against labels."""
    from ..operators import calibration

    p = (F.col("doc_id") * 7919 + 13) % 1000 / 1000.0 * 0.5 + 0.4 * F.col("quality")
    return rounded(calibration.reliability(B.table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select(F.col("quality").alias("y"), p.alias("p"))))

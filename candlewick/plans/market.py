"""Queries on bars: sources, cleaning, quality, features, signals and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, r6
from ..operators import checks, features, metrics, signals
from ..sources import bars as B
from .registry import DAILY, RSI_RULE, W, intraday, query, roll

S = ["symbol"]


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """All double columns rounded; other digits by name."""
    return df.select(*(r6(F.col(n), other.get(n, digits)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def rule(spark, sf_dir):
    return signals.fills(signals.rsi_rule(B.daily_bars(spark, sf_dir)), S)


@query(RSI_RULE + """
SELECT symbol, count(*) AS n_bars, round(arg_max(equity, ts), 4) AS final_equity, round(100 * (arg_max(equity, ts) / 1000 - 1), 4) AS gain_pct,
  round(CASE WHEN count(ret) FILTER (ret < -1e-9) >= 2 AND stddev_pop(ret) FILTER (ret < -1e-9) > 0 THEN avg(ret) / (stddev_pop(ret) FILTER (ret < -1e-9)) * sqrt(98280) ELSE 0 END, 4) AS sortino,
  round(100 * min(drawdown), 4) AS max_drawdown_pct,
  round(CASE WHEN coalesce(-sum(change) FILTER (change < 0), 0) > 0 THEN coalesce(sum(change) FILTER (change > 0), 0) / (-sum(change) FILTER (change < 0))
    WHEN coalesce(sum(change) FILTER (change > 0), 0) > 0 THEN coalesce(sum(change) FILTER (change > 0), 0) * 1000 ELSE 1 END, 4) AS profit_factor
FROM er GROUP BY symbol""")  # fmt: skip
def rsi_backtest_metrics(spark, sf_dir):
    """The flagship; trades, equity and metrics of the RSI rule on daily bars."""
    return rounded(metrics.equity_metrics(signals.equity(rule(spark, sf_dir), S), S), 4)


@query(DAILY + " SELECT symbol, tf, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars")
def a01_daily_bars(spark, sf_dir):
    return rounded(B.daily_bars(spark, sf_dir))


@query(intraday("hourly", 3600) + " SELECT symbol, tf, ts, open, high, low, close, volume FROM bars")
def a02_hourly_bars(spark, sf_dir):
    return B.intraday_bars(spark, sf_dir, "hourly")


@query(intraday("5min", 300) + ", e AS (SELECT symbol, max(ts) AS m FROM bars GROUP BY symbol) SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bars JOIN e USING (symbol) WHERE ts >= m - INTERVAL 59 DAYS GROUP BY symbol")
def a01_capped_history(spark, sf_dir):
    b = B.cap_history(B.intraday_bars(spark, sf_dir, "5min"))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' btc ' WHEN 1 THEN 'eth' ELSE lower(c_mktsegment) || ' ' END AS raw FROM customer),
n AS (SELECT c_custkey, coalesce(map {'BTC': 'BTC-USD', 'ETH': 'ETH-USD', 'SOL': 'SOL-USD', 'DOGE': 'DOGE-USD'}[upper(trim(raw))], upper(trim(raw))) AS symbol FROM s)
SELECT symbol, contains(symbol, '-USD') AS crypto, CASE WHEN contains(symbol, '-USD') THEN replace(symbol, '-USD', '/USD') ELSE symbol END AS broker, count(*) AS n FROM n GROUP BY ALL""")
def a03_symbols(spark, sf_dir):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.lit(" btc ")).when(k == 1, F.lit("eth")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" ")))
    s = B.table(spark, sf_dir, "customer").select(B.normalise_symbol(raw).alias("symbol"))
    return s.groupBy("symbol", B.is_crypto(F.col("symbol")).alias("crypto"), B.broker_symbol(F.col("symbol")).alias("broker")).agg(F.count(F.lit(1)).alias("n"))


@query(DAILY + " SELECT symbol, count(*) AS n FROM bars WHERE upper(symbol) IN (SELECT upper(trim(p_brand)) FROM part WHERE p_size > 45) GROUP BY symbol")
def a11_universe(spark, sf_dir):
    uni = B.table(spark, sf_dir, "part").filter("p_size > 45").select(F.col("p_brand").alias("ticker"))
    up = B.daily_bars(spark, sf_dir).withColumn("raw", F.col("symbol")).withColumn("symbol", F.upper("symbol"))
    return B.in_universe(up, uni).groupBy(F.col("raw").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


CLASS = "['equity', 'bond', 'commodity', 'crypto'][1 + CAST(ascii(right(symbol, 1)) % 4 AS INT)]"


def asset_class(symbol):
    return F.element_at(F.array(*map(F.lit, ("equity", "bond", "commodity", "crypto"))), F.ascii(F.right(symbol, F.lit(1))) % 4 + 1)


@query(DAILY + f" SELECT symbol, {CLASS} AS asset_class, count(*) AS n FROM bars GROUP BY ALL HAVING count(*) >= 100")
def a12_multi_asset(spark, sf_dir):
    b = B.daily_bars(spark, sf_dir)
    classes = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct().select("symbol", asset_class(F.col("symbol")).alias("asset_class"))
    return B.multi_asset(b, classes).groupBy("symbol", "asset_class").agg(F.count(F.lit(1)).alias("n"))


@query(DAILY + f" SELECT symbol, tf, ts, round(1000 * close / first_value(close) {W}, 6) AS equity FROM bars")
def a18_buy_and_hold(spark, sf_dir):
    return rounded(B.buy_and_hold(B.daily_bars(spark, sf_dir)))


@query(DAILY + f""", x AS (SELECT *, coalesce(abs(close / nullif(lag(close) {W}, 0) - 1) > 0.5, false) AS extreme FROM bars WHERE close > 0)
SELECT symbol, count(*) AS n, CAST(sum(extreme::INT) AS BIGINT) AS n_extreme, round(min(close), 6) AS low_close FROM x GROUP BY symbol""")
def c01_c04_clean(spark, sf_dir):
    x = B.clean(B.daily_bars(spark, sf_dir))
    return rounded(x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("extreme").cast("long")).alias("n_extreme"), F.min("close").alias("low_close")))


@query(f"""WITH h AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, last(value ORDER BY event_id) AS price FROM events WHERE value > 0 GROUP BY ALL)
SELECT symbol, ts, price, coalesce(abs(price / lag(price) {W} - 1) > 0.5, false) AS extreme FROM h""")
def c03_keep_last(spark, sf_dir):
    """The last row of each timestamp by arrival."""
    p = F.col("price")
    t = B.ticks_of(spark, sf_dir).select("symbol", F.lit("hourly").alias("tf"), F.date_trunc("hour", "ts").alias("ts"), *(p.alias(c) for c in ("open", "high", "low", "close")), F.col("qty").alias("volume"), "event_id")
    return B.clean(t, seq="event_id").select("symbol", "ts", F.col("close").alias("price"), "extreme")


@query(DAILY + ", e AS (SELECT symbol, max(ts) AS m FROM bars GROUP BY symbol) SELECT symbol, count(*) AS n, round(avg(close), 6) AS mean_close FROM bars JOIN e USING (symbol) WHERE ts >= m - INTERVAL 365 DAYS GROUP BY symbol")
def c06_last_days(spark, sf_dir):
    x = B.last_days(B.daily_bars(spark, sf_dir), 365, "daily")
    return rounded(x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close")))


@query(DAILY + ", x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) SELECT symbol, ts, round(close, 6) AS close, 12 AS win_short, 24 AS win_mid, 96 AS win_long FROM x WHERE k <= 120")
def c07_tail(spark, sf_dir):
    return rounded(B.tail(B.daily_bars(spark, sf_dir), 120).select("symbol", "ts", "close", "win_short", "win_mid", "win_long"))


V = f""", x AS (
  SELECT *, close / nullif(lag(close) {W}, 0) - 1 AS ret, epoch(ts) - epoch(lag(ts) {W}) AS gap, coalesce(ts < lag(ts) {W}, false) AS back FROM bars),
y AS (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS m, stddev_samp(ret) OVER (PARTITION BY symbol) AS sd, count(*) OVER (PARTITION BY symbol) AS nr FROM x),
wide AS (SELECT symbol, tf, count(*) AS n_all, count(*) FILTER (back) AS v2, count(*) - count(DISTINCT ts) AS v3,
  count(*) FILTER (open IS NULL) AS v4o, count(*) FILTER (high IS NULL) AS v4h, count(*) FILTER (low IS NULL) AS v4l, count(*) FILTER (close IS NULL) AS v4c, count(*) FILTER (volume IS NULL) AS v4v,
  count(*) FILTER (open <= 0) AS v5o, count(*) FILTER (high <= 0) AS v5h, count(*) FILTER (low <= 0) AS v5l, count(*) FILTER (close <= 0) AS v5c,
  count(*) FILTER (abs(ret) > 0.5) AS v6, count(*) FILTER (volume < 0) AS v7, CASE WHEN count(*) FILTER (volume = 0) >= 0.05 * count(*) THEN count(*) FILTER (volume = 0) ELSE 0 END AS v8,
  count(*) FILTER (gap > GAP) AS v9, 0 AS v10, count(*) FILTER (high < low) AS v11, count(*) FILTER (high < open OR high < close) AS v12, count(*) FILTER (low > open OR low > close) AS v13,
  count(*) FILTER (nr >= 30 AND abs(ret - m) > 5 * sd) AS v14,
  [100.0 * count(*) FILTER (open IS NULL) / count(*), 100.0 * count(*) FILTER (high IS NULL) / count(*), 100.0 * count(*) FILTER (low IS NULL) / count(*), 100.0 * count(*) FILTER (close IS NULL) / count(*), 100.0 * count(*) FILTER (volume IS NULL) / count(*)] AS nulls,
  max(abs(ret)) AS most, (max(gap) FILTER (gap > GAP))::DOUBLE AS longest, max(abs(ret - m) / nullif(sd, 0)) FILTER (nr >= 30) AS z FROM y GROUP BY symbol, tf),
dq AS (SELECT symbol, tf, unnest(['not_empty', 'index_sorted', 'no_duplicate_timestamps', 'no_nulls_open', 'no_nulls_high', 'no_nulls_low', 'no_nulls_close', 'no_nulls_volume',
  'positive_prices_open', 'positive_prices_high', 'positive_prices_low', 'positive_prices_close', 'no_extreme_moves_close', 'non_negative_volume', 'sufficient_volume', 'no_unexpected_gaps', 'has_timezone',
  'high_gte_low', 'high_gte_open_close', 'low_lte_open_close', 'no_statistical_outliers']) AS check_name,
  unnest(['critical', 'critical', 'error', 'critical', 'critical', 'critical', 'critical', 'critical', 'critical', 'critical', 'critical', 'critical', 'warning', 'error', 'warning', 'warning', 'warning', 'error', 'error', 'error', 'warning']) AS severity,
  unnest([0, v2, v3, v4o, v4h, v4l, v4c, v4v, v5o, v5h, v5l, v5c, v6, v7, v8, v9, v10, v11, v12, v13, v14]) AS n,
  unnest([NULL, NULL, NULL, nulls[1], nulls[2], nulls[3], nulls[4], nulls[5], NULL, NULL, NULL, NULL, most, NULL, NULL, longest, NULL, NULL, NULL, NULL, z]) AS detail FROM wide)"""


@query(DAILY + V.replace("GAP", "259200") + " SELECT symbol, tf, check_name, n = 0 AS passed, severity, CAST(n AS BIGINT) AS n, round(detail, 6) AS detail FROM dq")
def v01_v14_checks(spark, sf_dir):
    return rounded(checks.suite(B.daily_bars(spark, sf_dir)))


@query(intraday("hourly", 3600) + V.replace("GAP", "7200") + """ SELECT symbol, tf, count(*) AS total, count(*) FILTER (n = 0) AS passed, count(*) FILTER (n > 0 AND severity = 'critical') AS critical,
  count(*) FILTER (n > 0 AND severity = 'error') AS error, count(*) FILTER (n > 0 AND severity = 'warning') AS warning, count(*) FILTER (n > 0 AND severity = 'critical') > 0 AS has_critical,
  '{"total":' || count(*) || ',"passed":' || count(*) FILTER (n = 0) || ',"critical":' || count(*) FILTER (n > 0 AND severity = 'critical') || ',"error":' || count(*) FILTER (n > 0 AND severity = 'error') || ',"warning":' || count(*) FILTER (n > 0 AND severity = 'warning') || '}' AS report
FROM dq GROUP BY symbol, tf""")
def v15_a14_report(spark, sf_dir):
    return checks.summary(checks.suite(B.intraday_bars(spark, sf_dir, "hourly")))


@query(DAILY + """, sp AS (SELECT DISTINCT symbol, d, r FROM (SELECT symbol FROM bars), (VALUES (TIMESTAMP '1997-06-02', 2.0), (TIMESTAMP '1999-03-01', 3.0)) AS s(d, r))
SELECT symbol, ts, round(close / coalesce((SELECT product(r) FROM sp WHERE sp.symbol = bars.symbol AND sp.d > bars.ts), 1), 9) AS close,
  round(volume * coalesce((SELECT product(r) FROM sp WHERE sp.symbol = bars.symbol AND sp.d > bars.ts), 1), 9) AS volume FROM bars""")
def v16_splits(spark, sf_dir):
    b = B.daily_bars(spark, sf_dir)
    splits = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct().select("symbol", F.explode(F.expr("array(struct(DATE'1997-06-02' AS date, 2.0D AS ratio), struct(DATE'1999-03-01' AS date, 3.0D AS ratio))")).alias("s")).select("symbol", "s.*")
    return rounded(checks.adjust_splits(b, splits).select("symbol", "ts", "close", "volume"), 9)


@query(DAILY + f""", k AS (SELECT *, CASE WHEN day(ts) = 15 AND month(ts) % 3 = 0 THEN coalesce(1 - (0.01 * close + 1) / nullif(close, 0), 1) ELSE 1 END AS k FROM bars),
f AS (SELECT *, coalesce(product(k) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS f FROM k)
SELECT symbol, ts, round(close * f, 6) AS close FROM f""")
def v17_dividends(spark, sf_dir):
    b = B.daily_bars(spark, sf_dir)
    paid = b.filter("day(ts) = 15 AND month(ts) % 3 = 0").select("symbol", F.to_date("ts").alias("ex_date"), (0.01 * F.col("close") + 1).alias("amount"))
    return rounded(checks.adjust_dividends(b, paid).select("symbol", "ts", "close"))


def _ema(span: float, n: int, x: str = "close") -> str:
    a = 2.0 / (span + 1.0)
    return f"list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND CURRENT ROW), lambda a, v: a * (1.0 - {a!r}) + v * {a!r})"


F_BASE = f""", f0 AS (SELECT *, close / lag(close) {W} - 1 AS ret, close - lag(close) {W} AS diff, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr,
  high - lag(high) {W} AS hi, lag(low) {W} - low AS lo FROM bars),
f1 AS (SELECT *, coalesce(greatest(diff, 0.0), 0.0) AS up, coalesce(greatest(-diff, 0.0), 0.0) AS down, CASE WHEN hi > lo AND hi > 0 THEN hi ELSE 0.0 END AS pdm, CASE WHEN lo > hi AND lo > 0 THEN lo ELSE 0.0 END AS mdm,
  lag(diff) {W} AS pdiff FROM f0)"""


@query(DAILY + F_BASE + f""", f2 AS (SELECT *, {roll('avg', 'up', 14)} AS ag, {roll('avg', 'down', 14)} AS al, {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd, {roll('avg', 'tr', 14)} AS atr,
  {roll('avg', 'volume', 20)} AS vma, {roll('avg', 'pdm', 14)} AS mp, {roll('avg', 'mdm', 14)} AS mm FROM f1),
f3 AS (SELECT *, 100 * mp / nullif(atr, 0) AS pdi, 100 * mm / nullif(atr, 0) AS mdi FROM f2),
f4 AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM f3)
SELECT symbol, ts, round(close / lag(close) {W} - 1, 6) AS returns_1, round(close / lag(close, 5) {W} - 1, 6) AS returns_5, round(close / lag(close, 20) {W} - 1, 6) AS returns_20,
  round(({roll('stddev_samp', 'ret', 20)}) * sqrt(252), 6) AS volatility_20, round(CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100.0 END, 6) AS rsi_14,
  round((close - mid) / nullif(4 * sd, 0), 6) AS bb_position_20, round(atr, 6) AS atr_14, round(volume / nullif(vma, 0), 6) AS volume_ratio_20,
  round(sum(coalesce(sign(diff) * volume, 0)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS obv, round((high - low) / nullif(close, 0), 6) AS hl_spread, round({roll('avg', 'dx', 14)}, 6) AS adx_14 FROM f4""")
def f01_f17_standard(spark, sf_dir):
    """The standard set, but for MACD."""
    p = features.Pipeline("standard", [f for f in features.standard() if f.name != "macd"])
    return rounded(p.compute(B.daily_bars(spark, sf_dir)).select("symbol", "ts", *p.names()))


@query(DAILY + f""", m AS (SELECT symbol, ts, {_ema(12, 300)} - {_ema(26, 650)} AS macd FROM bars), s AS (SELECT *, {_ema(9, 225, 'macd')} AS sig FROM m)
SELECT symbol, ts, round(macd, 6) AS macd, round(sig, 6) AS macd_signal, round(macd - sig, 6) AS macd_histogram FROM s""")
def f14_macd(spark, sf_dir):
    p = features.Pipeline("macd", [features.macd()])
    return rounded(p.compute(B.daily_bars(spark, sf_dir)).select("symbol", "ts", *p.names()))


@query(DAILY + F_BASE + f""", c AS (SELECT *, CASE WHEN count(pdiff) OVER f = 19 THEN covar_samp(diff, pdiff) OVER f END AS cov, abs(ret) / nullif(close * volume, 0) AS illiq FROM f1
  WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 18 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, round(CASE WHEN close / lag(close) {W} > 0 THEN ln(close / lag(close) {W}) END, 6) AS log_returns_1, round(tr, 9) AS true_range, round({roll('avg', 'volume', 20)}, 6) AS volume_ma_20,
  round(sum((high + low + close) / 3 * volume) OVER r / nullif(sum(volume) OVER r, 0), 6) AS vwap, round(2 * sqrt(greatest(-cov, 0.0)), 6) AS roll_spread_20,
  round({roll('avg', 'volume', 10)}, 6) AS depth_10, round(1000000 * ({roll('avg', 'illiq', 20)}), 6) AS amihud_20 FROM c WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def f06_f20_more(spark, sf_dir):
    """F1 (log) F6 F8 F10 F13 F20."""
    p = features.Pipeline("more", [features.returns(1, log=True), features.true_range(), features.volume_ma(20), features.vwap(), features.roll_spread(20), features.market_depth(10), features.amihud(20)])
    x = p.compute(B.daily_bars(spark, sf_dir)).select("symbol", "ts", *p.names())
    return rounded(x.withColumn("amihud_20", 1000000 * F.col("amihud_20")), true_range=9)


@query(DAILY + """ SELECT symbol, round(least(avg(volume) * 50000 / 1e6 * 4, 40) + greatest(40 - avg((high - low) / close) * 10 * 0.4, 0) + least(sum(volume) * 100000 / 1e9 * 2, 20), 6) AS score FROM bars GROUP BY symbol""")
def f21_liquidity(spark, sf_dir):
    a = B.daily_bars(spark, sf_dir).groupBy("symbol").agg(F.avg("volume").alias("v"), F.avg((F.col("high") - F.col("low")) / F.col("close")).alias("s"), F.sum("volume").alias("m"))
    return rounded(a.select("symbol", features.liquidity_score(F.col("v") * 50000, F.col("s") * 10, F.col("m") * 100000).alias("score")))


@query(DAILY + F_BASE + f""", g0 AS (SELECT *, ({roll('stddev_pop', 'ret', 20)}) * sqrt(252) AS vol, close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd, close / ({roll('max', 'close', 60)}) - 1 AS fall,
  list_reduce(list(up) OVER l, lambda a, v: a * (1.0 - {1 / 14!r}) + v * {1 / 14!r}) AS g, list_reduce(list(down) OVER l, lambda a, v: a * (1.0 - {1 / 14!r}) + v * {1 / 14!r}) AS l FROM f1
  WINDOW l AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 405 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, lag(close, 20) {W} AS was, lag(vol, 20) {W} AS older FROM g0)
SELECT symbol, ts, round(CASE WHEN was IS NULL THEN 0 ELSE least(greatest(close / was - 1, -1), 10) END, 6) AS pine_roc, round(dd, 6) AS pine_drawdown, round(vol, 6) AS pine_vol,
  round(CASE WHEN was IS NULL THEN 0 ELSE least(greatest(pow(close / was, 12.6) - 1, -1), 10) END, 6) AS pine_ann_return, round({roll('min', 'fall', 60)}, 6) AS pine_max_drawdown,
  round(CASE WHEN older > 0 THEN vol / older - 1 ELSE 0 END, 6) AS pine_vol_trend, round(CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) ELSE 100 END, 6) AS pine_rsi FROM g""")
def f22_pine(spark, sf_dir):
    p = features.Pipeline("pine", [features.pine_set()])
    return rounded(p.compute(B.daily_bars(spark, sf_dir)).select("symbol", "ts", *p.names()))


@query(RSI_RULE + " SELECT symbol, trade_id, entry_ts, round(entry_price, 6) AS entry_price, ts AS exit_ts, round(exit_price, 6) AS exit_price, round(100 * (f - 1), 4) AS pct_change, round(equity_after / f, 4) AS equity_before, round(equity_after, 4) AS equity_after FROM filled WHERE ends")
def s07_s08_trades(spark, sf_dir):
    t = signals.trades(rule(spark, sf_dir), S)
    return rounded(t, 4, entry_price=6, exit_price=6)


@query(RSI_RULE + " SELECT symbol, ts, round(equity, 4) AS equity FROM eq")
def s09_equity(spark, sf_dir):
    return rounded(signals.equity(rule(spark, sf_dir), S), 4)


@query(RSI_RULE + """, t2 AS (SELECT symbol, list(f ORDER BY trade_id) AS l FROM filled WHERE ends GROUP BY symbol)
SELECT symbol, round(list_reduce(list_prepend(1000.0, l), lambda a, f: (a - 1.0) * f - 1.0), 4) AS final_equity FROM t2""")
def s10_fixed_commission(spark, sf_dir):
    return rounded(signals.fixed_commission(signals.trades(rule(spark, sf_dir), S), S, 1.0), 4)


@query("""WITH e AS (SELECT event_type AS symbol, ts AS tts, event_id, value AS price FROM events),
f AS (SELECT symbol, to_timestamp((epoch_us(tts) // 60000000) * 60)::TIMESTAMP AS ts, last(price ORDER BY tts, event_id) AS close FROM e GROUP BY ALL),
k AS (SELECT symbol, to_timestamp((epoch_us(tts) // 300000000) * 300)::TIMESTAMP AS ts, last(price ORDER BY tts, event_id) AS slow FROM e GROUP BY ALL)
SELECT f.symbol, f.ts, f.close, coalesce(slow, 0) AS slow FROM f LEFT JOIN k ON f.symbol = k.symbol AND k.ts = to_timestamp((epoch_us(f.ts) // 300000000) * 300)::TIMESTAMP""")
def s04_five_minutes(spark, sf_dir):
    """The close of the five-minute bar on each minute in it."""
    fine, coarse = (B.intraday_bars(spark, sf_dir, tf) for tf in ("1min", "5min"))
    return signals.align(fine.select("symbol", "ts", "close"), coarse, "5min", "close", "slow")


S4 = f"""WITH t AS (SELECT event_type AS symbol, ts AS tts, event_id, value AS price FROM events),
h AS (SELECT symbol, date_trunc('hour', tts) AS ts, last(price ORDER BY tts, event_id) AS close FROM t GROUP BY ALL),
d AS (SELECT symbol, date_trunc('day', tts) AS ts, last(price ORDER BY tts, event_id) AS close FROM t GROUP BY ALL),
hd AS (SELECT *, close - lag(close) {W} AS x, row_number() {W} - 1 AS i FROM h), dd AS (SELECT *, close - lag(close) {W} AS x FROM d),
hg AS (SELECT *, avg(coalesce(greatest(x, 0.0), 0.0)) OVER w AS g, avg(coalesce(greatest(-x, 0.0), 0.0)) OVER w AS l FROM hd WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
dg AS (SELECT *, avg(coalesce(greatest(x, 0.0), 0.0)) OVER w AS g, avg(coalesce(greatest(-x, 0.0), 0.0)) OVER w AS l FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
hr AS (SELECT *, CASE WHEN l = 0 THEN 0.0 ELSE 100 - 100 / (1 + g / l) END AS rsi0 FROM hg), dr AS (SELECT symbol, ts, CASE WHEN l = 0 THEN 0.0 ELSE 100 - 100 / (1 + g / l) END AS day_rsi FROM dg),
s AS (SELECT hr.symbol, hr.ts, avg(rsi0) OVER (PARTITION BY hr.symbol ORDER BY hr.ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rsi, ((i - 3) % 10 + 10) % 10 < 7 AS cyc, coalesce(day_rsi, 0.0) AS day_rsi
  FROM hr LEFT JOIN dr ON hr.symbol = dr.symbol AND date_trunc('day', hr.ts) = dr.ts)"""


@query(S4 + " SELECT symbol, ts, round(rsi, 6) AS rsi, cyc AS cycle, round(day_rsi, 6) AS day_rsi, rsi < 45 AND cyc AND day_rsi < 60 AS entry, rsi > 55 OR NOT cyc OR day_rsi > 75 AS exit FROM s")
def s01_s05_multi_tf(spark, sf_dir):
    """Smoothed RSI and cycle on hourly bars, daily RSI aligned to them, both combined."""
    hour, day = B.intraday_bars(spark, sf_dir, "hourly").drop("tf"), B.intraday_bars(spark, sf_dir, "daily").drop("tf")
    h = signals.smooth(signals.expanding_rsi(hour, 10, "rsi0", S), "rsi0", 3, "rsi", S)
    from ..functions.exprs import over

    i = F.row_number().over(over("symbol")) - 1
    h = h.withColumn("cycle", signals.cycle(i, F.lit(7), F.lit(3), F.lit(3)))
    x = signals.align(h, signals.expanding_rsi(day, 5, "v", S), "day", "v", "day_rsi")
    by_tf = F.array(
        F.struct(((F.col("rsi") < 45) & F.col("cycle")).alias("entry"), ((F.col("rsi") > 55) | ~F.col("cycle")).alias("exit")),
        F.struct((F.col("day_rsi") < 60).alias("entry"), (F.col("day_rsi") > 75).alias("exit")),
    )
    long = x.select("symbol", "ts", "rsi", "cycle", "day_rsi", F.explode(by_tf).alias("s")).select("symbol", "ts", "rsi", "cycle", "day_rsi", "s.*")
    return rounded(signals.combine(long, ["symbol", "rsi", "cycle", "day_rsi"]).select("symbol", "ts", "rsi", "cycle", "day_rsi", "entry", "exit"))


@query(RSI_RULE + f""", o2 AS (SELECT *, CASE WHEN opened THEN 1 WHEN closed THEN -1 END AS side, lead(open, 2) {W} AS px FROM o),
fl AS (SELECT *, px * (1 + side * 0.0007) AS fill FROM o2),
fw AS (SELECT *, lag(-side * 100 * fill - 1.0, 2) {W} AS flow, lag(CASE WHEN fill IS NOT NULL THEN side * 100 END, 2) {W} AS q FROM fl),
c AS (SELECT symbol, ts, close, 100000.0 + sum(coalesce(flow, 0)) OVER r AS cash, sum(coalesce(q, 0)) OVER r AS qty FROM fw WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT symbol, ts, round(cash, 4) AS cash, CAST(qty AS BIGINT) AS qty, round(cash + qty * close, 4) AS equity FROM c""")
def s11_order_backtest(spark, sf_dir):
    return rounded(signals.rule_orders(signals.rsi_rule(B.daily_bars(spark, sf_dir)), S), 4)


@query(DAILY + f""", x AS (SELECT *, CASE WHEN day(ts) % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, lag(close) {W} * CASE WHEN day(ts) % 2 = 0 THEN 0.99 ELSE 1.01 END AS lim FROM bars)
SELECT symbol, ts, side, round(CASE WHEN side = 'buy' AND low <= lim THEN least(lim, open) WHEN side = 'sell' AND high >= lim THEN greatest(lim, open) END, 9) AS price FROM x""")
def s12_limit_fills(spark, sf_dir):
    from ..functions.exprs import over

    even = F.day("ts") % 2 == 0
    x = B.daily_bars(spark, sf_dir).withColumns({"side": F.when(even, "buy").otherwise("sell"), "lim": F.lag("close").over(over("symbol")) * F.when(even, 0.99).otherwise(1.01)})
    return rounded(x.select("symbol", "ts", "side", signals.limit_fill(F.col("side"), F.col("lim"), F.col("open"), F.col("high"), F.col("low")).alias("price")), 9)


@query(RSI_RULE + """, a AS (SELECT symbol, count(*) AS n, arg_min(equity, ts) AS a, arg_max(equity, ts) AS b, stddev_samp(ret) * sqrt(252) AS vol, min(drawdown) AS dd, avg(ret) AS m, stddev_samp(ret) AS sd FROM er GROUP BY symbol),
tr AS (SELECT symbol, count(*) AS n_trades, avg((f > 1)::INT::DOUBLE) AS win_rate, avg(100 * (f - 1)) AS avg_pct FROM filled WHERE ends GROUP BY symbol)
SELECT symbol, round(b / a - 1, 4) AS total_return, round(pow(b / a, 252.0 / n) - 1, 4) AS annual_return, round(vol, 4) AS volatility, round(CASE WHEN vol > 0 THEN (pow(b / a, 252.0 / n) - 1) / vol ELSE 0 END, 4) AS engine_sharpe,
  round(dd, 4) AS max_drawdown, round(CASE WHEN sd > 0 THEN least(greatest(m / sd * sqrt(252), -5), 10) ELSE 0 END, 4) AS sharpe, n_trades, round(win_rate, 4) AS win_rate, round(avg_pct, 4) AS avg_pct
FROM a JOIN tr USING (symbol)""")
def m02_m03_engine(spark, sf_dir):
    f = rule(spark, sf_dir)
    e = signals.equity(f, S)
    x = metrics.engine_metrics(e, S).withColumnRenamed("sharpe", "engine_sharpe").join(metrics.sharpe(e, S), "symbol").join(metrics.trade_metrics(signals.trades(f, S), S), "symbol")
    return rounded(x.select("symbol", "total_return", "annual_return", "volatility", "engine_sharpe", "max_drawdown", "sharpe", "n_trades", "win_rate", "avg_pct"), 4)


def _cdf(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * (abs({z}) / sqrt(2.0))))"
    return f"(0.5 * (1.0 + sign({z}) * (1.0 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-(abs({z}) / sqrt(2.0)) * (abs({z}) / sqrt(2.0))))))"


M4 = RSI_RULE + f""", mo AS (SELECT symbol, count(ret)::DOUBLE AS n, avg(ret) AS m, stddev_samp(ret) AS sd, skewness(ret) AS sk, kurtosis(ret) AS ku FROM er GROUP BY symbol),
tr AS (SELECT symbol, count(*) AS t FROM filled WHERE ends GROUP BY symbol),
p0 AS (SELECT *, m / CASE WHEN sd >= 1e-12 THEN sd END AS s, least(greatest(sk, -10), 10) AS sk1, least(greatest(ku, -10), 50) AS ku1, CASE WHEN t < n / 10 THEN greatest(t::DOUBLE, 10.0) ELSE n END AS eff FROM mo JOIN tr USING (symbol)),
p1 AS (SELECT *, least(greatest(s * sqrt(252), -10), 10) AS obs, (1 - sk1 * s + (ku1 - 1) / 4 * s * s) / greatest(eff - 1, 1) * 252 AS v, (1 + least(5, abs(sk1)) * 0.3) * (1 + least(10, abs(ku1)) * 0.15) * sqrt(252) / sqrt(greatest(eff - 1, 1)) AS fb FROM p0),
p2 AS (SELECT *, CASE WHEN v > 0 THEN sqrt(v) ELSE fb END AS se, CASE WHEN eff < 30 THEN 2.0 WHEN eff < 100 THEN 2.5 ELSE 3.0 END AS bd FROM p1),
p3 AS (SELECT *, least(greatest(obs / CASE WHEN se < 1e-10 THEN 0.2 ELSE se END, -bd), bd) AS z FROM p2),
p4 AS (SELECT *, CASE WHEN n < 30 OR sd IS NULL THEN 0.5 WHEN sd < 1e-12 THEN CASE WHEN m > 0 THEN 0.95 ELSE 0.05 END ELSE least(greatest({_cdf('z')}, 0.001), 0.999) END AS psr FROM p3),
hv AS (SELECT symbol, ret, row_number() {W} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM er WHERE ret IS NOT NULL),
h2 AS (SELECT symbol, count(*) AS n, avg(ret) FILTER (i <= n // 2) / (stddev_samp(ret) FILTER (i <= n // 2) + 1e-10) AS s1, avg(ret) FILTER (i > n // 2) / (stddev_samp(ret) FILTER (i > n // 2) + 1e-10) AS s2 FROM hv GROUP BY symbol),
pb AS (SELECT symbol, s1, s2, CASE WHEN n < 20 THEN 0.5 WHEN s1 <= 0 AND s2 <= 0 THEN 0.9 WHEN s1 > 1 AND s2 < 0 THEN 0.8 WHEN s1 > 3 * s2 THEN 0.7 WHEN s1 > 1.5 * s2 THEN 0.5 WHEN s2 > s1 THEN 0.2 WHEN abs(s1 - s2) < 0.2 THEN 0.3 ELSE 0.4 END AS pbo FROM h2),
dd AS (SELECT symbol, min(drawdown) AS dd FROM er GROUP BY symbol),
sc AS (SELECT symbol, n, obs AS sharpe, psr, pbo, t, dd, t * 2 * 252 / n AS turn, CASE WHEN t < 10 THEN 0.0 WHEN t >= 30 THEN 1.0 ELSE (t - 10) / 20.0 END AS mult FROM p4 JOIN pb USING (symbol) JOIN dd USING (symbol))"""


def scored(spark, sf_dir) -> DataFrame:
    f = rule(spark, sf_dir)
    e = metrics.equity_returns(signals.equity(f, S), S)
    t = signals.trades(f, S).groupBy("symbol").agg(F.count(F.lit(1)).alias("t"))
    p = metrics.probabilistic_sharpe(metrics.moments(e, S).join(t, "symbol"), S, trades="t")
    x = p.join(metrics.overfit(e, S).select("symbol", "pbo"), "symbol").join(e.groupBy("symbol").agg(F.min("drawdown").alias("dd")), "symbol")
    return x.withColumns({"turn": metrics.turnover(F.col("t"), F.col("n")), "mult": metrics.trade_multiplier(F.col("t"), "rsi")})


@query(M4 + """ SELECT symbol, CAST(n AS BIGINT) AS n, t AS n_trades, round(sharpe, 5) AS sharpe, round(psr, 5) AS psr, round(psr * mult, 5) AS psr_weighted, pbo, round(turn, 5) AS turnover, round(dd, 5) AS max_drawdown,
  round(least(greatest(0.70 * psr - 0.20 * pbo - 0.05 * CASE WHEN turn < 200 THEN 0 ELSE least((turn - 200) / 200, 1) END - 0.05 * least(abs(dd) / 0.5, 1) - 0.3 * CASE WHEN t < 20 THEN 1 - t / 20.0 ELSE 0 END, -1), 1), 5) AS score FROM sc""")
def m04_m08_scores(spark, sf_dir):
    """M4-M8: probabilistic Sharpe, trade weight, overfit score, turnover, composite."""
    x = scored(spark, sf_dir)
    score = metrics.composite(F.col("psr"), F.col("pbo"), F.col("turn"), F.col("dd"), F.col("t"))
    return rounded(x.select("symbol", "n", F.col("t").alias("n_trades"), "sharpe", "psr", (F.col("psr") * F.col("mult")).alias("psr_weighted"), "pbo", F.col("turn").alias("turnover"), F.col("dd").alias("max_drawdown"), score.alias("score")), 5)


@query(RSI_RULE + """, a AS (SELECT symbol, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0) AS sharpe, coalesce(avg(ret) / nullif(stddev_samp(ret) FILTER (ret < -1e-9), 0) * sqrt(252), 0) AS sortino,
  min(drawdown) AS max_drawdown, stddev_samp(ret) * sqrt(252) AS volatility FROM er GROUP BY symbol),
tb AS (SELECT symbol, avg((equity_after > equity_after / f)::INT::DOUBLE) AS win_rate, count(*)::DOUBLE AS num_trades, ln(1 + abs(avg(equity_after - equity_after / f))) * sign(avg(equity_after - equity_after / f)) AS avg_trade_pnl FROM filled WHERE ends GROUP BY symbol), ab AS (SELECT * FROM a LEFT JOIN tb USING (symbol))
SELECT symbol, name, round(value, 4) AS value FROM (UNPIVOT ab ON total_return, sharpe, sortino, max_drawdown, volatility, win_rate, num_trades, avg_trade_pnl INTO NAME name VALUE value)""")
def m09_monitoring(spark, sf_dir):
    """M9; the mean result of a trade as a signed logarithm, ln(1 + x), as money grows beyond any sense here."""
    f = rule(spark, sf_dir)
    m = metrics.monitoring(signals.equity(f, S), S, signals.trades(f, S)).filter(F.col("value").isNotNull())
    v = F.when(F.col("name") == "avg_trade_pnl", F.signum("value") * F.log1p(F.abs("value"))).otherwise(F.col("value"))
    return rounded(m.withColumn("value", v), 4)


@query(RSI_RULE + """, a AS (SELECT symbol, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, min(drawdown) AS max_drawdown, ln(arg_max(equity, ts) / arg_min(equity, ts)) AS growth FROM er GROUP BY symbol)
SELECT symbol, round(sharpe, 4) AS sharpe, round(max_drawdown, 5) AS max_drawdown, sharpe >= 1 AS deployed, round(greatest(10000.0, 5000 / greatest(abs(max_drawdown), 0.01)), 4) AS position_limit, CAST(rank() OVER (ORDER BY round(sharpe, 6) DESC) AS INT) AS rank, count(*) FILTER (sharpe >= 1) OVER () AS n_deployed, round(avg(sharpe) OVER (), 5) AS mean_sharpe, round(max(sharpe) OVER (), 4) AS best_sharpe FROM a""")
def m10_deploy(spark, sf_dir):
    """Summary of all symbols, which are deployed (Sharpe of 1 or more), and their limits."""
    m = metrics.monitoring(signals.equity(rule(spark, sf_dir), S), S).groupBy("symbol").pivot("name", ["sharpe", "max_drawdown"]).agg(F.first("value"))
    return rounded(metrics.daily_summary(m), 4, max_drawdown=5, mean_sharpe=5)


@query(DAILY + """, d AS (SELECT symbol, abs(close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1) AS d FROM bars)
SELECT symbol, CASE WHEN d < 0.05 THEN 1 WHEN d < 0.15 THEN 2 WHEN d < 0.30 THEN 3 WHEN d < 0.50 THEN 4 ELSE 5 END AS zone, count(*) AS n FROM d GROUP BY ALL""")
def m11_zones(spark, sf_dir):
    e = metrics.equity_returns(B.daily_bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("equity")), S)
    return e.groupBy("symbol", metrics.zone(F.col("drawdown")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query(RSI_RULE + f""", i AS (SELECT *, row_number() {W} AS i, drawdown < -0.01 AS u FROM er), j AS (SELECT *, u AND NOT coalesce(lag(u) {W}, false) AS st FROM i),
k AS (SELECT *, CAST(sum(st::INT) OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS episode FROM j),
e AS (SELECT symbol, episode, min(ts) AS start_ts, min(drawdown) AS depth, first(i ORDER BY drawdown, i) AS tr, max(i) AS e, count(*) AS length FROM k WHERE u GROUP BY symbol, episode)
SELECT symbol, episode, start_ts, round(depth, 5) AS depth, length, e + 1 - tr AS recovery FROM e""")
def m12_episodes(spark, sf_dir):
    return rounded(metrics.episodes(signals.equity(rule(spark, sf_dir), S), S), 5)

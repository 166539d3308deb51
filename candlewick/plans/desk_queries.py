"""Queries on costs, orders, risk, monitoring and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import div, over
from ..operators import execution as X
from ..operators import monitor as M
from ..sources import bars as B
from .market import rounded
from .registry import DAILY, W, draw_sql, query, roll

TRADES = "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS size, l_extendedprice / l_quantity AS price, l_discount AS sigma, 1000.0 + l_partkey % 500 AS adv, 1.0 + l_linenumber AS minutes, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side FROM lineitem)"


def trades(spark, sf_dir):
    t = B.table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("size"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_discount").alias("sigma"), (1000.0 + F.col("l_partkey") % 500).alias("adv"), (1.0 + F.col("l_linenumber")).alias("minutes"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"))


@query(TRADES + """, i AS (SELECT *, 0.1 * sigma * pow(size / adv, 0.6) AS p, 0.01 * sigma * pow(size / adv, 0.6) / sqrt(minutes) AS tp FROM t), c AS (SELECT *, p + tp + 0.00025 + 0.0001 AS tot FROM i)
SELECT side, l_linenumber, count(*) AS n, round(avg(p) * 10000, 6) AS permanent_bps, round(avg(tp) * 10000, 6) AS temporary_bps, round(avg(tot * 10000), 6) AS total_bps, round(sum(size * price * tot), 3) AS cost FROM c GROUP BY ALL""")
def x01_x02_costs(spark, sf_dir):
    c = X.cost_breakdown(trades(spark, sf_dir))
    a = c.groupBy("side", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), (F.avg("permanent") * 10000).alias("permanent_bps"), (F.avg("temporary") * 10000).alias("temporary_bps"), F.avg("total_bps").alias("total_bps"), F.sum("cost").alias("cost"))
    return rounded(a, 6, cost=3)


ORDERS = """WITH po AS (SELECT o_orderkey AS parent_id, 'Brand#' || (1 + o_custkey % 5) AS brand, ['click', 'view', 'purchase', 'signup', 'refund'][1 + CAST(o_custkey % 5 AS INT)] AS sy, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, floor(o_totalprice / 100) AS qty,
  ['market', 'twap', 'vwap', 'pov', 'smart'][1 + CAST(o_orderkey % 5 AS INT)] AS algo, TIMESTAMP '2024-01-02 09:00:00' + INTERVAL 1 DAY * (o_orderkey % 20) AS start_ts, TIMESTAMP '2024-01-02 09:00:00' + INTERVAL 1 DAY * (o_orderkey % 20) + INTERVAL 1 MINUTE * (20 + 10 * (o_orderkey % 7)) AS end_ts,
  (o_orderkey % 10) / 10.0 AS urgency, 200.0 + o_orderkey % 100 AS limit_price FROM orders),
sym AS (SELECT event_type AS symbol, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)),
o AS (SELECT parent_id, symbol, side, qty, algo, start_ts, end_ts, urgency, limit_price, date_diff('minute', start_ts, end_ts) AS span FROM po JOIN orders ON o_orderkey = parent_id JOIN sym ON k = o_custkey % 5)"""


def parents(spark, sf_dir):
    """Parent orders from the order table on the tick symbols."""
    from pyspark.sql import Window

    o = B.table(spark, sf_dir, "orders")
    sym = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("symbol")) - 1)
    k = F.col("o_orderkey")
    start = F.lit("2024-01-02 09:00:00").cast("timestamp")
    x = o.join(F.broadcast(sym.filter("k < 5")), F.col("o_custkey") % 5 == F.col("k"))  # five symbols; by key five tasks would hold all orders
    secs = F.unix_timestamp(start) + (k % 20) * 86400
    return x.select(
        k.alias("parent_id"), "symbol", F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("qty"), F.element_at(F.array(*map(F.lit, ("market", "twap", "vwap", "pov", "smart"))), (k % 5).cast("int") + 1).alias("algo"),
        F.timestamp_seconds(secs).alias("start_ts"), F.timestamp_seconds(secs + (20 + 10 * (k % 7)) * 60).alias("end_ts"), ((k % 10) / 10.0).alias("urgency"), (200.0 + k % 100).alias("limit_price"),
    )


CHILD = ORDERS + """, vol AS (SELECT event_type AS symbol, to_timestamp((epoch_us(ts) // 300000000) * 300)::TIMESTAMP AS ts, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL),
tw AS (SELECT *, greatest(span // 5, 1) AS n FROM o WHERE algo IN ('twap', 'smart')),
tc AS (SELECT parent_id, symbol, side, algo, urgency, limit_price AS lp, CAST(k AS INT) AS slice, start_ts + INTERVAL 5 MINUTE * k AS ts, qty / n AS qty, CASE WHEN urgency < 0.7 THEN 'limit' ELSE 'market' END AS ot, CASE WHEN urgency < 0.7 THEN limit_price * CASE WHEN side = 'buy' THEN 0.9999 ELSE 1.0001 END END AS lim FROM tw, LATERAL (SELECT unnest(range(n)) AS k)),
sw AS (SELECT parent_id, symbol, side, CAST(k AS INT) AS slice, start_ts + INTERVAL 1 MINUTE * (k * CASE WHEN algo = 'vwap' THEN 15 ELSE 5 END) AS ts, qty AS total, algo, urgency, limit_price FROM (SELECT *, CAST(greatest(ceil(span / CASE WHEN algo = 'vwap' THEN 15.0 ELSE 5.0 END), 1) AS BIGINT) AS n FROM o WHERE algo IN ('vwap', 'pov')), LATERAL (SELECT unnest(range(n)) AS k)),
sv AS (SELECT sw.*, CASE WHEN algo = 'vwap' THEN total * CASE hour(sw.ts) WHEN 9 THEN 0.15 WHEN 10 THEN 0.12 WHEN 11 THEN 0.08 WHEN 12 THEN 0.06 WHEN 13 THEN 0.07 WHEN 14 THEN 0.09 WHEN 15 THEN 0.13 WHEN 16 THEN 0.30 ELSE 0.08 END * 15 / 60 ELSE least(coalesce(v, 10000.0) * 0.1, coalesce(v, 10000.0) * 0.3) END AS want FROM sw LEFT JOIN vol ON sw.symbol = vol.symbol AND sw.ts = vol.ts),
sc AS (SELECT *, greatest(0, least(want, total - coalesce(sum(want) OVER (PARTITION BY parent_id ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS q FROM sv),
ch AS (SELECT parent_id, symbol, side, 0 AS slice, start_ts AS ts, qty, 'market' AS order_type, NULL::DOUBLE AS limit_price FROM o WHERE algo = 'market'
  UNION ALL SELECT parent_id, symbol, side, slice, ts, qty, CASE WHEN algo = 'smart' AND urgency > 0.8 THEN 'market' WHEN algo = 'smart' AND urgency < 0.3 THEN 'limit' ELSE ot END, CASE WHEN algo = 'smart' AND urgency > 0.8 THEN NULL WHEN algo = 'smart' AND urgency < 0.3 THEN lp * CASE WHEN side = 'buy' THEN 0.999 ELSE 1.001 END ELSE lim END FROM tc
  UNION ALL SELECT parent_id, symbol, side, slice, ts, q, CASE WHEN algo = 'pov' OR urgency < 0.7 THEN 'limit' ELSE 'market' END, limit_price FROM sc WHERE q > 0)"""


def volumes(spark, sf_dir):
    return B.intraday_bars(spark, sf_dir, "5min").select("symbol", "ts", "volume")


@query(CHILD + " SELECT parent_id, slice, symbol, side, ts, round(qty, 6) AS qty, order_type, round(limit_price, 6) AS limit_price FROM ch")
def x08_x11_child_orders(spark, sf_dir):
    """TWAP, VWAP, POV, market and smart routing."""
    return rounded(X.route(parents(spark, sf_dir), volumes(spark, sf_dir)).select("parent_id", "slice", "symbol", "side", "ts", "qty", "order_type", "limit_price"))


@query(CHILD + """, hb AS (SELECT symbol, ts, open, high, low, close FROM (SELECT event_type AS symbol, date_trunc('hour', e.ts) AS ts, first(value ORDER BY e.ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY e.ts, event_id) AS close FROM events e GROUP BY 1, 2)),
la AS (SELECT symbol, max(ts) AS mt FROM hb GROUP BY symbol), fi AS (SELECT symbol, first(close ORDER BY ts) AS fc FROM hb GROUP BY symbol),
ma AS (SELECT ch.*, coalesce((SELECT min(hb.ts) FROM hb WHERE hb.symbol = ch.symbol AND hb.ts >= ch.ts), mt) AS bt FROM ch JOIN la USING (symbol)),
fl AS (SELECT ma.*, CASE WHEN order_type = 'market' THEN hb.close * CASE WHEN side = 'buy' THEN 1.00025 ELSE 0.99975 END WHEN LUCK AND side = 'buy' AND hb.low <= limit_price THEN least(limit_price, hb.open) WHEN LUCK AND side = 'sell' AND hb.high >= limit_price THEN greatest(limit_price, hb.open) END AS px FROM ma JOIN hb ON ma.symbol = hb.symbol AND bt = hb.ts),
a AS (SELECT parent_id, symbol, side, sum(qty) FILTER (px IS NOT NULL) AS filled, sum(qty * px) AS v, sum(qty) AS q FROM fl GROUP BY ALL)
SELECT parent_id, symbol, round(coalesce(filled, 0), 6) AS filled, round(v / filled, 9) AS avg_price, round(coalesce(filled / nullif(q, 0), 0), 6) AS fill_rate, round(10000 * CASE WHEN side = 'buy' THEN (v / filled - fc) / fc ELSE (fc - v / filled) / fc END, 4) AS slippage_bps FROM a JOIN fi USING (symbol)""".replace("LUCK", draw_sql(7, "slice", "parent_id") + " % 10000 < 9500"))
def x12_x13_fills(spark, sf_dir):
    """First bar at or after each child order, fills (19 of 20 touched limits fill), statistics by parent."""
    bars = B.intraday_bars(spark, sf_dir, "hourly")
    kids = X.route(parents(spark, sf_dir), volumes(spark, sf_dir))
    f = X.fill(X.next_bar(kids, bars))
    return rounded(X.fill_stats(f, bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("first_close"))), slippage_bps=4, avg_price=9)


@query(ORDERS + " SELECT parent_id, CAST(k AS INT) AS slice, round(qty * (1 - k / 6.0), 6) AS remaining FROM o, range(7) AS r(k)")
def x03_schedule(spark, sf_dir):
    return rounded(X.schedule(parents(spark, sf_dir).withColumn("n", F.lit(6))).select("parent_id", "slice", "remaining"))


@query(TRADES + " SELECT side, l_linenumber, round(avg(2 + 10 * sqrt(size / adv) + 100 * sigma + 2.5), 6) AS expected_bps, round(avg(10000 * CASE WHEN side = 'buy' THEN (price * 1.001 - price) / price ELSE (price - price * 1.001) / price END), 6) AS realised_bps FROM t GROUP BY ALL")
def x04_x05_slippage(spark, sf_dir):
    t = trades(spark, sf_dir)
    a = t.groupBy("side", "l_linenumber").agg(F.avg(X.expected_slippage(F.col("size"), F.col("adv"), F.col("sigma"), F.lit(5.0))).alias("expected_bps"), F.avg(X.realised_slippage(F.col("side"), F.col("price") * 1.001, F.col("price"))).alias("realised_bps"))
    return rounded(a)


CAP = DAILY + f", r AS (SELECT *, close / lag(close) {W} - 1 AS ret FROM bars), c AS (SELECT symbol, avg(volume) * 1000 AS adv, least(stddev_samp(ret), 0.05) AS sigma, 0.5 + 0.1 * (ascii(right(symbol, 1)) - 48) AS turnover FROM r GROUP BY symbol)"


def capacities(spark, sf_dir):
    x = B.daily_bars(spark, sf_dir).withColumn("ret", div(F.col("close"), F.lag("close").over(over("symbol"))) - 1)
    return x.groupBy("symbol").agg((F.avg("volume") * 1000).alias("adv"), F.least(F.stddev_samp("ret"), F.lit(0.05)).alias("sigma")).withColumn("turnover", 0.5 + 0.1 * (F.ascii(F.right("symbol", F.lit(1))) - 48))


@query(CAP + ", p AS (SELECT *, CASE WHEN 0.001 / turnover - 0.00035 > 0 THEN pow((0.001 / turnover - 0.00035) / (0.11 * sigma), 1 / 0.6) END AS part FROM c) SELECT symbol, round(greatest(coalesce(part * adv * 252 / turnover, 1000.0), 1000.0), 3) AS aum, round(greatest(coalesce(part * adv * 252 / turnover, 1000.0), 1000.0) * 100, 1) AS breakeven, round(part, 6) AS participation FROM p")
def x06_capacity(spark, sf_dir):
    c = capacities(spark, sf_dir)
    a, b, p = X.capacity(F.col("turnover"), F.col("adv"), F.col("sigma"))
    return rounded(c.select("symbol", a.alias("aum"), b.alias("breakeven"), p.alias("participation")), 3, breakeven=1, participation=6)


@query(CAP + ", a AS (SELECT *, unnest([1e4, 1e5, 1e6, 1e7]) AS aum FROM c), k AS (SELECT *, (0.11 * sigma * pow(aum * turnover / 252 / adv, 0.6) + 0.00035) * turnover AS cost FROM a) SELECT symbol, aum, round(cost, 7) AS annual_cost, round(0.1 - cost, 7) AS net_return, round(cost / 0.1, 7) AS cost_share, round(aum * turnover / 252 / adv, 7) AS participation FROM k")
def x07_capacity_curve(spark, sf_dir):
    c = X.capacity_curve(capacities(spark, sf_dir), [1e4, 1e5, 1e6, 1e7])
    return rounded(c.select("symbol", "aum", "annual_cost", "net_return", "cost_share", "participation"), 7)


@query(ORDERS + f""", ps AS (SELECT *, coalesce(sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER (PARTITION BY symbol, parent_id // 64 ORDER BY parent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM o),
ad AS (SELECT event_type AS symbol, count(*) / 3.0 AS adv, avg(value) AS price FROM events GROUP BY ALL),
a AS (SELECT ps.*, adv, price, pos + CASE WHEN side = 'buy' THEN qty ELSE -qty END AS post FROM ps JOIN ad USING (symbol))
SELECT CASE WHEN qty > 3000 THEN 'order_size' WHEN abs(post) > 4000 THEN 'position_size' WHEN abs(post) * price / 1e7 > 0.10 THEN 'concentration' WHEN qty / adv > 0.25 THEN 'adv_share' END AS reason, side, count(*) AS n FROM a GROUP BY ALL""")
def x14_pre_trade(spark, sf_dir):
    """Every order against the position that all earlier orders of its desk (64 order numbers) have built in its symbol."""
    from pyspark.sql import Window

    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    w = Window.partitionBy("symbol", "desk").orderBy("parent_id").rowsBetween(Window.unboundedPreceding, -1)
    o = parents(spark, sf_dir).withColumn("desk", F.floor(F.col("parent_id") / 64)).withColumn("position", F.coalesce(F.sum(signed).over(w), F.lit(0.0)))
    adv = B.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg((F.count(F.lit(1)) / 3.0).alias("adv"), F.avg("value").alias("price"))
    x = o.join(adv, "symbol").withColumn("portfolio_value", F.lit(1e7))
    return X.pre_trade(x, 3000, 4000).groupBy("reason", "side").agg(F.count(F.lit(1)).alias("n"))


POS = """WITH pos AS (SELECT 'P' || (c_nationkey % 7) AS portfolio, 'Brand#' || (11 + c_custkey % 5) AS symbol, sum(round(c_acctbal / 100)) AS qty FROM customer GROUP BY ALL),
tick AS (SELECT p_brand AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS qty, l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS d, l_extendedprice AS e FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (SELECT symbol, ts, last(price ORDER BY a, b, c, d, e, qty) AS close FROM tick GROUP BY symbol, ts),
re AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars), pr AS (SELECT symbol, last(close ORDER BY ts) AS price FROM bars GROUP BY symbol),
we AS (SELECT portfolio, symbol, qty / sum(abs(qty)) OVER (PARTITION BY portfolio) AS weight FROM pos)"""


def book(spark, sf_dir):
    """(positions, last prices, returns, weights) of seven portfolios on five brands."""
    from pyspark.sql import Window

    c = B.table(spark, sf_dir, "customer")
    pos = c.groupBy(F.concat(F.lit("P"), F.col("c_nationkey") % 7).alias("portfolio"), F.concat(F.lit("Brand#"), 11 + F.col("c_custkey") % 5).alias("symbol")).agg(F.sum(F.round(F.col("c_acctbal") / 100)).alias("qty"))
    b = B.daily_bars(spark, sf_dir).select("symbol", "ts", "close")
    ret = b.select("symbol", "ts", (div(F.col("close"), F.lag("close").over(over("symbol"))) - 1).alias("ret"))
    w = pos.select("portfolio", "symbol", (F.col("qty") / F.sum(F.abs("qty")).over(Window.partitionBy("portfolio"))).alias("weight"))
    return pos, b.groupBy("symbol").agg(F.max_by("close", "ts").alias("price")), ret, w


@query(POS + """, v AS (SELECT portfolio, qty, qty * coalesce(price, 0) AS v FROM pos LEFT JOIN pr USING (symbol)), a AS (SELECT portfolio, coalesce(sum(v) FILTER (v > 0), 0) AS long, coalesce(-sum(v) FILTER (v < 0), 0) AS short, count(*) FILTER (qty <> 0) AS n_positions, max(abs(v)) AS largest FROM v GROUP BY portfolio),
e AS (SELECT *, long + short AS gross, long - short AS net, (long + short) / 2e7 AS leverage FROM a), r AS (SELECT *, greatest(CASE WHEN gross > 1e7 THEN 3 WHEN gross > 9e6 THEN 1 ELSE 0 END, CASE WHEN abs(net) > 5e6 THEN 2 ELSE 0 END, CASE WHEN leverage > 1 THEN 3 ELSE 0 END, CASE WHEN largest > 3e6 THEN 2 ELSE 0 END) AS rank FROM e)
SELECT portfolio, round(long, 2) AS long, round(short, 2) AS short, round(gross, 2) AS gross, round(net, 2) AS net, n_positions, round(leverage, 6) AS leverage, rank, ['green', 'yellow', 'orange', 'red'][rank + 1] AS level FROM r""")
def x15_x16_limits(spark, sf_dir):
    pos, px, _, _ = book(spark, sf_dir)
    value = pos.select("portfolio").distinct().withColumn("value", F.lit(2e7))
    x = X.limit_level(X.exposures(pos, px, value), 1e7, 5e6, 3e6, 1.0)
    return rounded(x.select("portfolio", "long", "short", "gross", "net", "n_positions", "leverage", "rank", "level"), 2, leverage=6)


@query("""WITH e AS (SELECT 'P' || (user_id % 5) AS portfolio, ts, event_id, 100000 + sum(value - 250) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS equity FROM events),
o AS (SELECT portfolio, ts, last(equity ORDER BY event_id) AS equity FROM e GROUP BY ALL),
x AS (SELECT *, max(equity) OVER r AS peak, first_value(equity) OVER (PARTITION BY portfolio, ts::DATE ORDER BY ts) AS st FROM o WINDOW r AS (PARTITION BY portfolio ORDER BY ts ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, equity - st AS pnl, (equity - peak) / nullif(peak, 0) AS dd FROM x), z AS (SELECT *, greatest(CASE WHEN pnl < -2000 THEN 3 WHEN pnl < -1600 THEN 1 ELSE 0 END, CASE WHEN dd < -0.1 THEN 3 ELSE 0 END, CASE WHEN dd < -0.05 THEN 2 ELSE 0 END) AS rank FROM y),
k AS (SELECT *, max((rank = 3)::INT) OVER (PARTITION BY portfolio ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 AS killed FROM z)
SELECT portfolio, rank, ['green', 'yellow', 'orange', 'red'][rank + 1] AS level, pnl > 3000 AS target_hit, killed, count(*) AS n, round(min(dd), 6) AS worst FROM k GROUP BY ALL""")
def x17_x18_pnl_limits(spark, sf_dir):
    from pyspark.sql import Window

    e = B.table(spark, sf_dir, "events").select(F.concat(F.lit("P"), F.col("user_id") % 5).alias("portfolio"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    w = Window.partitionBy("portfolio").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("equity", 100000 + F.sum(F.col("value") - 250).over(w)).groupBy("portfolio", "ts").agg(F.max_by("equity", "event_id").alias("equity"))
    x = X.pnl_levels(e, -2000, -0.10, -0.05, 3000)
    return rounded(x.groupBy("portfolio", "rank", "level", "target_hit", "killed").agg(F.count(F.lit(1)).alias("n"), F.min("drawdown").alias("worst")))


@query(POS + ", s AS (SELECT portfolio, ts, sum(weight * ret) AS r FROM re JOIN we USING (symbol) WHERE ret IS NOT NULL GROUP BY ALL) SELECT portfolio, round(quantile_cont(r, 0.05), 6) AS var FROM s GROUP BY portfolio")
def x19_historical_var(spark, sf_dir):
    _, _, ret, w = book(spark, sf_dir)
    return rounded(X.historical_var(ret.filter("ret IS NOT NULL"), w))


@query(POS + ", cv AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.ret, b.ret) AS cov FROM re a JOIN re b USING (ts) GROUP BY ALL) SELECT x.portfolio, round(-2.3263478740 * sqrt(sum(x.weight * y.weight * cov)), 6) AS var FROM cv JOIN we x ON cv.a = x.symbol JOIN we y ON cv.b = y.symbol AND x.portfolio = y.portfolio GROUP BY x.portfolio")
def x20_parametric_var(spark, sf_dir):
    _, _, ret, w = book(spark, sf_dir)
    held = ret.join(w.select("symbol").distinct(), "symbol", "left_semi")
    return rounded(X.parametric_var(held, w, 0.99))


@query(POS + ", sc AS (SELECT s.scenario, symbol, s.k * (1 + (ascii(right(symbol, 1)) - 48) / 10.0) AS ch FROM (SELECT DISTINCT symbol FROM bars), (VALUES ('crash', -0.2), ('rally', 0.1), ('drift', -0.02)) AS s(scenario, k)) SELECT portfolio, scenario, round(sum(qty * price * ch), 3) AS pnl FROM pos JOIN pr USING (symbol) JOIN sc USING (symbol) GROUP BY ALL")
def x21_stress(spark, sf_dir):
    pos, px, _, _ = book(spark, sf_dir)
    k = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(v).alias("k")) for n, v in (("crash", -0.2), ("rally", 0.1), ("drift", -0.02))))).alias("s")
    sc = px.select("symbol", k).select("symbol", "s.scenario", (F.col("s.k") * (1 + (F.ascii(F.right("symbol", F.lit(1))) - 48) / 10.0)).alias("change_pct"))
    return rounded(X.stress(pos, px, sc), 3)


@query(POS + " SELECT symbol, round(CASE WHEN symbol LIKE '%1' THEN 10000.0 * 0.25 ELSE floor(10000.0 * 0.25 / price) END, 6) AS size FROM pr")
def x22_order_size(spark, sf_dir):
    _, px, _, _ = book(spark, sf_dir)
    return rounded(px.select("symbol", X.order_size(F.lit(10000.0), F.lit(0.25), F.col("price"), F.col("symbol").endswith("1")).alias("size")))


def metric_rows(spark, sf_dir):
    """Metrics from the event table: name by type, tags by user group."""
    e = B.table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), "value", F.create_map(F.lit("grp"), (F.col("user_id") % 3).cast("string")).alias("tags"))


@query("SELECT event_type AS name, CAST(user_id % 3 AS VARCHAR) AS grp, count(*) AS n, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY ALL")
def k01_latest(spark, sf_dir):
    m = metric_rows(spark, sf_dir).withColumns({"grp": F.col("tags")["grp"], "ts": F.struct("ts", "event_id")})
    n = m.groupBy("name", "grp").agg(F.count(F.lit(1)).alias("n"))
    return M.latest(m, ["name", "grp"]).select("name", "grp", "value").join(n, ["name", "grp"])


@query("WITH l AS (SELECT event_type AS name, CAST(user_id % 3 AS VARCHAR) AS grp, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY ALL) SELECT name || '{grp=\"' || grp || '\"} ' || value AS value FROM l")
def a15_prometheus(spark, sf_dir):
    m = metric_rows(spark, sf_dir).withColumns({"grp": F.col("tags")["grp"], "ts": F.struct("ts", "event_id")})
    return M.prometheus(M.latest(m, ["name", "grp"]).withColumn("tags", F.create_map(F.lit("grp"), F.col("grp"))))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def a17_log_search(spark, sf_dir):
    """JSON records parsed with a schema, filtered and counted."""
    k = F.get_json_object("props", "$.k").cast("long")
    return B.table(spark, sf_dir, "events").withColumn("k", k).groupBy("event_type", (F.col("k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


SAMPLES = "WITH x AS (SELECT label AS key, vec_id % 2 AS sample, round(embedding[1]::DOUBLE, 4) AS value FROM embeddings)"


def samples(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("key"), (F.col("vec_id") % 2).alias("sample"), F.round(F.col("embedding")[0].cast("double"), 4).alias("value"))


@query(SAMPLES + """, v AS (SELECT key, value, count(*) FILTER (sample = 0) AS a, count(*) FILTER (sample = 1) AS b FROM x GROUP BY ALL), c AS (SELECT key, sum(a) OVER w AS n, sum(b) OVER w AS m, sum(a) OVER r AS fa, sum(b) OVER r AS fb FROM v WINDOW w AS (PARTITION BY key), r AS (PARTITION BY key ORDER BY value ROWS UNBOUNDED PRECEDING)),
d AS (SELECT key, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(m) AS BIGINT) AS m, max(abs(fa / nullif(n, 0) - fb / nullif(m, 0))) AS d FROM c GROUP BY key), t AS (SELECT *, d * sqrt(n * m / (n + m)) AS t FROM d),
p AS (SELECT *, CASE WHEN t < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: 2 * CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2 * k * k * t * t))), 0.0), 1.0) END AS p FROM t)
SELECT key, n, m, round(d, 6) AS d, round(p, 6) AS p, p < 0.05 AS drift FROM p""")
def k02_kolmogorov_smirnov(spark, sf_dir):
    return rounded(M.kolmogorov_smirnov(samples(spark, sf_dir)))


@query(SAMPLES + """, r AS (SELECT key, min(value) AS lo, max(value) AS hi FROM x WHERE sample = 0 GROUP BY key), b AS (SELECT key, least(floor((value - lo) / (hi - lo) * 20), 19) AS bin, count(*) FILTER (sample = 0) AS a, count(*) FILTER (sample = 1) AS b FROM x JOIN r USING (key) WHERE value BETWEEN lo AND hi AND hi > lo GROUP BY ALL),
q AS (SELECT key, b / sum(b) OVER (PARTITION BY key) + 1e-10 AS p, a / sum(a) OVER (PARTITION BY key) + 1e-10 AS q FROM b) SELECT key, round(sum(p * ln(p / q)), 6) AS kl, sum(p * ln(p / q)) > 0.1 AS drift FROM q GROUP BY key""")
def k03_kl(spark, sf_dir):
    return rounded(M.kl_divergence(samples(spark, sf_dir), 20))


@query(SAMPLES + """, a AS (SELECT key, count(*) FILTER (sample = 0) AS n, count(*) FILTER (sample = 1) AS m, avg(value) FILTER (sample = 0) AS ma, avg(value) FILTER (sample = 1) AS mb, var_samp(value) FILTER (sample = 0) AS va, var_samp(value) FILTER (sample = 1) AS vb FROM x GROUP BY key)
SELECT key, round((ma - mb) / sqrt(((n - 1) * va + (m - 1) * vb) / (n + m - 2) * (1 / n + 1 / m)), 6) AS t FROM a""")
def k04_t_test(spark, sf_dir):
    return rounded(M.t_test(samples(spark, sf_dir)).select("key", "t"))


RET = DAILY + f", re AS (SELECT symbol, ts, close / lag(close) {W} - 1 AS ret FROM bars)"


def ret_rows(spark, sf_dir):
    b = B.daily_bars(spark, sf_dir)
    return b.select("symbol", "ts", (div(F.col("close"), F.lag("close").over(over("symbol"))) - 1).alias("ret"))


@query(RET + ", x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM re WHERE ret IS NOT NULL), a AS (SELECT symbol, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS b, CASE WHEN count(*) >= 63 THEN coalesce(avg(ret) FILTER (k <= 63) / nullif(stddev_samp(ret) FILTER (k <= 63), 0) * sqrt(252), 0) ELSE 0 END AS r, count(*) AS n FROM x GROUP BY symbol) SELECT symbol, round(b, 6) AS baseline, round(r, 6) AS recent, n >= 63 AND coalesce(r < 0.7 * b, false) AS degraded FROM a")
def k05_sharpe_decay(spark, sf_dir):
    return rounded(M.sharpe_decay(ret_rows(spark, sf_dir), ["symbol"]))


@query(RET + f", v AS (SELECT symbol, ts, {roll('stddev_samp', 'ret', 60)} AS v FROM re), q AS (SELECT symbol, ts, CASE WHEN lag(v, 60) {W} = 0 THEN 1 ELSE v / lag(v, 60) {W} END AS r FROM v) SELECT symbol, ts, round(r, 6) AS ratio, CASE WHEN r > 1.5 THEN 'high_volatility' WHEN r < 0.67 THEN 'low_volatility' WHEN r IS NOT NULL THEN 'normal' ELSE 'unknown' END AS regime, coalesce(r > 1.5 OR r < 0.67, false) AS changed FROM q")
def k06_vol_ratio(spark, sf_dir):
    return rounded(M.vol_ratio(ret_rows(spark, sf_dir), ["symbol"]).select("symbol", "ts", "ratio", "regime", "changed"))


@query("WITH t AS (SELECT event_type AS name, event_id, value, row_number() OVER () AS z FROM events), k AS (SELECT event_type AS name, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)), ru AS (SELECT name, CASE k WHEN 1 THEN '>' WHEN 2 THEN '<' ELSE '>=' END AS c, CASE k WHEN 1 THEN 480.0 WHEN 2 THEN 5.0 ELSE 470.0 END AS th FROM k WHERE k <= 3) SELECT event_id, name, c AS comparison, value FROM t JOIN ru USING (name) WHERE CASE c WHEN '>' THEN value > th WHEN '<' THEN value < th ELSE value >= th END")
def k07_alerts(spark, sf_dir):
    from pyspark.sql import Window

    m = metric_rows(spark, sf_dir)
    k = m.select("name").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name"))).filter("k <= 3")
    rules = k.select("name", F.when(F.col("k") == 1, ">").when(F.col("k") == 2, "<").otherwise(">=").alias("comparison"), F.when(F.col("k") == 1, 480.0).when(F.col("k") == 2, 5.0).otherwise(470.0).alias("threshold"), F.lit("warning").alias("severity"))
    return M.alerts(m, rules).select("event_id", "name", "comparison", "value")


@query("WITH r AS (SELECT o_custkey % 10 AS strategy, o_orderkey AS run_id, o_orderdate AS ts, o_totalprice AS v FROM orders), b AS (SELECT *, first_value(v) OVER (PARTITION BY strategy ORDER BY ts, run_id) AS b FROM r) SELECT strategy, count(*) AS n, count(*) FILTER ((v - b) / abs(b) < -0.2) AS degraded FROM b GROUP BY strategy")
def k08_baseline(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("strategy"), F.struct("o_orderdate", "o_orderkey").alias("ord"), F.col("o_totalprice").alias("v"))
    x = M.compare_baseline(o, "strategy", "ord", "v")
    return x.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count_if("degraded").alias("degraded"))


@query("SELECT o_custkey AS run_id, last(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS status, max(o_orderdate) AS ts FROM orders GROUP BY o_custkey")
def e01_latest_runs(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey")
    return M.latest_state(o.withColumn("ord", F.struct("ts", "o_orderkey")), ["run_id"], "ord").select("run_id", "status", "ts")


RUNS = "WITH r AS (SELECT o_custkey AS run_id, o_orderkey AS k, o_orderdate AS ts, o_totalprice AS v, o_orderpriority AS p, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders)"


def run_events(spark, sf_dir):
    """Orders as the event log of runs: a step's metrics price and scaled, a parameter priority, an artifact by status."""
    from pyspark.sql import Window

    o = B.table(spark, sf_dir, "orders")
    o = o.withColumn("step", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    event = lambda kind, name, value, said: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), said.alias("text"))
    price = F.col("o_totalprice").cast("double")
    e = F.array(
        event("metric", F.lit("price"), price, text), event("metric", F.lit("scaled"), price / F.col("step"), text),
        event("param", F.lit("priority"), none, F.col("o_orderpriority")), event("artifact", F.col("o_orderstatus"), none, F.concat(F.lit("runs/"), F.col("o_orderkey").cast("string"))),
    )
    return o.select(F.col("o_custkey").alias("run_id"), F.struct("o_orderdate", "o_orderkey").alias("ts"), "step", F.explode(e).alias("e")).select("run_id", "ts", "step", "e.*")


@query(RUNS + " SELECT run_id, name, CAST(count(*) AS BIGINT) AS steps, round(last(value ORDER BY step), 3) AS value, round(max(value), 3) AS best FROM (SELECT run_id, step, unnest(['price', 'scaled']) AS name, unnest([v, v / step]) AS value FROM r) GROUP BY ALL")
def e01_step_metrics(spark, sf_dir):
    return rounded(M.last_metrics(M.run_metrics(run_events(spark, sf_dir))), 3)


@query(RUNS + " SELECT run_id, s AS name, 'runs/' || last(k ORDER BY step) AS text FROM r GROUP BY ALL")
def e01_artifacts(spark, sf_dir):
    return M.run_artifacts(run_events(spark, sf_dir))


@query(RUNS + " SELECT run_id, last(p ORDER BY step) AS param_priority, round(last(v ORDER BY step), 3) AS metric_price, round(last(v / step ORDER BY step), 3) AS metric_scaled FROM r GROUP BY run_id")
def e02_compare_runs(spark, sf_dir):
    return rounded(M.comparison(run_events(spark, sf_dir)), 3)


VERSIONS = """WITH e AS (SELECT 'm' || (o_custkey % 20) AS model, o_orderdate AS ts, o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'promote' ELSE 'register' END AS action, CASE WHEN o_orderstatus = 'P' THEN 'production' ELSE 'staging' END AS stage FROM orders),
d AS (SELECT model, ts, action, min(stage) AS stage FROM e GROUP BY ALL), v AS (SELECT *, CAST(sum((action = 'register')::INT) OVER (PARTITION BY model ORDER BY ts, action ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM d)
SELECT model, version, last(stage ORDER BY ts, action = 'promote') AS stage, min(ts) AS created FROM v WHERE version > 0 GROUP BY model, version"""


@query(VERSIONS)
def e03_model_versions(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    p = F.col("o_orderstatus") == "P"
    ev = o.select(F.concat(F.lit("m"), F.col("o_custkey") % 20).alias("model"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.when(p, "promote").otherwise("register").alias("action"), F.when(p, "production").otherwise("staging").alias("stage"))
    return M.model_versions(ev.groupBy("model", "ts", "action").agg(F.min("stage").alias("stage")))


@query(f"SELECT model, stage, max(version) AS version, arg_max(created, version) AS created FROM ({VERSIONS}) GROUP BY ALL")
def e03_latest_in_stage(spark, sf_dir):
    return M.latest_in_stage(e03_model_versions(spark, sf_dir))

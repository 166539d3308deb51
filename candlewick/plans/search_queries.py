"""Queries on parameter sweeps, validation splits and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import running
from ..operators import resample as S
from ..operators import search as X
from ..operators import signals
from ..sources import bars as B
from .market import _cdf, rounded, rule
from .registry import DAILY, RSI_RULE, W, draw_sql, intraday, query, roll

LENGTHS = [7, 14]


def params(spark):
    return X.grid(spark, mn1=LENGTHS, entry=[25.0, 35.0], exit=[65.0, 75.0]).withColumns({"on": F.lit(20), "off": F.lit(5), "start": F.lit(3)})


def swept(spark, sf_dir):
    return X.sweep(B.daily_bars(spark, sf_dir), params(spark), LENGTHS)


def _rsi(n: int) -> str:
    return f"CASE WHEN avg(down) OVER w{n} = 0 THEN 0.0 ELSE 100 - 100 / (1 + avg(up) OVER w{n} / avg(down) OVER w{n}) END AS rsi_{n}"


K = "OVER (PARTITION BY symbol, param_id ORDER BY ts)"
R = "OVER (PARTITION BY symbol, param_id ORDER BY ts ROWS UNBOUNDED PRECEDING)"
SWEEP = (
    DAILY
    + f""",
pa AS (SELECT row_number() OVER (ORDER BY mn1, entry, exit) - 1 AS param_id, * FROM (VALUES (7), (14)) AS a(mn1), (VALUES (25.0), (35.0)) AS b(entry), (VALUES (65.0), (75.0)) AS c(exit)),
d AS (SELECT *, close - lag(close) {W} AS diff, row_number() {W} - 1 AS i FROM bars), g AS (SELECT *, coalesce(greatest(diff, 0.0), 0.0) AS up, coalesce(greatest(-diff, 0.0), 0.0) AS down FROM d),
rs AS (SELECT *, {_rsi(7)}, {_rsi(14)} FROM g WINDOW w7 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w14 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
y AS (SELECT symbol, param_id, ts, i, open, CASE mn1 WHEN 7 THEN rsi_7 ELSE rsi_14 END AS rsi, entry, exit, ((i - 3) % 25 + 25) % 25 < 20 AS cy FROM rs, pa),
s AS (SELECT symbol, param_id, ts, i, open, rsi < entry AND cy AND lead(1) {K} IS NOT NULL AS e, rsi > exit OR NOT cy AS x, lead(1) {K} IS NULL AS is_last FROM y),
b AS (SELECT *, CASE WHEN e AND NOT x THEN 1 WHEN x AND NOT e THEN 0 END AS base FROM s),
p AS (SELECT *, coalesce(last_value(base IGNORE NULLS) {R}, 0) AS pos FROM b),
q AS (SELECT *, coalesce(lag(pos) {K}, 0) AS prev, coalesce(lead(open) {K}, open) AS nxt FROM p),
o AS (SELECT *, prev = 0 AND pos = 1 AS opened, prev = 1 AND pos = 0 AS closed FROM q),
t AS (SELECT *, last_value(CASE WHEN opened THEN nxt * 1.0006 END IGNORE NULLS) {R} AS ep, closed OR (is_last AND pos = 1) AS ends FROM o),
z AS (SELECT *, CASE WHEN ends THEN CASE WHEN closed THEN nxt ELSE open END * 0.9994 / ep END AS f FROM t),
fl AS (SELECT *, 1000 * exp(coalesce(sum(ln(f)) {R}, 0)) AS ea FROM z),
eq AS (SELECT symbol, param_id, ts, i, ends, CASE WHEN pos = 1 AND NOT ends THEN ea * open / ep ELSE ea END AS equity FROM fl),
er AS (SELECT *, equity / lag(equity) {K} - 1 AS ret FROM eq),
sc AS (SELECT symbol, param_id, count(*) FILTER (ends) AS trades, CASE WHEN stddev_samp(ret) > 0 THEN least(greatest(avg(ret) / stddev_samp(ret) * sqrt(252), -5), 10) ELSE 0 END AS sharpe FROM er GROUP BY ALL),
re AS (SELECT *, sharpe * CASE WHEN trades < 10 THEN 0.0 WHEN trades >= 30 THEN 1.0 ELSE (trades - 10) / 20.0 END AS score FROM sc)"""
)
# Toggles (entry and exit on one bar) cannot occur here, as no entry threshold reaches an exit threshold.


@query(SWEEP + " SELECT symbol, param_id, trades, round(sharpe, 5) AS sharpe, round(score, 5) AS score FROM re")
def b01_b02_sweep(spark, sf_dir):
    return rounded(X.scores(swept(spark, sf_dir), "rsi"), 5)


def _phase(k: int, y: str, enter: str = "rsi < entry AND cy", leave: str = "rsi > exit OR NOT cy") -> str:
    """SQL of a sweep's positions, fills, equity and returns: tables y<k> to er<k>, from a table of (symbol, param_id, ts, open, rsi, entry, exit, cy)."""
    return f"""y{k} AS ({y}),
s{k} AS (SELECT symbol, param_id, ts, open, {enter} AND lead(1) {K} IS NOT NULL AS e, {leave} AS x, lead(1) {K} IS NULL AS is_last FROM y{k}),
b{k} AS (SELECT *, CASE WHEN e AND NOT x THEN 1 WHEN x AND NOT e THEN 0 END AS base FROM s{k}),
p{k} AS (SELECT *, coalesce(last_value(base IGNORE NULLS) {R}, 0) AS pos FROM b{k}),
q{k} AS (SELECT *, coalesce(lag(pos) {K}, 0) AS prev, coalesce(lead(open) {K}, open) AS nxt FROM p{k}),
o{k} AS (SELECT *, prev = 0 AND pos = 1 AS opened, prev = 1 AND pos = 0 AS closed FROM q{k}),
t{k} AS (SELECT *, last_value(CASE WHEN opened THEN nxt * 1.0006 END IGNORE NULLS) {R} AS ep, closed OR (is_last AND pos = 1) AS ends FROM o{k}),
z{k} AS (SELECT *, CASE WHEN ends THEN CASE WHEN closed THEN nxt ELSE open END * 0.9994 / ep END AS f FROM t{k}),
fl{k} AS (SELECT *, 1000 * exp(coalesce(sum(ln(f)) {R}, 0)) AS ea FROM z{k}),
er{k} AS (SELECT *, equity / lag(equity) {K} - 1 AS ret FROM (SELECT symbol, param_id, ts, ends, CASE WHEN pos = 1 AND NOT ends THEN ea * open / ep ELSE ea END AS equity FROM fl{k}))"""


def _psr(n: str, m: str, sd: str, sk: str, ku: str, t: str, year: int = 252) -> str:
    """SQL of the probabilistic Sharpe ratio from moments."""
    s, eff = f"({m} / CASE WHEN {sd} >= 1e-12 THEN {sd} END)", f"(CASE WHEN {t} < {n} / 10 THEN greatest({t}::DOUBLE, 10.0) ELSE {n} END)"
    sk, ku = f"least(greatest({sk}, -10), 10)", f"least(greatest({ku}, -10), 50)"
    v = f"((1 - {sk} * {s} + ({ku} - 1) / 4 * {s} * {s}) / greatest({eff} - 1, 1) * {year})"
    se = f"(CASE WHEN {v} > 0 THEN sqrt({v}) ELSE (1 + least(5, abs({sk})) * 0.3) * (1 + least(10, abs({ku})) * 0.15) * sqrt({year}) / sqrt(greatest({eff} - 1, 1)) END)"
    bound = f"(CASE WHEN {eff} < 30 THEN 2.0 WHEN {eff} < 100 THEN 2.5 ELSE 3.0 END)"
    z = f"least(greatest(least(greatest({s} * sqrt({year}), -10), 10) / CASE WHEN {se} < 1e-10 THEN 0.2 ELSE {se} END, -{bound}), {bound})"
    return f"CASE WHEN {n} < 30 OR {sd} IS NULL THEN 0.5 WHEN {sd} < 1e-12 THEN CASE WHEN {m} > 0 THEN 0.95 ELSE 0.05 END ELSE least(greatest({_cdf(z)}, 0.001), 0.999) END"


PHASES = (
    SWEEP.split(",\ny AS", 1)[0]
    + """,
cg AS (SELECT row_number() OVER (ORDER BY "on", off, start) - 1 AS param_id, * FROM (VALUES (10), (20)) AS a("on"), (VALUES (5), (10)) AS b(off), (VALUES (0), (3)) AS c(start)), """
    + _phase(1, """SELECT symbol, param_id, ts, open, rsi_14 AS rsi, 30.0 AS entry, 70.0 AS exit, ((i - start) % ("on" + off) + ("on" + off)) % ("on" + off) < "on" AS cy FROM rs, cg""")
    + """,
sc1 AS (SELECT symbol, param_id, count(*) FILTER (ends) AS trades, CASE WHEN stddev_samp(ret) > 0 THEN least(greatest(avg(ret) / stddev_samp(ret) * sqrt(252), -5), 10) ELSE 0 END AS sharpe FROM er1 GROUP BY ALL),
re1 AS (SELECT *, round(sharpe * CASE WHEN trades < 10 THEN 0.0 WHEN trades >= 30 THEN 1.0 ELSE trades / 30.0 END, 6) AS score FROM sc1),
cy AS (SELECT re1.symbol, "on", off, start, score AS cycle_score, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, param_id) AS k FROM re1 JOIN cg USING (param_id)), """
    + _phase(2, """SELECT symbol, param_id, ts, open, CASE mn1 WHEN 7 THEN rsi_7 ELSE rsi_14 END AS rsi, entry, exit, ((i - start) % ("on" + off) + ("on" + off)) % ("on" + off) < "on" AS cy FROM rs JOIN (SELECT * FROM cy WHERE k = 1) USING (symbol), pa""")
    + f""",
mo2 AS (SELECT symbol, param_id, count(ret)::DOUBLE AS n, avg(ret) AS m, stddev_samp(ret) AS sd, skewness(ret) AS sk, kurtosis(ret) AS ku, count(*) FILTER (ends) AS trades FROM er2 GROUP BY ALL),
re2 AS (SELECT symbol, param_id, trades, round(({_psr('n', 'm', 'sd', 'sk', 'ku', 'trades')}) * CASE WHEN trades < 10 THEN 0.0 WHEN trades >= 30 THEN 1.0 ELSE (trades - 10) / 20.0 END, 6) AS score FROM mo2),
al AS (SELECT re2.*, "on", off, start, cycle_score, mn1, entry, exit, row_number() OVER (PARTITION BY re2.symbol ORDER BY score DESC, re2.param_id) AS k_all, row_number() OVER (PARTITION BY re2.symbol, re2.param_id // 500 ORDER BY score DESC, re2.param_id) AS k_batch
  FROM re2 JOIN cy ON re2.symbol = cy.symbol AND cy.k = 1 JOIN pa ON re2.param_id = pa.param_id)
SELECT symbol, CAST(param_id // 500 AS VARCHAR) AS batch, CAST(k_batch AS INT) AS rank, param_id, "on", off, start, mn1, entry, exit, cycle_score, trades, score FROM al WHERE k_batch <= 5
UNION ALL SELECT symbol, 'FINAL', 1, param_id, "on", off, start, mn1, entry, exit, cycle_score, trades, score FROM al WHERE k_all = 1"""
)


@query(PHASES)
def b01_a13_phases(spark, sf_dir):
    """The cycle phase, then the RSI phase at each symbol's best cycle; the best of each batch and the final row."""
    cycles = X.grid(spark, on=[10, 20], off=[5, 10], start=[0, 3])
    rsis = X.grid(spark, mn1=LENGTHS, entry=[25.0, 35.0], exit=[65.0, 75.0])
    found = X.two_phases(B.daily_bars(spark, sf_dir), cycles, rsis, {"mn1": 14, "entry": 30.0, "exit": 70.0}, LENGTHS)
    t = X.top_of_batches(found)
    return t.select("symbol", "batch", "rank", "param_id", "on", "off", "start", "mn1", "entry", "exit", "cycle_score", "trades", "score")


#: The search over timeframes: its timeframes, grids and defaults.
MANY, PAIRS = ("daily", "hourly", "5min"), [(7, 1), (7, 3), (14, 1), (14, 3)]
CYCLES = {"on": [10, 20], "off": [5, 10], "start": [0, 3]}
VALUES = {"mn1": [7, 14], "mn2": [1, 3], "entry": [30.0, 45.0], "exit": [55.0, 70.0]}
DEFAULTS = {"mn1": 14, "mn2": 3, "entry": 45.0, "exit": 60.0, "on": 20, "off": 5, "start": 0}


def _many_sql() -> str:
    """SQL of the search: for each timeframe two phases of tables, numbered from 1."""
    grid = lambda v: "SELECT row_number() OVER (ORDER BY " + ", ".join(f'"{n}"' for n in v) + ") - 1 AS param_id, * FROM " + ", ".join(f"(VALUES {', '.join(f'({x})' for x in xs)}) AS t{i}(\"{n}\")" for i, (n, xs) in enumerate(v.items()))
    frame = "(PARTITION BY symbol, tf ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    rsi = lambda n: f"CASE WHEN sum(greatest(-m, 0)) OVER {frame.format(n - 1)} > 1e-12 THEN 100 - 100 / (1 + sum(greatest(m, 0)) OVER {frame.format(n - 1)} / sum(greatest(-m, 0)) OVER {frame.format(n - 1)}) ELSE 0 END"
    trunc = {"daily": "date_trunc('day', {})", "hourly": "date_trunc('hour', {})", "5min": "{}"}
    cols = ("mn1", "mn2", "entry", "exit", '"on"', "off", "start")
    out = [f"""WITH sec AS (SELECT * FROM (VALUES ('5min', 300), ('hourly', 3600), ('daily', 86400)) AS s(tf, s)),
b AS (SELECT event_type AS symbol, tf, to_timestamp((epoch_us(ts) // (s::BIGINT * 1000000)) * s)::TIMESTAMP AS ts, first(value ORDER BY e.ts, event_id) AS open, last(value ORDER BY e.ts, event_id) AS close FROM events e, sec GROUP BY ALL),
d AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol, tf ORDER BY ts), 0) AS m, row_number() OVER (PARTITION BY symbol, tf ORDER BY ts) - 1 AS i FROM b),
r AS (SELECT *, {', '.join(f'{rsi(n)} AS r{n}' for n in sorted({a for a, _ in PAIRS}))} FROM d),
q AS MATERIALIZED (SELECT *, {', '.join(f'avg(r{a}) OVER {frame.format(n - 1)} AS r{a}_{n}' for a, n in PAIRS)} FROM r),
rl AS MATERIALIZED (SELECT symbol, tf, ts, i, unnest([{', '.join(str(a) for a, _ in PAIRS)}]) AS mn1, unnest([{', '.join(str(n) for _, n in PAIRS)}]) AS mn2, unnest([{', '.join(f'r{a}_{n}' for a, n in PAIRS)}]) AS rsi FROM q),
fi AS (SELECT symbol, ts, open FROM q WHERE tf = '5min'), fn AS (SELECT symbol, count(*) AS bars FROM fi GROUP BY symbol),
cg AS ({grid(CYCLES)}), vg AS ({grid(VALUES)}), df AS (SELECT DISTINCT symbol, {', '.join(f'{DEFAULTS[c.strip(chr(34))]} AS {c}' for c in cols)} FROM fi)"""]
    now = dict.fromkeys(MANY, "df")

    def signals_of(name: str, tf: str, params: str, by: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT symbol, {by} rl.ts, rsi < entry AND cy AS e, rsi > exit OR NOT cy AS x FROM (SELECT rl.*, p.* EXCLUDE (symbol, mn1, mn2), ((i - start) % ("on" + off) + "on" + off) % ("on" + off) < "on" AS cy FROM rl JOIN {params} p ON rl.symbol = p.symbol AND rl.mn1 = p.mn1 AND rl.mn2 = p.mn2 WHERE tf = '{tf}') rl)"""

    k, parts = 0, []
    for tf in MANY:
        for kind in ("cycle", "rsi"):
            k += 1
            if kind == "cycle":
                out.append(f"ca{k} AS (SELECT symbol, param_id, mn1, mn2, entry, exit, cg.* EXCLUDE param_id FROM {now[tf]} p, cg)".replace("FROM df p, cg", "FROM (SELECT symbol, mn1, mn2, entry, exit FROM df) p, cg"))
            else:
                out.append(f'ca{k} AS (SELECT symbol, vg.*, "on", off, start, cycle_score FROM w{k - 1}, vg)')
            others = [t for t in MANY if t != tf]
            out += [signals_of(f"sg{k}_{i}", t, now[t], "") for i, t in enumerate(others)] + [signals_of(f"sg{k}", tf, f"(SELECT * {'EXCLUDE cycle_score' if kind == 'rsi' else ''} FROM ca{k})", "param_id,")]
            join = " ".join(f"LEFT JOIN sg{k}_{i} ON sg{k}_{i}.symbol = f.symbol AND sg{k}_{i}.ts = {trunc[t].format('f.ts')}" for i, t in enumerate(others)) + f" LEFT JOIN sg{k} ON sg{k}.symbol = f.symbol AND sg{k}.param_id = c.param_id AND sg{k}.ts = {trunc[tf].format('f.ts')}"
            tables = [*(f"sg{k}_{i}" for i in range(len(others))), f"sg{k}"]
            y = f"SELECT f.symbol, c.param_id, f.ts, f.open, {' AND '.join(f'coalesce({t}.e, false)' for t in tables)} AS e0, {' OR '.join(f'coalesce({t}.x, true)' for t in tables)} AS x0 FROM fi f JOIN ca{k} c USING (symbol) {join}"
            out.append(_phase(k, y, "e0", "x0"))
            if kind == "cycle":
                score = "CASE WHEN stddev_samp(ret) > 0 THEN least(greatest(avg(ret) / stddev_samp(ret) * sqrt(252), -5), 10) ELSE 0 END * CASE WHEN t < 10 THEN 0.0 WHEN t >= 30 THEN 1.0 ELSE t / 30.0 END"
                out.append(f"sc{k} AS (SELECT symbol, param_id, count(*) FILTER (ends) AS t, {score.replace('t < ', 'count(*) FILTER (ends) < ').replace('t >= ', 'count(*) FILTER (ends) >= ').replace('t / ', 'count(*) FILTER (ends) / ')} AS s0 FROM er{k} GROUP BY ALL)")
            else:
                out.append(f"mo{k} AS (SELECT symbol, param_id, count(ret)::DOUBLE AS n, avg(ret) AS m, stddev_samp(ret) AS sd, skewness(ret) AS sk, kurtosis(ret) AS ku, count(*) FILTER (ends) AS t FROM er{k} GROUP BY ALL)")
                out.append(f"sc{k} AS (SELECT symbol, param_id, t, ({_psr('n', 'm', 'sd', 'sk', 'ku', 't', 19656)}) * CASE WHEN t < 10 THEN 0.0 WHEN t >= 30 THEN 1.0 ELSE (t - 10) / 20.0 END AS s0 FROM mo{k})")
            out.append(f"re{k} AS MATERIALIZED (SELECT symbol, param_id, t, CASE WHEN bars < 50 THEN 0.0 ELSE round(s0, 6) END AS score FROM sc{k} JOIN fn USING (symbol))")
            out.append(f"w{k} AS MATERIALIZED (SELECT c.* EXCLUDE param_id{', score AS cycle_score' if kind == 'cycle' else ''} FROM re{k} JOIN ca{k} c USING (symbol, param_id) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, param_id) = 1)")
        now[tf] = f"(SELECT * EXCLUDE cycle_score FROM w{k})"
        parts.append(f"SELECT '{tf}' AS tf, c.*, t AS trades, score FROM re{k} JOIN ca{k} c USING (symbol, param_id)")
    show = 'symbol, tf, batch, CAST(k AS INT) AS rank, param_id, "on", off, start, cycle_score, mn1, mn2, entry, exit, trades, score'
    return ",\n".join(out) + f""",
al AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY score DESC, param_id) AS k_all, row_number() OVER (PARTITION BY symbol, tf, param_id // 500 ORDER BY score DESC, param_id) AS k_batch FROM ({' UNION ALL BY NAME '.join(parts)}))
SELECT {show} FROM (SELECT *, CAST(param_id // 500 AS VARCHAR) AS batch, k_batch AS k FROM al WHERE k_batch <= 5 UNION ALL SELECT *, 'FINAL', 1 FROM al WHERE k_all = 1)"""


@query(_many_sql())
def b01_timeframes(spark, sf_dir):
    """Cycle, then RSI values of daily, hourly and five-minute bars in turn; the best five of each batch of 500 and the final rows."""
    bars = None
    for tf in MANY:
        b = B.intraday_bars(spark, sf_dir, tf).select("symbol", F.lit(tf).alias("tf"), F.col("ts").cast("timestamp").alias("ts"), "open", "close")
        bars = b if bars is None else bars.unionByName(b)
    found = X.timeframe_search(bars, MANY, X.grid(spark, **CYCLES), X.grid(spark, **VALUES), DEFAULTS, PAIRS)
    t = X.top_of_batches(found, keys=("symbol", "tf"))
    return t.select("symbol", "tf", "batch", "rank", "param_id", "on", "off", "start", "cycle_score", "mn1", "mn2", "entry", "exit", "trades", "score")


@query(SWEEP + ", r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 7) DESC, param_id) AS rank FROM re) SELECT symbol, param_id, trades, round(score, 5) AS score, rank FROM r WHERE rank <= 5")
def a13_top_trials(spark, sf_dir):
    r = X.scores(swept(spark, sf_dir), "rsi").withColumn("score", F.round("score", 7))
    return rounded(X.best(r, ["symbol"], 5).select("symbol", "param_id", "trades", "score", "rank"), 5)


@query(SWEEP.replace("(VALUES (25.0), (35.0)) AS b(entry), (VALUES (65.0), (75.0)) AS c(exit)", "(VALUES (25.0), (30.0), (35.0), (40.0)) AS b(entry), (VALUES (70.0)) AS c(exit)").replace("(VALUES (7), (14)) AS a(mn1)", "(VALUES (14)) AS a(mn1)") + """, m AS (SELECT *, max(score) OVER (PARTITION BY symbol) AS top FROM re)
SELECT symbol, count(*) AS n, round(max(score), 5) AS best_score, round(avg((score >= top - abs(top) * 0.2)::INT::DOUBLE), 5) AS stable_share FROM m GROUP BY symbol""")
def b03_b04_sensitivity(spark, sf_dir):
    base = X.grid(spark, mn1=[14], entry=[30.0], exit=[70.0]).withColumns({"on": F.lit(20), "off": F.lit(5), "start": F.lit(3)})
    r = X.scores(X.sweep(B.daily_bars(spark, sf_dir), X.sensitivity(base, "entry", [25.0, 30.0, 35.0, 40.0]), [14]), "rsi")
    return rounded(X.stable_share(r, ["symbol"]), 5)


@query(SWEEP + " SELECT symbol, mn1, count(*) FILTER (rsi < 30) AS below_30, count(*) FILTER (rsi < 35) AS below_35, count(*) FILTER (rsi < 40) AS below_40 FROM (SELECT symbol, unnest([7, 14]) AS mn1, unnest([rsi_7, rsi_14]) AS rsi FROM rs) GROUP BY ALL")
def b05_rsi_counts(spark, sf_dir):
    x = B.daily_bars(spark, sf_dir).select("symbol", "ts", "close")
    for n in LENGTHS:
        x = signals.expanding_rsi(x, n, f"rsi_{n}", ["symbol"])
    y = x.unpivot(["symbol"], [f"rsi_{n}" for n in LENGTHS], "k", "rsi").withColumn("mn1", F.split("k", "_")[1].cast("int"))
    return y.groupBy("symbol", "mn1").agg(*(F.count_if(F.col("rsi") < k).alias(f"below_{k}") for k in (30, 35, 40)))


def _wins(sql: str) -> str:
    return SWEEP + f""", rt AS (SELECT symbol, param_id, i, coalesce(ret, 0.0) AS ret, ends FROM er), nn AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), {sql},
ws AS (SELECT w.symbol, w.window_id, param_id, CASE WHEN var_samp(ret) FILTER (i < train_to) > 1e-15 THEN avg(ret) FILTER (i < train_to) / sqrt(var_samp(ret) FILTER (i < train_to)) * sqrt(252) ELSE 0 END AS train_score,
  CASE WHEN var_samp(ret) FILTER (i >= test_from) > 1e-15 THEN avg(ret) FILTER (i >= test_from) / sqrt(var_samp(ret) FILTER (i >= test_from)) * sqrt(252) ELSE 0 END AS test_score, sum(ret) FILTER (i >= test_from) AS test_sum, sum(ln(1 + ret)) FILTER (i < train_to) AS train_growth, sum(ln(1 + ret)) FILTER (i >= test_from) AS test_growth, count(*) FILTER (ends AND i < train_to) AS train_trades
  FROM rt JOIN w ON rt.symbol = w.symbol AND i >= train_from AND i < test_to GROUP BY ALL)"""


FOLDS = "w AS (SELECT symbol, CAST(f AS INT) AS window_id, 0 AS train_from, n - (5 - f) * (n // 6) AS train_to, n - (5 - f) * (n // 6) AS test_from, n - (5 - f) * (n // 6) + n // 6 AS test_to FROM nn, range(5) AS r(f))"
ROWS = "w AS (SELECT symbol, CAST(s // 21 AS INT) AS window_id, s AS train_from, s + 252 AS train_to, s + 252 AS test_from, s + 315 AS test_to FROM nn, range(0, 100000, 21) AS r(s) WHERE s + 315 <= n)"


def counts(spark, sf_dir):
    return B.daily_bars(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


NESTED = """ft AS (SELECT symbol, CAST(f AS INT) AS f, n - (5 - f) * (n // 6) AS t, n // 6 AS s FROM nn, range(5) AS r(f)),
w AS (SELECT symbol, f * 4 AS window_id, 0 AS train_from, t AS train_to, t AS test_from, t + s AS test_to FROM ft
  UNION ALL SELECT symbol, f * 4 + CAST(g AS INT) + 1, 0, t - (3 - g) * (t // 4), t - (3 - g) * (t // 4), t - (3 - g) * (t // 4) + t // 4 FROM ft, range(3) AS q(g))"""


@query(_wins(NESTED) + """, me AS (SELECT symbol, window_id // 4 AS f, param_id, round(avg(test_score), 6) AS sc FROM ws WHERE window_id % 4 > 0 GROUP BY ALL),
ch AS (SELECT *, row_number() OVER (PARTITION BY symbol, f ORDER BY sc DESC, param_id) AS k FROM me),
ou AS (SELECT ch.symbol, CAST(f AS INT) AS window_id, ch.param_id, sc, test_score FROM ch JOIN ws ON ws.symbol = ch.symbol AND ws.param_id = ch.param_id AND ws.window_id = f * 4 WHERE k = 1)
SELECT symbol, window_id, param_id, sc AS inner_score, round(test_score, 6) AS test_score, round(avg(test_score) OVER s, 6) AS mean_score, round(stddev_pop(test_score) OVER s, 6) AS std_score, round(min(test_score) OVER s, 6) AS min_score, round(max(test_score) OVER s, 6) AS max_score FROM ou WINDOW s AS (PARTITION BY symbol)""")
def b06_b07_nested_cv(spark, sf_dir):
    """Five outer folds, three inner ones in each."""
    return rounded(X.nested_cv(X.strategy_returns(swept(spark, sf_dir)), X.fold_windows(counts(spark, sf_dir))), 6)


@query(_wins(ROWS) + ", ch AS (SELECT *, row_number() OVER (PARTITION BY symbol, window_id ORDER BY round(train_score, 6) DESC, param_id) AS k FROM ws) SELECT symbol, window_id, param_id, round(train_score, 6) AS train_score, round(test_score, 6) AS test_score, round(round(train_score, 6) - test_score, 6) AS degradation FROM ch WHERE k = 1")
def b08_walk_forward_rows(spark, sf_dir):
    ws = X.window_scores(X.strategy_returns(swept(spark, sf_dir)), X.rolling_windows(counts(spark, sf_dir)))
    ch = X.walk_forward(ws.withColumn("train_score", F.round("train_score", 6)))
    return rounded(ch.select("symbol", "window_id", "param_id", "train_score", "test_score", "degradation"), 6)


SIGNED = lambda x: f"round(sign({x}) * ln(1 + abs({x})), 5)"


def signed(df, *names: str):
    """Values that may be of any size as signed logarithms."""
    return df.withColumns({n: F.round(F.signum(n) * F.log1p(F.abs(n)), 5) + F.lit(0.0) for n in names})


#: Windows by days as series of their own: the key is symbol, window and part.
DAYS = (
    DAILY
    + f""",
sp AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM bars GROUP BY symbol),
wk AS (SELECT symbol, CAST(k AS INT) AS window_id, a + INTERVAL 1 DAY * (k * 30) AS t0, a + INTERVAL 1 DAY * (k * 30 + 180) AS t1, a + INTERVAL 1 DAY * (k * 30 + 210) AS t2 FROM sp, range(0, 1000) AS r(k) WHERE k < greatest((date_diff('day', a, z) - 180) // 30, 1) AND a + INTERVAL 1 DAY * (k * 30 + 210) <= z),
pt AS (SELECT wk.symbol AS sym, window_id, ts >= t1 AS test, ts, open, close FROM wk JOIN bars ON wk.symbol = bars.symbol AND ts >= t0 AND ts < t2),
ok AS (SELECT sym, window_id FROM pt GROUP BY ALL HAVING count(*) FILTER (NOT test) >= 100 AND count(*) FILTER (test) >= 10),
ke AS (SELECT sym || '#' || window_id || '#' || test AS symbol, sym, window_id, test, ts, open, close FROM pt JOIN ok USING (sym, window_id)),
pa AS (SELECT row_number() OVER (ORDER BY mn1, entry, exit) - 1 AS param_id, * FROM (VALUES (7), (14)) AS a(mn1), (VALUES (25.0), (35.0)) AS b(entry), (VALUES (65.0), (75.0)) AS c(exit)),
d AS (SELECT *, close - lag(close) {W} AS diff, row_number() {W} - 1 AS i FROM ke), g AS (SELECT *, coalesce(greatest(diff, 0.0), 0.0) AS up, coalesce(greatest(-diff, 0.0), 0.0) AS down FROM d),
rs AS (SELECT *, {_rsi(7)}, {_rsi(14)} FROM g WINDOW w7 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w14 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
"""
    + _phase(1, "SELECT symbol, param_id, ts, open, CASE mn1 WHEN 7 THEN rsi_7 ELSE rsi_14 END AS rsi, entry, exit, ((i - 3) % 25 + 25) % 25 < 20 AS cy FROM rs, pa WHERE NOT test")
    + f""",
id AS (SELECT DISTINCT symbol, sym, window_id FROM ke),
mo1 AS (SELECT symbol, param_id, count(ret)::DOUBLE AS n, avg(ret) AS m, stddev_samp(ret) AS sd, skewness(ret) AS sk, kurtosis(ret) AS ku, count(*) FILTER (ends) AS trades FROM er1 GROUP BY ALL),
fe1 AS (SELECT symbol, param_id, 100 * (arg_max(ea, ts) / 1000 - 1) AS r FROM fl1 GROUP BY ALL),
re1 AS (SELECT symbol, param_id, trades, round(({_psr('n', 'm', 'sd', 'sk', 'ku', 'trades')}) * CASE WHEN trades < 10 THEN 0.0 WHEN trades >= 30 THEN 1.0 ELSE (trades - 10) / 20.0 END, 6) AS score FROM mo1),
bs AS (SELECT sym, window_id, param_id, score AS train_score, r AS train_return, trades AS train_trades FROM (SELECT * FROM re1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, param_id) = 1) JOIN fe1 USING (symbol, param_id) JOIN id USING (symbol) WHERE trades >= 5), """
    + _phase(2, "SELECT symbol, param_id, ts, open, CASE mn1 WHEN 7 THEN rsi_7 ELSE rsi_14 END AS rsi, entry, exit, ((i - 3) % 25 + 25) % 25 < 20 AS cy FROM rs JOIN bs USING (sym, window_id) JOIN pa USING (param_id) WHERE test")
    + """,
te AS (SELECT symbol, param_id, 100 * (arg_max(ea, ts) / 1000 - 1) AS test_return, count(*) FILTER (ends) AS test_trades FROM fl2 GROUP BY ALL HAVING count(*) FILTER (ends) >= 1),
wf AS (SELECT bs.*, test_return, test_trades, CASE WHEN train_return <> 0 THEN 100 * (train_return - test_return) / abs(train_return) ELSE 0 END AS degradation_pct FROM bs JOIN id USING (sym, window_id) JOIN te USING (symbol, param_id))"""
)


@query(DAYS + f" SELECT sym AS symbol, window_id, param_id, train_score, {SIGNED('train_return')} AS train_return, train_trades, {SIGNED('test_return')} AS test_return, test_trades, {SIGNED('degradation_pct')} AS degradation_pct FROM wf")
def b09_windows(spark, sf_dir):
    """Each window's best parameter, its return and trades in both parts (returns as signed logarithms)."""
    w = X.walk_forward_days(B.daily_bars(spark, sf_dir), params(spark), LENGTHS)
    return signed(w, "train_return", "test_return", "degradation_pct")


@query(DAYS + f""", a AS (SELECT sym AS symbol, count(*) AS n_windows, avg(train_return) AS tr, avg(test_return) AS te, avg((test_return > 0)::INT::DOUBLE) AS consistency, sum(ln(1 + train_return / 100)) AS ig, sum(ln(1 + test_return / 100)) AS og FROM wf GROUP BY sym),
e AS (SELECT *, CASE WHEN tr <> 0 THEN te / tr ELSE 0 END AS efficiency, CASE WHEN tr <> 0 THEN 100 * (tr - te) / abs(tr) ELSE 0 END AS degradation_pct FROM a)
SELECT symbol, n_windows, {SIGNED('tr')} AS train_return, {SIGNED('te')} AS test_return, round(consistency, 4) AS consistency, round(efficiency, 6) AS efficiency, {SIGNED('degradation_pct')} AS degradation_pct, round(ig, 5) AS in_sample_growth, round(og, 5) AS out_of_sample_growth, efficiency < 0.3 OR consistency < 0.4 OR degradation_pct > 70 AS overfit FROM e""")
def b09_walk_forward_days(spark, sf_dir):
    """180 and 30 days, five trades at least in train and one in test; returns as signed logarithms, the chained equities' growth as logarithms."""
    w = X.walk_forward_summary(X.walk_forward_days(B.daily_bars(spark, sf_dir), params(spark), LENGTHS))
    return rounded(signed(w, "train_return", "test_return", "degradation_pct"), 5, consistency=4, efficiency=6)


@query(DAILY + """, a AS (SELECT symbol, CAST(date_diff('day', min(ts), max(ts)) AS INT) AS days FROM bars GROUP BY symbol) SELECT symbol, days, CASE WHEN days < 60 THEN 'limited' WHEN days < 120 THEN 'modest' WHEN days < 365 THEN 'good' ELSE 'excellent' END AS level,
  CASE WHEN days < 60 THEN greatest(14, days // 3) WHEN days < 120 THEN greatest(30, days // 3) WHEN days < 365 THEN 90 ELSE 180 END AS train_days, CASE WHEN days < 60 THEN greatest(7, days // 6) WHEN days < 120 THEN greatest(10, days // 6) WHEN days < 365 THEN 20 ELSE 30 END AS test_days,
  CASE WHEN days < 60 THEN 300 WHEN days < 120 THEN 400 ELSE 500 END AS trials, CAST(greatest(0, (days - train_days) // test_days) AS INT) AS windows FROM a""")
def b10_adequacy(spark, sf_dir):
    return X.adequacy(B.daily_bars(spark, sf_dir))


SIMS = 1000
BASE = RSI_RULE + """, base AS (SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY trade_id) - 1 AS INT) AS idx, count(*) OVER (PARTITION BY symbol) AS n, 100 * (f - 1) AS x FROM filled WHERE ends)"""
SLOTS = f""", sl AS (SELECT DISTINCT symbol, n, sim, slot FROM base, range({SIMS}) AS a(sim), LATERAL (SELECT unnest(range(n)) AS slot))"""
PICK = {
    "iid": f"pk AS (SELECT *, {draw_sql(7)} % n AS idx FROM sl)",
    "block": f"pk AS (SELECT *, least({draw_sql(7, 'slot // 5')} % greatest(n - 4, 1) + slot % 5, n - 1) AS idx FROM sl)",
    "stationary": f"""p0 AS (SELECT *, slot = 0 OR {draw_sql(8)} % 10 = 0 AS nw, {draw_sql(7)} % n AS st FROM sl),
p1 AS (SELECT *, max(CASE WHEN nw THEN slot END) OVER wq AS at0, last_value(CASE WHEN nw THEN st END IGNORE NULLS) OVER wq AS s0 FROM p0 WINDOW wq AS (PARTITION BY symbol, sim ORDER BY slot ROWS UNBOUNDED PRECEDING)),
pk AS (SELECT *, (s0 + slot - at0) % n AS idx FROM p1)""",
    "permutation": f"p0 AS (SELECT *, {draw_sql(7)} AS dr FROM sl), pk AS (SELECT *, row_number() OVER (PARTITION BY symbol, sim ORDER BY dr, slot) - 1 AS idx FROM p0)",
}
PICKED = ", sx AS (SELECT pk.symbol, pk.sim, pk.slot, x FROM pk JOIN base ON pk.symbol = base.symbol AND pk.idx = base.idx)"
PATHS = PICKED + """,
pe AS (SELECT *, 1000 * exp(sum(ln(greatest(1 + x / 100, 1e-9))) OVER (PARTITION BY symbol, sim ORDER BY slot ROWS UNBOUNDED PRECEDING)) AS equity FROM sx),
pd AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY symbol, sim ORDER BY slot ROWS UNBOUNDED PRECEDING), 1000) - 1 AS dd FROM pe),
pm AS (SELECT symbol, sim, arg_max(equity, slot) AS fe, 100 * min(dd) AS mdd, avg(x) AS mean, stddev_samp(x) AS sd, stddev_samp(x) FILTER (x < 0) AS dn, coalesce(sum(x) FILTER (x > 0), 0) AS g, coalesce(-sum(x) FILTER (x < 0), 0) AS l,
  avg((x > 0)::INT::DOUBLE) AS win_rate, max(equity) - min(equity) AS rng FROM pd GROUP BY ALL)"""
LOG = lambda x: f"round(ln(greatest({x}, 1e-9) / 1000), 5)"
DIST = f""", vr AS (SELECT *, 100 * (fe / 1000 - 1) AS r FROM pm), vq AS (SELECT symbol, quantile_cont(r, 0.05) AS v95, quantile_cont(r, 0.01) AS v99 FROM vr GROUP BY symbol)
SELECT symbol, count(*) AS n_sims, {LOG('avg(fe)')} AS mean, {LOG('quantile_cont(fe, 0.5)')} AS median, {LOG('quantile_cont(fe, 0.05)')} AS p5, {LOG('quantile_cont(fe, 0.95)')} AS p95, {LOG('stddev_pop(fe)')} AS std, {LOG('min(fe)')} AS min, {LOG('max(fe)')} AS max,
  round(avg((fe > 1000)::INT::DOUBLE), 4) AS p_profit, round(avg((fe < 500)::INT::DOUBLE), 4) AS p_ruin, {SIGNED('any_value(v95)')} AS var_95, {SIGNED('any_value(v99)')} AS var_99, round(avg(mdd), 3) AS dd_mean, round(quantile_cont(mdd, 0.5), 3) AS dd_median, round(quantile_cont(mdd, 0.05), 3) AS dd_p95,
  round(quantile_cont(mdd, 0.01), 3) AS dd_p99, round(avg(mean / nullif(sd, 0)), 4) AS sharpe_mean, round(avg(win_rate), 10) AS win_rate_mean, round(stddev_pop(win_rate), 6) AS win_rate_std, {SIGNED('avg(r) FILTER (r <= v95 * (1 + 1e-12 * sign(v95)))')} AS cvar_95, {SIGNED('avg(r) FILTER (r <= v99 * (1 + 1e-12 * sign(v99)))')} AS cvar_99
FROM vr JOIN vq USING (symbol) GROUP BY symbol"""


def base(spark, sf_dir):
    """The rule's trade results in per cent. Checkpointed by nobody: it is small and recomputed the same."""
    return S.numbered(signals.trades(rule(spark, sf_dir), ["symbol"]), "pct_change", "trade_id")


def dist(sims):
    """The distribution over simulations. Prices here are independent draws, so equities grow beyond any sense: what is in
    money is shown as the logarithm of growth and what is in per cent as a signed logarithm, which do not hang on the last digits
    of 1e19.
    """
    d = S.distribution(S.path_metrics(sims))
    growth = lambda x: F.ln(F.greatest(x, F.lit(1e-9)) / 1000)
    money = {n: growth(F.col(n)) for n in ("mean", "median", "p5", "p95", "std", "min", "max")}
    share = {n: F.signum(n) * F.log1p(F.abs(n)) for n in ("var_95", "var_99", "cvar_95", "cvar_99")}
    return rounded(d.withColumns(money | share), 5, **dict.fromkeys(("dd_mean", "dd_median", "dd_p95", "dd_p99"), 3), p_profit=4, p_ruin=4, sharpe_mean=4, win_rate_mean=10, win_rate_std=6)


@query(BASE + SLOTS + ", " + PICK["iid"] + PATHS + DIST)
def b11_b18_bootstrap(spark, sf_dir):
    """Independent bootstrap of trades, value at risk, drawdowns, ratios."""
    return dist(S.bootstrap(base(spark, sf_dir), SIMS))


SPELLS = """, ds AS (SELECT *, -dd > 0.01 AS u FROM pd), d1 AS (SELECT *, CASE WHEN u AND NOT coalesce(lag(u) OVER o, false) THEN 1 ELSE 0 END AS st FROM ds WINDOW o AS (PARTITION BY symbol, sim ORDER BY slot)),
d2 AS (SELECT *, sum(st) OVER (PARTITION BY symbol, sim ORDER BY slot ROWS UNBOUNDED PRECEDING) AS spell FROM d1),
d3 AS (SELECT symbol, sim, spell, count(*) AS len, max(slot) + 1 - first(slot ORDER BY dd, slot) AS rec FROM d2 WHERE u GROUP BY ALL),
d4 AS (SELECT symbol, sum(len) / count(*) AS dd_duration, sum(rec) / count(*) AS recovery FROM d3 GROUP BY symbol)"""


@query(BASE + SLOTS + ", " + PICK["iid"] + PATHS + SPELLS + """, ra AS (SELECT *, CASE WHEN sd > 0 THEN least(greatest(mean / sd * sqrt(252), -5), 10) END AS sh, CASE WHEN dn > 0 THEN least(greatest(mean / dn * sqrt(252), -5), 10) END AS so, CASE WHEN mdd < 0 THEN ln(1 + greatest(100 * (fe / 1000 - 1) / -mdd, -0.999)) END AS ca FROM pm),
og AS (SELECT symbol, 1000 * exp(sum(ln(greatest(1 + x / 100, 1e-9)))) AS og FROM base GROUP BY symbol)
SELECT symbol, round(avg(sh), 4) AS sharpe_mean, round(quantile_cont(sh, 0.5), 4) AS sharpe_median, round(stddev_pop(sh), 5) AS sharpe_std, round(quantile_cont(sh, 0.05), 4) AS sharpe_p5, round(quantile_cont(sh, 0.95), 4) AS sharpe_p95, round(avg(so), 4) AS sortino_mean, round(stddev_pop(so), 5) AS sortino_std,
  round(avg(ca), 4) AS calmar_mean, round(quantile_cont(ca, 0.5), 4) AS calmar_median, round(sum(g) / nullif(sum(l), 0), 5) AS omega, round(any_value(dd_duration), 9) AS dd_duration, round(any_value(recovery), 9) AS recovery,
  round(least((max(fe) - min(fe)) / any_value(og) / 2, 1), 5) AS path_dependency, round(stddev_pop(fe) / avg(fe), 5) AS order_sensitivity, round(ln(abs((quantile_cont(fe, 0.95) / 1000 - 1) / (quantile_cont(fe, 0.05) / 1000 - 1))), 4) AS tail_ratio, round(sum(g) / nullif(sum(l), 0), 5) AS gain_to_pain, round(avg(win_rate), 10) AS win_rate_mean, round(stddev_pop(win_rate), 6) AS win_rate_std
FROM ra JOIN d4 USING (symbol) JOIN og USING (symbol) GROUP BY symbol""")
def b19_b22_analysis(spark, sf_dir):
    """Drawdown spells, risk-adjusted ratios, dependence on the path, tails (Calmar and tail ratio as logarithms)."""
    b = base(spark, sf_dir)
    a = S.analysis(S.bootstrap(b, SIMS), b)
    logs = {"tail_ratio": F.ln("tail_ratio")}
    return rounded(a.withColumns(logs), 4, **dict.fromkeys(("sharpe_std", "sortino_std", "omega", "path_dependency", "order_sensitivity", "gain_to_pain"), 5), dd_duration=9, recovery=9, win_rate_mean=10, win_rate_std=6)


@query(BASE + SLOTS + ", " + PICK["block"] + PATHS + DIST)
def b12_block_bootstrap(spark, sf_dir):
    return dist(S.block_bootstrap(base(spark, sf_dir), SIMS))


@query(BASE + SLOTS + ", " + PICK["stationary"] + PATHS + DIST)
def b13_stationary_bootstrap(spark, sf_dir):
    return dist(S.stationary_bootstrap(base(spark, sf_dir), SIMS))


@query(BASE + SLOTS + ", " + PICK["permutation"] + PATHS + " SELECT symbol, count(*) AS n, round(avg(mdd), 3) AS dd_mean, round(quantile_cont(mdd, 0.5), 3) AS dd_median, round(quantile_cont(mdd, 0.05), 3) AS dd_p5, round(quantile_cont(mdd, 0.95), 3) AS dd_p95, round(stddev_pop(mdd), 4) AS dd_std, round(min(mdd), 3) AS dd_worst, round(avg((fe > 1000)::INT::DOUBLE), 4) AS p_profit, round(ln(avg(rng)), 5) AS range_mean FROM pm GROUP BY symbol")
def b15_shuffle(spark, sf_dir):
    """Shuffled trades; only what depends on the path varies."""
    p = S.path_metrics(S.permutation(base(spark, sf_dir), SIMS))
    d = "max_drawdown"
    spread = [F.percentile(d, q).alias(f"dd_{n}") for n, q in (("median", 0.5), ("p5", 0.05), ("p95", 0.95))]
    a = p.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("dd_mean"), *spread, F.stddev_pop(d).alias("dd_std"), F.min(d).alias("dd_worst"), F.avg((F.col("final_equity") > 1000).cast("double")).alias("p_profit"), F.ln(F.avg("range")).alias("range_mean"))
    return rounded(a, 3, dd_std=4, p_profit=4, range_mean=5)


@query(BASE + SLOTS + f""", sx AS (SELECT sl.symbol, sim, CASE WHEN {draw_sql(7)} % 2 = 0 THEN x ELSE -x END AS x FROM sl JOIN base ON sl.symbol = base.symbol AND sl.slot = base.idx), sm AS (SELECT symbol, sim, avg(x) AS m FROM sx GROUP BY ALL),
so AS (SELECT symbol, avg(x) AS o FROM base GROUP BY symbol) SELECT symbol, round(any_value(o), 4) AS observed, round(avg((abs(m) >= abs(o) - 1e-9)::INT::DOUBLE), 4) AS p FROM sm JOIN so USING (symbol) GROUP BY symbol""")
def b14_sign_flip(spark, sf_dir):
    b = base(spark, sf_dir)
    m = S.sign_flip(b, SIMS).groupBy("symbol", "sim").agg(F.avg("x").alias("m")).join(b.groupBy("symbol").agg(F.avg("x").alias("o")), "symbol")
    return rounded(m.groupBy("symbol").agg(F.first("o").alias("observed"), F.avg((F.abs("m") >= F.abs("o") - 1e-9).cast("double")).alias("p")), 4)


NORMAL = f"""mo AS (SELECT symbol, avg(x) AS m, coalesce(stddev_pop(x), 0) AS s FROM base GROUP BY symbol),
sx AS (SELECT sl.symbol, sim, slot, m + s * sqrt(-2 * ln(({draw_sql(7)} + 1) / 2147483648.0::DOUBLE)) * cos(2 * pi() * (({draw_sql(8)} + 1) / 2147483648.0::DOUBLE)) AS x FROM sl JOIN mo USING (symbol))"""


@query(BASE + SLOTS + ", " + NORMAL + " SELECT symbol, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd FROM sx GROUP BY symbol")
def b16_normal(spark, sf_dir):
    return rounded(S.normal(base(spark, sf_dir), SIMS).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")), 4)


def _final(name: str, drawn: str) -> str:
    return f"SELECT '{name}' AS method, symbol, sim, 1000 * exp(sum(ln(greatest(1 + x / 100, 1e-9)))) AS fe FROM (WITH {(BASE + SLOTS + ', ' + drawn).split('WITH ', 1)[1]} SELECT symbol, sim, x FROM sx) GROUP BY symbol, sim"


_TENTH = f"pk AS (SELECT *, least({draw_sql(7, 'slot // greatest(2, n // 10)')} % greatest(n - greatest(2, n // 10) + 1, 1) + slot % greatest(2, n // 10), n - 1) AS idx FROM sl)"
_FINALS = " UNION ALL ".join(_final(n, d) for n, d in (("randomization", PICK["permutation"] + PICKED), ("bootstrap", PICK["iid"] + PICKED), ("parametric", NORMAL), ("block", _TENTH + PICKED)))


@query(f"""{BASE}, al AS ({_FINALS}), og AS (SELECT symbol, 1000 * exp(sum(ln(greatest(1 + x / 100, 1e-9)))) AS og FROM base GROUP BY symbol),
me AS (SELECT symbol, method, count(*) AS n_sims, avg((fe > 1000)::INT::DOUBLE) AS p_profit, avg((fe > og * (1 + 1e-9))::INT::DOUBLE) AS p_beats, avg((fe < 500)::INT::DOUBLE) AS p_ruin, quantile_cont(fe, 0.025) AS low, quantile_cont(fe, 0.975) AS high, any_value(og) AS og FROM al JOIN og USING (symbol) GROUP BY symbol, method)
SELECT symbol, method, n_sims, round(p_profit, 4) AS p_profit, round(p_beats, 4) AS p_beats, round(p_ruin, 4) AS p_ruin, {LOG('low')} AS low, {LOG('high')} AS high, {LOG('og')} AS original, og >= low * (1 - 1e-9) AND og <= high * (1 + 1e-9) AS inside FROM me""")
def b17_methods(spark, sf_dir):
    """Four methods side by side; money as logarithms of growth."""
    growth = {n: F.ln(F.greatest(F.col(n), F.lit(1e-9)) / 1000) for n in ("low", "high", "original")}
    return rounded(S.compare_methods(base(spark, sf_dir), SIMS).withColumns(growth), 4, low=5, high=5, original=5)


@query(BASE + """, a AS (SELECT symbol, count(x)::DOUBLE AS n, skewness(x) AS sk, kurtosis(x) AS ku FROM base GROUP BY symbol) SELECT symbol, round(CASE WHEN n < 8 THEN 0 ELSE sk END, 5) AS skew, round(CASE WHEN n < 8 THEN 0 ELSE ku END, 5) AS kurt FROM a""")
def b21_shape(spark, sf_dir):
    """B21; z and p of both tests are held against worked values in the tests."""
    return rounded(S.shape(base(spark, sf_dir)).select("symbol", "skew", "kurt"), 5)


RATIO = "CASE WHEN sd > 0 THEN least(greatest(mean / sd * sqrt(252), -5), 10) END"
MEASURES = f", iv AS MATERIALIZED (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY sim) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n, 100 * (fe / 1000 - 1) AS ret, {RATIO} AS sharpe, -mdd AS drawdown, win_rate FROM pm), rs AS (SELECT DISTINCT symbol, n, r FROM iv, range(1000) AS t(r)), dw AS (SELECT symbol, r, {draw_sql(9, 'j', 'r')} % n AS k FROM rs, LATERAL (SELECT unnest(range(n)) AS j)), mn AS (SELECT symbol, r, avg(ret) AS ret, avg(sharpe) AS sharpe, avg(drawdown) AS drawdown, avg(win_rate) AS win_rate FROM dw JOIN iv USING (symbol, k) GROUP BY ALL)"


def measures(sims):
    """Of each simulation its return in per cent, yearly Sharpe ratio, worst drawdown in per cent and share of winners."""
    p = S.path_metrics(sims)
    ratio = F.when(F.col("sd") > 0, F.least(F.greatest(F.col("mean") / F.col("sd") * 252**0.5, F.lit(-5.0)), F.lit(10.0)))
    return p.select("symbol", "sim", (100 * (F.col("final_equity") / 1000 - 1)).alias("ret"), ratio.alias("sharpe"), (-F.col("max_drawdown")).alias("drawdown"), "win_rate")


@query(BASE + SLOTS + ", " + PICK["iid"] + PATHS + MEASURES + f" SELECT symbol, {SIGNED('quantile_cont(ret, 0.025)')} AS ret_low, {SIGNED('quantile_cont(ret, 0.975)')} AS ret_high, " + ", ".join(f"round(quantile_cont({c}, {q}), {d}) AS {c}_{e}" for c, d in (("sharpe", 4), ("drawdown", 3), ("win_rate", 7)) for q, e in ((0.025, "low"), (0.975, "high"))) + " FROM mn GROUP BY symbol")
def b23_intervals(spark, sf_dir):
    """1,000 resamples of the means over 1,000 simulations (returns as signed logarithms)."""
    i = S.mean_intervals(measures(S.bootstrap(base(spark, sf_dir), SIMS)), ["ret", "sharpe", "drawdown", "win_rate"])
    return rounded(signed(i, "ret_low", "ret_high"), 5, sharpe_low=4, sharpe_high=4, drawdown_low=3, drawdown_high=3, win_rate_low=7, win_rate_high=7)


@query(BASE + SLOTS + ", " + PICK["iid"] + PATHS + f" SELECT symbol, slot AS step, {LOG('quantile_cont(equity, 0.5)')} AS median, {LOG('quantile_cont(equity, 0.05)')} AS p5, {LOG('quantile_cont(equity, 0.95)')} AS p95 FROM pe GROUP BY ALL")
def b24_bands(spark, sf_dir):
    b = S.bands(S.bootstrap(base(spark, sf_dir), SIMS))
    return rounded(b.withColumns({n: F.ln(F.greatest(F.col(n), F.lit(1e-9)) / 1000) for n in ("median", "p5", "p95")}), 5)


@query(BASE + SLOTS + ", " + PICK["iid"] + PATHS + f""", og AS (SELECT symbol, 1000 * exp(sum(ln(greatest(1 + x / 100, 1e-9)))) AS og FROM base GROUP BY symbol),
ra AS (SELECT symbol, avg({RATIO}) AS sh, -avg(mdd) AS dd, quantile_cont(100 * (fe / 1000 - 1), 0.05) AS v, avg((fe > 1000)::INT::DOUBLE) AS pp, least((max(fe) - min(fe)) / any_value(og) / 2, 1) AS path FROM pm JOIN og USING (symbol) GROUP BY symbol),
rs AS (SELECT symbol, CASE WHEN sh > 1 THEN 2 WHEN sh > 0.5 THEN 1 ELSE 0 END + CASE WHEN dd < 20 THEN 2 WHEN dd < 35 THEN 1 ELSE 0 END + CASE WHEN v > -10 THEN 2 WHEN v > -20 THEN 1 ELSE 0 END + CASE WHEN pp > 0.7 THEN 2 WHEN pp > 0.5 THEN 1 ELSE 0 END + CASE WHEN path < 0.3 THEN 2 WHEN path < 0.5 THEN 1 ELSE 0 END AS points FROM ra)
SELECT symbol, points, CASE WHEN points >= 8 THEN 'excellent' WHEN points >= 6 THEN 'good' WHEN points >= 4 THEN 'moderate' ELSE 'poor' END AS risk FROM rs""")
def b25_risk_grade(spark, sf_dir):
    """Yearly Sharpe ratio, mean worst drawdown, value at risk, chance of profit, and the spread of final equities against the original's."""
    b = base(spark, sf_dir)
    sims = S.bootstrap(b, SIMS)
    a = S.analysis(sims, b).select("symbol", "sharpe_mean", "path_dependency").join(S.distribution(S.path_metrics(sims)).select("symbol", "dd_mean", "var_95", "p_profit"), "symbol")
    s, k = S.risk_grade(F.col("sharpe_mean"), -F.col("dd_mean"), F.col("var_95"), F.col("p_profit"), F.col("path_dependency"))
    return a.select("symbol", s.alias("points"), k.alias("risk"))


HBASE = intraday("daily", 86400) + f""", re AS (SELECT symbol, ts, close / lag(close) {W} - 1 AS x FROM bars), base AS (SELECT symbol, CAST(row_number() {W} - 1 AS INT) AS idx, count(*) OVER (PARTITION BY symbol) AS n, x FROM re WHERE x IS NOT NULL)"""


def hbase(spark, sf_dir):
    """Daily returns of the tick symbols."""
    from ..functions.exprs import div, over

    b = B.intraday_bars(spark, sf_dir, "daily")
    return S.numbered(b.select("symbol", "ts", (div(F.col("close"), F.lag("close").over(over("symbol"))) - 1).alias("x0")), "x0", "ts")


STAT = HBASE + SLOTS + ", " + PICK["stationary"] + ", sx AS (SELECT pk.symbol, pk.sim, x FROM pk JOIN base ON pk.symbol = base.symbol AND pk.idx = base.idx), ob AS (SELECT symbol, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM base GROUP BY symbol), bo AS (SELECT symbol, sim, avg(x) AS bm, stddev_samp(x) AS bs FROM sx GROUP BY ALL)"


@query(STAT + ", y AS (SELECT symbol, coalesce(m / nullif(s, 0) * sqrt(n), 0) AS t, coalesce((bm - m) / nullif(bs, 0) * sqrt(n), 0) AS bt FROM bo JOIN ob USING (symbol)), p AS (SELECT symbol, any_value(t) AS t, avg((bt >= t)::INT::DOUBLE) AS p FROM y GROUP BY symbol) SELECT symbol, round(t, 4) AS t, round(p, 4) AS p, round(least(p * count(*) OVER (), 1), 4) AS p_corrected FROM p")
def b26_reality_check(spark, sf_dir):
    return rounded(S.reality_check(hbase(spark, sf_dir), SIMS), 4)


@query(STAT + ", y AS (SELECT sim, max(coalesce((bm - m) / nullif(bs, 0) * sqrt(n), 0)) AS bt FROM bo JOIN ob USING (symbol) GROUP BY sim), t AS (SELECT max(coalesce(m / nullif(s, 0) * sqrt(n), 0)) AS t FROM ob) SELECT round(max(t), 4) AS t, round(avg((bt >= t)::INT::DOUBLE), 4) AS p, count(*) AS n_sims FROM y, t")
def b27_superior_ability(spark, sf_dir):
    return rounded(S.superior_ability(hbase(spark, sf_dir), SIMS), 4)


@query(HBASE + SLOTS + f", pk AS (SELECT *, least({draw_sql(7, 'slot // 10')} % greatest(n - 9, 1) + slot % 10, n - 1) AS idx FROM sl)" + ", sx AS (SELECT pk.symbol, pk.sim, x FROM pk JOIN base ON pk.symbol = base.symbol AND pk.idx = base.idx), s AS (SELECT symbol, sim, coalesce(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252), 0) AS s FROM sx GROUP BY ALL), ob AS (SELECT symbol, coalesce(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252), 0) AS o FROM base GROUP BY symbol) SELECT symbol, round(any_value(o), 4) AS sharpe, round(quantile_cont(s, 0.025), 4) AS low, round(quantile_cont(s, 0.5), 4) AS median, round(quantile_cont(s, 0.975), 4) AS high FROM s JOIN ob USING (symbol) GROUP BY symbol")
def b28_sharpe_interval(spark, sf_dir):
    return rounded(S.sharpe_interval(hbase(spark, sf_dir), SIMS), 4)


@query(STAT + """, y AS (SELECT symbol, coalesce(m / nullif(s, 0) * sqrt(n), 0) AS t, coalesce((bm - m) / nullif(bs, 0) * sqrt(n), 0) AS bt FROM bo JOIN ob USING (symbol)), p AS (SELECT symbol, avg((bt >= t)::INT::DOUBLE) AS p FROM y GROUP BY symbol)
SELECT count(*) AS n_tests, count(*) FILTER (p < 0.05) AS significant, CASE WHEN count(*) FILTER (p < 0.05) = count(*) THEN 'highly_robust' WHEN count(*) FILTER (p < 0.05) * 2 >= count(*) THEN 'moderately_robust' ELSE 'not_robust' END AS verdict FROM p""")
def b29_verdict(spark, sf_dir):
    p = S.reality_check(hbase(spark, sf_dir), SIMS)
    k = F.count_if(F.col("p") < 0.05)
    return p.agg(F.count(F.lit(1)).alias("n_tests"), k.alias("significant"), S.verdict(k, F.count(F.lit(1))).alias("verdict"))

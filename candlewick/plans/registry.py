"""Registered queries: name, function of (spark, sf_dir), and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function by its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def roll(agg: str, x: str, n: int, by: str = "symbol", gate: int | None = None) -> str:
    """SQL of a rolling aggregate that waits for a full frame."""
    w = f"OVER (PARTITION BY {by} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n if gate is None else gate} THEN {agg}({x}) {w} END"


def draw_sql(seed: int, slot: str = "slot", sim: str = "sim") -> str:
    """SQL of the repeatable draw."""
    x = f"((({seed}::BIGINT * 1103515245 + {sim}::BIGINT * 1664525 + ({slot})::BIGINT * 22695477) % 2147483647))"
    y = f"(({x} * {x} + 12345) % 2147483647)"
    return f"(({y} * {y} + {x} + 67891) % 2147483647)"


#: SQL of the daily bars, and of the bars of ticks; each begins a WITH list.
DAILY = """WITH tick AS (
  SELECT p_brand AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS qty,
    l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS d, l_extendedprice AS e
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT symbol, 'daily' AS tf, ts, first(price ORDER BY a, b, c, d, e, qty) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY a, b, c, d, e, qty) AS close, sum(qty) AS volume
  FROM tick GROUP BY symbol, ts)"""


def intraday(tf: str, seconds: int) -> str:
    return f"""WITH tick AS (
  SELECT event_type AS symbol, to_timestamp((epoch_us(ts) // {seconds}000000) * {seconds})::TIMESTAMP AS bucket, ts AS tts, event_id, value AS price FROM events),
bars AS (
  SELECT symbol, '{tf}' AS tf, bucket AS ts, first(price ORDER BY tts, event_id) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY tts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM tick GROUP BY symbol, bucket)"""


W = "OVER (PARTITION BY symbol ORDER BY ts)"

#: SQL of the RSI rule on daily bars, on top of DAILY: positions, fills, equity.
RSI_RULE = (
    DAILY
    + f""",
d AS (SELECT *, close - lag(close) {W} AS diff FROM bars),
g AS (SELECT *, coalesce(greatest(diff, 0.0), 0.0) AS up, coalesce(greatest(-diff, 0.0), 0.0) AS down FROM d),
m AS (SELECT *, avg(up) OVER f AS ag, avg(down) OVER f AS al FROM g WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CASE WHEN al = 0 THEN 0.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi, lead(1) {W} IS NULL AS is_last FROM m),
s AS (SELECT *, (rsi < 30 AND NOT is_last) AS e, rsi > 70 AS x FROM r),
b AS (SELECT *, CASE WHEN e AND NOT x THEN 1 WHEN x AND NOT e THEN 0 END AS base FROM s),
p AS (SELECT *, coalesce(last_value(base IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS pos FROM b),
q AS (SELECT *, coalesce(lag(pos) {W}, 0) AS prev, coalesce(lead(open) {W}, open) AS nxt FROM p),
o AS (SELECT *, prev = 0 AND pos = 1 AS opened, prev = 1 AND pos = 0 AS closed FROM q),
t AS (SELECT *, CASE WHEN opened THEN nxt * 1.0006 END AS ep, CASE WHEN opened THEN ts END AS ets, CAST(sum(opened::INT) OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS trade_id FROM o),
u AS (SELECT *, last_value(ep IGNORE NULLS) OVER u AS entry_price, last_value(ets IGNORE NULLS) OVER u AS entry_ts, closed OR (is_last AND pos = 1) AS ends
  FROM t WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN ends THEN CASE WHEN closed THEN nxt ELSE open END * 0.9994 END AS exit_price FROM u),
z AS (SELECT *, exit_price / entry_price AS f FROM v),
filled AS (SELECT *, 1000 * exp(coalesce(sum(ln(f)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)) AS equity_after FROM z),
eq AS (SELECT symbol, ts, CASE WHEN pos = 1 AND NOT ends THEN equity_after * open / entry_price ELSE equity_after END AS equity FROM filled),
er AS (SELECT *, equity - lag(equity) {W} AS change, equity / lag(equity) {W} - 1 AS ret, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"""
)

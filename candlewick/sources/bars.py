"""Bars: building them from trades and ticks, cleaning, universes and time filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import over

#: Columns that every bar table has.
BAR_COLUMNS = ("symbol", "tf", "ts", "open", "high", "low", "close", "volume")
#: Broker names of common symbols (fixed values).
ALIASES = {"BTC": "BTC-USD", "ETH": "ETH-USD", "SOL": "SOL-USD", "DOGE": "DOGE-USD"}
#: Bucket of each timeframe, in seconds.
TF_SECONDS = {"1min": 60, "5min": 300, "hourly": 3600, "daily": 86400}
#: Days of history that each timeframe may have (fixed values).
TF_CAPS = {"daily": 3650, "hourly": 729, "5min": 59}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame itself; an error that names the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def standardise(df: DataFrame, names: dict[str, str], zone: str | None = None) -> DataFrame:
    """Columns renamed to ours, time as TIMESTAMP in UTC without a zone."""
    out = df.select(*(F.col(f"`{a}`").alias(b) for a, b in names.items()))
    ts = F.col("ts").cast("timestamp")
    return out.withColumn("ts", F.to_utc_timestamp(ts, zone) if zone else ts)


#: Columns of a landed file, in its order, and our names for them.
LANDED = {"Symbol": "symbol", "Date": "ts", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}


def landed(spark: SparkSession, path: str, tf: str, names: dict[str, str] = LANDED, form: str = "csv", zone: str | None = None) -> DataFrame:
    """Bars of one timeframe from files that were put into a folder: read by a fixed schema, standardised, within the cap.

    Rows that do not fit the schema have nulls; ``clean`` drops them.
    """
    text = ("symbol", "ts")
    schema = ", ".join(f"`{a}` {'string' if b in text else 'double'}" for a, b in names.items())
    rows = spark.read.schema(schema).options(**({"header": True} if form == "csv" else {})).format(form).load(path)
    return cap_history(standardise(rows, names, zone).withColumn("tf", F.lit(tf)).select(*BAR_COLUMNS))


def build_bars(ticks: DataFrame, bucket: Column, order: list[str], tf: str) -> DataFrame:
    """OHLCV bars from (symbol, price, qty) rows: first and last price by a total order within symbol and bucket.

    One shuffle; minima, maxima and sums are combined before it.
    """
    key = F.struct(*order)
    return ticks.groupBy("symbol", bucket.alias("ts")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("qty").alias("volume"),
    ).select("symbol", F.lit(tf).alias("tf"), "ts", "open", "high", "low", "close", "volume")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by brand from line items: price is the extended price by piece."""
    line = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    ticks = line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_brand").alias("symbol"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"), *line.columns)
    return build_bars(ticks, F.col("l_shipdate").cast("timestamp"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"], "daily")


def ticks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks from the event table: symbol by type, price by value, one piece each."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("qty"))


def bucket_of(ts: Column, tf: str) -> Column:
    s = TF_SECONDS[tf]
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / (s * 1000000)) * s)


def intraday_bars(spark: SparkSession, sf_dir: str, tf: str) -> DataFrame:
    t = ticks_of(spark, sf_dir)
    return build_bars(t.withColumn("tts", F.col("ts")), bucket_of(F.col("ts"), tf), ["tts", "event_id"], tf)


def normalise_symbol(s: Column, aliases: dict[str, str] | None = None) -> Column:
    """Trimmed, upper-cased, aliases replaced."""
    up = F.upper(F.trim(s))
    names = F.create_map(*(F.lit(x) for kv in (aliases or ALIASES).items() for x in kv))
    return F.coalesce(names[up], up)


def is_crypto(symbol: Column) -> Column:
    return symbol.contains("-USD")


def broker_symbol(symbol: Column) -> Column:
    """The broker's spelling: BTC-USD is BTC/USD."""
    return F.when(is_crypto(symbol), F.replace(symbol, F.lit("-USD"), F.lit("/USD"))).otherwise(symbol)


def clean(bars: DataFrame, seq: str | None = None) -> DataFrame:
    """No nulls, close above 0, the last row of each timestamp (by ``seq``), and a flag for moves over 50 %."""
    kept = bars.dropna(subset=["open", "high", "low", "close", "volume", "ts"]).filter(F.col("close") > 0)
    if seq:
        w = Window.partitionBy("symbol", "tf", "ts").orderBy(F.desc(seq))
        kept = kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    prev = F.lag("close").over(over("symbol", "tf"))
    return kept.withColumn("extreme", F.coalesce(F.abs(F.try_divide(F.col("close"), prev) - 1) > 0.5, F.lit(False)))


def last_days(bars: DataFrame, days: int, anchor_tf: str) -> DataFrame:
    """Rows of the last ``days`` days before the anchor timeframe's last bar of each symbol."""
    ends = bars.filter(F.col("tf") == anchor_tf).groupBy("symbol").agg(F.max("ts").alias("_end"))
    return bars.join(ends, "symbol").filter(F.col("ts") >= F.col("_end") - F.expr(f"INTERVAL {days} DAYS")).drop("_end")


def cap_history(bars: DataFrame, caps: dict[str, int] = TF_CAPS) -> DataFrame:
    """Rows within each timeframe's cap before its own last bar of each symbol."""
    ends = bars.groupBy("symbol", "tf").agg(F.max("ts").alias("_end"))
    days = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[F.col("tf")]
    return bars.join(ends, ["symbol", "tf"]).filter(F.unix_timestamp("ts") >= F.unix_timestamp("_end") - F.coalesce(days, F.lit(1 << 20)) * 86400).drop("_end")


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series, with the windows that a look-back of n scales to."""
    w = Window.partitionBy("symbol", "tf").orderBy(F.desc("ts"))
    out = bars.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
    return out.withColumns({"win_short": F.lit(max(10, n // 10)), "win_mid": F.lit(max(20, n // 5)), "win_long": F.lit(max(50, int(n / 1.25)))})


def in_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of the symbols in a universe table."""
    return bars.join(universe.select(normalise_symbol(F.col("ticker")).alias("symbol")).distinct(), "symbol", "left_semi")


def multi_asset(bars: DataFrame, classes: DataFrame, least: int = 100) -> DataFrame:
    """Bars with their asset class; symbols with fewer than ``least`` bars go."""
    enough = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("symbol")
    return bars.join(enough, "symbol").join(classes, "symbol")


def buy_and_hold(bars: DataFrame, start: float = 1000.0) -> DataFrame:
    """Value of ``start`` put into each symbol at its first close."""
    return bars.select("symbol", "tf", "ts", (start * F.col("close") / F.first("close").over(over("symbol", "tf"))).alias("equity"))

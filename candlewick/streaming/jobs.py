"""Streaming jobs on ticks, metrics and equity; each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import monitor

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Ticks from a folder of Parquet files."""
    s = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), "user_id")


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Closed tumbling bars; windows that the watermark has not passed are held back."""
    key = F.struct("ts", "event_id")
    b = ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "symbol").agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return b.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_metrics(ticks: DataFrame, width: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Sliding mean, deviation and count as metric rows."""
    g = ticks.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "symbol").agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("deviation"), F.count(F.lit(1)).cast("double").alias("count"))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("mean", "deviation", "count")))).alias("m")
    return g.select(F.col("window.end").alias("ts"), "symbol", rows).select("ts", "symbol", "m.name", "m.value")


def drift_sink(reference: DataFrame, path: str, threshold: float = 0.1):
    """A function for foreachBatch: the drift of each closed window's histogram against the reference's, as metric rows.

    A batch writes the folder of its own number and nothing else, so a batch that is run again replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        now = batch.select("key", "ts", "bin", "n")
        rows = monitor.histogram_drift(reference.sparkSession.read.parquet(f"{path}/reference"), now, ["key", "ts"], threshold)
        rows.select("ts", F.col("key").alias("symbol"), F.lit("kl").alias("name"), F.col("kl").alias("value"), "drift").write.mode("overwrite").parquet(f"{path}/metrics/batch={number}")

    reference.write.mode("overwrite").parquet(f"{path}/reference")
    return write


def stream_drift(ticks: DataFrame, ranges: DataFrame, width: str = "60 days", slide: str = "1 day", bins: int = 50, late: str = "1 hour") -> DataFrame:
    """(key, ts, bin, n): histograms of sliding windows that the watermark has passed; ``ranges``: key, lo, hi of the reference."""
    x = ticks.withWatermark("ts", late).select("ts", F.col("symbol").alias("key"), F.col("price").alias("value"))
    h = monitor.histogram(x.withColumn("w", F.window("ts", width, slide)), ranges, ["w", "key"], bins)
    return h.select("key", F.col("w.end").alias("ts"), "bin", "n")


def run_batches(stream: DataFrame, sink, checkpoint: str) -> None:
    """Runs a stream over what is there, each micro-batch through ``sink``."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def stream_signals(bars: DataFrame, n: int = 14, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """RSI of the last n moves of each symbol and a long or flat flag; the state is n + 1 closes and the flag.

    A symbol's rows of one trigger are sorted together; ``maxFilesPerTrigger`` bounds them.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, pos = (np.array(state.get[0], float), int(state.get[1])) if state.exists else (np.zeros(0), 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        closes = np.concatenate([past, rows["close"].to_numpy(float)])
        moves = np.diff(closes, prepend=closes[:1])
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(n - 1), moves]), n)[len(past) :]
        gain, loss = np.where(windows > 0, windows, 0.0).sum(axis=1), -np.where(windows < 0, windows, 0.0).sum(axis=1)
        rsi = np.where(loss > 0, 100 - 100 / (1 + gain / np.where(loss > 0, loss, 1.0)), 0.0)
        event = pd.Series(np.where(rsi < low, 1.0, np.where(rsi > high, 0.0, np.nan)))
        flag = event.ffill().fillna(pos).astype(int).to_numpy()
        state.update((closes[-(n + 1) :].tolist(), int(flag[-1])))
        yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"].to_numpy(), "rsi": rsi, "pos": flag})

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, rsi double, pos int", "closes array<double>, pos int", "append", GroupStateTimeout.NoTimeout)


def stream_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """T4: metric rows that break a rule."""
    return monitor.alerts(metrics, rules)


#: Rows of a portfolio that are given back at once.
PART = 50_000


def stream_risk(equity: DataFrame, drawdown: float = -0.10, start: float = 100000.0) -> DataFrame:
    """T5: equity, peak, drawdown and a latched kill switch of each portfolio; ``equity``: (event_id, portfolio, ts, change).

    Of a portfolio's rows of one trigger a task keeps three numbers a row, sorts them by an index, and gives them back in parts of
    ``PART`` rows with the state carried from part to part.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, peak, killed = state.get if state.exists else (start, start, False)
        parts = [(b["ts"].to_numpy("datetime64[us]"), b["event_id"].to_numpy("int64"), b["change"].to_numpy(float)) for b in batches]
        ts, ids, change = (np.concatenate(columns) for columns in zip(*parts, strict=True))
        del parts
        order = np.lexsort((ids, ts))
        for k in range(0, len(order), PART):
            rows = order[k : k + PART]
            path = np.cumsum(np.concatenate([[now], change[rows]]))[1:]
            peaks = np.maximum.accumulate(np.concatenate([[peak], path]))[1:]
            fall = path / peaks - 1
            dead = np.logical_or.accumulate(np.concatenate([[killed], fall < drawdown]))[1:]
            now, peak, killed = float(path[-1]), float(peaks[-1]), bool(dead[-1])
            if k + PART >= len(order):
                state.update((now, peak, killed))
            yield pd.DataFrame({"portfolio": key[0], "event_id": ids[rows], "ts": ts[rows], "equity": path, "peak": peaks, "drawdown": fall, "killed": dead})

    once = equity.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("portfolio").applyInPandasWithState(step, "portfolio string, event_id long, ts timestamp, equity double, peak double, drawdown double, killed boolean", "now double, peak double, killed boolean", "append", GroupStateTimeout.NoTimeout)


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of activity, parted by gaps."""
    s = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "symbol").agg(F.count(F.lit(1)).alias("n"))
    return s.select("symbol", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n")


#: State that processors with several variables and timers need.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_once(stream: DataFrame, out: str, checkpoint: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over what is there, to a Parquet folder, and reads that. ``conf`` holds while it starts."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(out)

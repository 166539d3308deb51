"""Versioned tables of bars and features: append-only Parquet with lineage, checksums and integrity checks."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION_SCHEMA = "version_id string, created_at timestamp, data_type string, symbol string, start_ts timestamp, end_ts timestamp, record_count long, checksum string, schema_version string, metadata map<string,string>"


def checksum(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, record_count, checksum): order-free hash of all rows, by sum and xor of row hashes."""
    h = F.xxhash64(*sorted(df.columns))
    a = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("record_count"), F.sum(h.cast("decimal(38,0)")).alias("_s"), F.bit_xor(h).alias("_x"))
    return a.select(*keys, "record_count", F.sha2(F.concat_ws(":", F.col("record_count").cast("string"), F.col("_s").cast("string"), F.col("_x").cast("string")), 256).alias("checksum"))


class AppendTable:
    """A Parquet table whose appends are seen whole or not at all, under any Hadoop file system.

    An append writes a folder of its own and then one empty marker, which readers go by: what a failed or running append has
    left is never read. Markers are put in place by a rename, so appends at the same time do not disturb each other.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def stage(self, df: DataFrame) -> str:
        """Writes rows that nobody sees yet; returns the name under which ``commit`` shows them."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/part-{name}")
        return name

    def commit(self, name: str) -> None:
        fs, staged = self._files(f"{self.root}/_staged-{name}")
        fs.create(staged, True).close()
        _, folder = self._files(f"{self.root}/_commits")
        fs.mkdirs(folder)
        _, marker = self._files(f"{self.root}/_commits/{name}")
        if not fs.rename(staged, marker):
            raise OSError(f"could not commit {name}")

    def append(self, df: DataFrame) -> None:
        self.commit(self.stage(df))

    def read(self) -> DataFrame:
        """All committed rows; a table without any is empty."""
        fs, folder = self._files(f"{self.root}/_commits")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/part-{n}" for n in sorted(names)))


class VersionedStore:
    """Tables under one root, which any Hadoop file system may hold: data by type, symbol, version and year (files by month would be tiny for daily bars); and ``versions``.

    A version is there once its rows in ``versions`` are committed, all at once; data without them is never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = AppendTable(spark, f"{self.root}/versions", VERSION_SCHEMA)

    def write(self, df: DataFrame, data_type: str = "raw", metadata: dict[str, str] | None = None) -> str:
        """Appends all symbols of a frame as one new version, a row in ``versions`` for each symbol."""
        version = f"{datetime.now(UTC):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
        rows = df.withColumns({"version_id": F.lit(version), "year": F.year("ts")})
        rows.repartition("symbol", "year").sortWithinPartitions("symbol", "year", "ts").write.mode("append").partitionBy("symbol", "version_id", "year").parquet(f"{self.root}/{data_type}")
        sums = checksum(df, ["symbol"]).join(df.groupBy("symbol").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")), "symbol")
        tags = F.create_map(*(F.lit(x) for kv in (metadata or {}).items() for x in kv)) if metadata else F.create_map().cast("map<string,string>")
        self.log.append(sums.select(
            F.lit(version).alias("version_id"), F.current_timestamp().alias("created_at"), F.lit(data_type).alias("data_type"), "symbol", F.col("start_ts").cast("timestamp").alias("start_ts"), F.col("end_ts").cast("timestamp").alias("end_ts"), "record_count", "checksum", F.lit("1.0").alias("schema_version"), tags.alias("metadata"),
        ))
        return version

    def versions(self, data_type: str | None = None) -> DataFrame:
        """Newest first."""
        v = self.log.read()
        v = v.filter(F.col("data_type") == data_type) if data_type else v
        return v.orderBy(F.desc("created_at"), F.desc("version_id"))

    def latest(self, data_type: str = "raw") -> DataFrame:
        """(symbol, version_id) of each symbol's newest version."""
        return self.versions(data_type).groupBy("symbol").agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("version_id"))

    def read(self, data_type: str = "raw", symbols: list[str] | None = None, start=None, end=None, version: str | None = None) -> DataFrame:
        """A version (the latest of each symbol) within a time range: partitions are pruned by year before rows are."""
        x = self.spark.read.parquet(f"{self.root}/{data_type}")
        if symbols:
            x = x.filter(F.col("symbol").isin(symbols))
        if start is not None:
            x = x.filter((F.col("year") >= F.year(F.lit(start).cast("timestamp"))) & (F.col("ts") >= F.lit(start).cast("timestamp")))
        if end is not None:
            x = x.filter((F.col("year") <= F.year(F.lit(end).cast("timestamp"))) & (F.col("ts") <= F.lit(end).cast("timestamp")))
        known = self.versions(data_type).filter(F.col("version_id") == version).select("symbol", "version_id") if version else self.latest(data_type)
        x = x.join(known, ["symbol", "version_id"], "left_semi")
        return x.drop("year", "version_id")

    def integrity(self, data_type: str = "raw") -> DataFrame:
        """(symbol, version_id, intact): the checksum of what is stored against the one written down."""
        data = self.spark.read.parquet(f"{self.root}/{data_type}").drop("year")
        h = F.xxhash64(*sorted(c for c in data.columns if c != "version_id"))
        now = data.groupBy("symbol", "version_id").agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("_s"), F.bit_xor(h).alias("_x"))
        now = now.select("symbol", "version_id", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("_s").cast("string"), F.col("_x").cast("string")), 256).alias("_now"))
        return self.versions(data_type).join(now, ["symbol", "version_id"], "left").select("symbol", "version_id", F.coalesce(F.col("_now") == F.col("checksum"), F.lit(False)).alias("intact"))


class FeatureStore:
    """Pipelines by name; computes and stores their features with lineage."""

    def __init__(self, store: VersionedStore):
        self.store, self.pipelines = store, {}

    def register(self, pipeline) -> None:
        self.pipelines[pipeline.name] = pipeline

    def compute_and_store(self, bars: DataFrame, name: str) -> str:
        p = self.pipelines[name]
        return self.store.write(p.compute(bars), f"features_{name}", {"feature_columns": ",".join(p.names()), "feature_version": p.config()["version"]})

    def get(self, name: str, **where) -> DataFrame:
        return self.store.read(f"features_{name}", **where)

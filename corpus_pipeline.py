"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from candlewick.llm import minhash, packing, pii, quality, substrings
from candlewick.llm.common import shared_folder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` of the text as it now is; a null text stays null."""
    return df.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go; all others stay as they are."""
    docs, text = docs.select(*COLUMNS), F.coalesce(F.col("text").cast("string"), F.lit(""))
    one, two = F.xxhash64(text), F.xxhash64(F.lit(1), text)  # 128 bits between them
    judged = quality.judge(docs.select("doc_id", "source", "text", one.alias("_h"), two.alias("_g")), keep=("doc_id", "source", "_h", "_g"))
    kept = judged.filter("kept").select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("_h").alias("_a"), F.col("_g").alias("_b")).distinct()
    same = (one == F.col("_a")) & (two == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s"))
    return docs.join(kept, same, "left_semi").select(*COLUMNS)


def _row_key(docs: DataFrame) -> Column:
    """A key of a row's content, the same in each scan: rows have one key only if they agree in all columns.

    The hash's seed is raised until no two different rows share a key, by a second hash.
    """
    row = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS] + [F.col(c).isNull() for c in COLUMNS]
    for seed in range(8):
        key = F.xxhash64(F.lit(seed), *row)
        both = docs.select(key.alias("k"), F.xxhash64(F.lit(-1 - seed), *row).alias("h"))
        if both.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter(F.col("a") < F.col("b")).isEmpty():
            return key
    raise RuntimeError("row keys did not come apart")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: of least doc_id (null last), then of least key; blank texts all stay.

    Rows are linked by what they hold and not by doc_id, so rows that repeat an id with other texts stay and rows
    without an id are linked like others.
    """
    blank = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^ \t-\r]")
    full = docs.filter(~blank).select(*COLUMNS)
    keyed = full.withColumn("_k", _row_key(full))
    groups = minhash.link(keyed.select(F.col("_k").alias("doc_id"), "text")).select(F.col("doc_id").alias("_k"), F.col("component_id").alias("_c")).distinct()
    named = groups.join(keyed.select("_k", "doc_id").distinct(), "_k")
    kept = named.groupBy("_c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k"))["_k"].alias("_k")).select("_k")
    # Rows of one key are equal, so any of them will do.
    return keyed.join(kept, "_k", "left_semi").dropDuplicates(["_k"]).select(*COLUMNS).unionByName(docs.filter(blank).select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go, in all places; a text that loses none keeps its white space."""
    done = substrings.dedup(docs.select(*COLUMNS))
    return _documents(done.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets."""
    return _documents(pii.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pii", personal_data), ("packing", pack)]

#: Near-dedup and packing are no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared checkpoint folder and read again."""
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs

"""Helpers shared by the text operators: lineage cuts and Arrow text buffers."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at once; a longer document is a piece of its own.
PIECE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder that the cluster names in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a temporary one is taken in local mode only.

    A local folder on a cluster would be one that the executors don't share, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="candlewick-checkpoint-")


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Cut, and read as so few partitions that each has about ``rows`` rows: small tables then make few small files."""
    df = cut(df)
    return df.coalesce(max(1, -(-df.count() // rows)))


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose ``text`` column holds at most ``limit`` bytes, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
    ends = np.cumsum(lengths)
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def slices(texts: pa.Array, limit: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, documents, bases): pieces of texts, about ``limit`` bytes at once.

    A longer text is cut into pieces that go on for ``overlap`` bytes into the next, so each run of ``overlap`` + 1 bytes
    begins in one piece only and is whole there. ``bases`` says where in its document a piece begins.
    """
    data, offsets = buffer_of(texts)
    first = 0
    while first < len(offsets) - 1:
        begin, end = int(offsets[first]), int(offsets[first + 1])
        if end - begin > limit:
            for at in range(0, end - begin, limit):
                piece = data[begin + at : min(begin + at + limit + overlap, end)]
                yield piece, np.array([0, len(piece)]), np.array([first]), np.array([at])
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(offsets, begin + limit, side="right")) - 1)
        yield data[begin : offsets[last]], offsets[first : last + 1] - begin, np.arange(first, last), np.zeros(last - first, np.int64)
        first = last


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more offset than texts). Null is empty."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]

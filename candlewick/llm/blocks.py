"""Exact repeats over a whole corpus with small shuffles.

Documents travel in blocks of a few MB. A block sends the distinct keys that it asks about, packed by range of the
key; a task for each range sorts what all blocks sent and answers in the same order. So what is shuffled is keys and
answers and never texts, hot keys are counted within a block before they leave it (one entry for each block at most),
and each task holds one range at a time. Keys must be spread evenly over 64 bits; the number of ranges follows the
number of blocks, so that a range holds about as many keys as RANGE_BLOCKS blocks send. A block has at most a row for
each key it sends, so there are never more rows than a row for each key would be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 4 << 20
#: Blocks whose keys one range holds, about.
RANGE_BLOCKS = 4
#: What a block is told of a key: it is there once, or more than once, or so and this block is the first that has it.
ALONE, REPEATED, FIRST = 0, 1, 2


def blocks_of(docs: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(block, rows): all columns of ``docs`` in compressed record batches of about ``limit`` bytes of text.

    Written out, as later passes must see the same blocks.
    """

    def run(batches):
        where, n = TaskContext.get().partitionId() << 32, 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in batches:
            for piece in pieces(batch, limit):
                sink = pa.BufferOutputStream()
                whole = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in piece.columns], schema=piece.schema)
                with pa.ipc.new_stream(sink, piece.schema, options=options) as writer:
                    writer.write_batch(whole)
                yield pa.RecordBatch.from_arrays([pa.array([where + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])
                n += 1

    return cut(docs.mapInArrow(run, "block long, rows binary"))


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, list[np.ndarray]]]:
    """(block, its rows, the answers in each further column) for each row of a batch of blocks."""
    for k in range(batch.num_rows):
        rows = pa.ipc.open_stream(batch.column(1)[k].as_buffer()).read_next_batch()
        said = [b"".join(x["said"] for x in batch.column(c)[k].as_py() or []) for c in range(2, batch.num_columns)]
        yield batch.column(0)[k].as_py(), rows, [np.frombuffer(x, np.uint8) for x in said]


def starts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of 64-bit values begins in sorted keys, and the end."""
    bounds = [(r * 2**64) // parts for r in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(bounds, np.uint64)), [len(keys)]]).astype(np.int64)


def sent(block: int, parts: int, columns: list[np.ndarray], question: int = 0) -> pa.RecordBatch:
    """A row for each range that has keys: (part, block, columns as bytes); the first column is the key, sorted."""
    at = starts_of(columns[0], parts)
    full = np.flatnonzero(at[1:] > at[:-1])
    arrays = [pa.array(full + question * parts, pa.int32()), pa.array(np.full(len(full), block), pa.int64())]
    arrays += [pa.array([c[at[p] : at[p + 1]].tobytes() for p in full], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "block", *(f"c{i}" for i in range(len(columns)))])


def distinct(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of key columns in order, which of them occur twice, and the place of each row among them."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    in_order = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in in_order], axis=0)
    at = np.flatnonzero(new)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return [k[at] for k in in_order], (np.diff(np.append(at, len(order))) > 1).astype(np.uint8), back


def repeats(blocks: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """ALONE, REPEATED or FIRST for each row; columns are the key and, last, whether the block itself has it twice."""
    *keys, twice = columns
    order = np.lexsort((blocks, *keys[::-1]))
    in_order = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in in_order], axis=0)
    at = np.flatnonzero(new)
    total = np.add.reduceat(twice[order].astype(np.int64) + 1, at)
    state = np.repeat(np.where(total > 1, REPEATED, ALONE), np.diff(np.append(at, len(order))))
    state[at[total > 1]] = FIRST
    out = np.empty(len(order), np.uint8)
    out[order] = state
    return out


def answered(asked: DataFrame, name: str, parts: int, judges: tuple[Callable[..., np.ndarray], ...] = (repeats,)) -> DataFrame:
    """(block, name): for each block the answers to its keys, by part; end to end they are in the order of its keys.

    Rows of question q are numbered from q * parts; its judge gets each row's block and the columns, and returns a byte
    for each row.
    """

    def run(table: pa.Table) -> pa.Table:
        raw = [table.column(c).to_pylist() for c in table.column_names[2:]]
        sizes = np.array([len(x) for x in raw[-1]], np.int64)
        columns = [np.frombuffer(b"".join(x), np.uint64) for x in raw[:-1]] + [np.frombuffer(b"".join(raw[-1]), np.uint8)]
        judge = judges[table.column("part")[0].as_py() // parts]
        said = judge(np.repeat(np.asarray(table.column("block")), sizes), *(c for c in columns if len(c))).astype(np.uint8)
        ends = np.cumsum(sizes)
        return pa.table({"part": table.column("part"), "block": table.column("block"), "said": pa.array([said[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())})

    answers = asked.groupBy("part").applyInArrow(run, "part int, block long, said binary")
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "said"))).alias(name))


def parts_for(blocks: DataFrame) -> int:
    """Ranges for these blocks: at least the session's shuffle partitions."""
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count() // RANGE_BLOCKS)


def repeated(blocks: DataFrame, keys_of: Callable[..., tuple[np.ndarray, ...]], name: str, parts: int) -> DataFrame:
    """Adds to each block the answers which of its distinct keys occur at least twice in all blocks.

    ``keys_of`` gets a block's rows and its answers so far, and returns the columns of the key.
    """

    def run(batches):
        for batch in batches:
            for block, rows, said in opened(batch):
                keys, twice, _ = distinct(*keys_of(rows, *said))
                yield sent(block, parts, [*keys, twice])

    n = len(keys_of(pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["text"]), *[np.zeros(0, np.uint8)] * (len(blocks.columns) - 2)))
    asked = blocks.mapInArrow(run, "part int, block long, " + ", ".join(f"c{i} binary" for i in range(n + 1)))
    return blocks.join(answered(asked, name, parts), "block", "left")

"""Substring dedup on bytes, by bucket-pointer refinement of sampled suffixes.

Suffixes are sampled at anchors: the place of the least q-gram within each window of 200 bytes, which is the same place
for equal windows. Rounds then refine their buckets, each by what the last one found, and only what is still open
travels to the next:

1. The initial buckets are the q-grams at the anchors. Buckets with one member are singletons and end there.
2. An anchor stands for a run of windows. Its refined identifier is the pair of its bucket and of the identifier of all
   that the run covers, before and after it. Members that agree with another one are settled with all their windows.
3. In buckets that fall apart, one member for each refined identifier stays open. Its run is cut into cells of 16 windows
   by their place around the anchor. A cell's bucket is what all of its windows have in common, its refined identifier
   the pair of that and of all that they cover; so cells are dropped or settled as anchors were.
4. Cells that fall apart sort their windows on the pair of the identifiers of their first 128 bytes and of their bytes
   from 72 on, which are pairs of identifiers of 64 bytes, which are pairs of those of 32 bytes at later offsets: each
   doubling reuses the last one's.

Identifiers are hashes and not ranks, so a bucket's identifier is the same on each machine without a global order. Those
of runs are two polynomials over the prime field of 2^61 - 1; those of single windows are pairs of mixed hashes of 32
bytes, too short for strings that agree modulo 2^64 at every base.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ALONE, FIRST, answered, blocks_of, distinct, opened, parts_for, repeated, repeats, sent
from .common import slices
from .hashing import BASE, BASE_2, BYTE_CODE, BYTE_CODE_2, FIELD_BASE, FIELD_BASE_2, Field, Prefix, mix

WINDOW, GRAM = 200, 32
#: Windows in a cell.
CELL = 16
#: Bytes of text that are hashed at once: about ten arrays of eight times that size are held.
SLICE = 512 << 10
_C = np.uint64(0xD6E8FEB86659FD93)
_FAMILIES = ((BYTE_CODE, BASE), (BYTE_CODE_2, BASE_2))
_BASES = (FIELD_BASE, FIELD_BASE_2)
#: Bits that hold a place in a slice; the same for all slices, so that equal windows choose equal anchors.
BITS = (SLICE + WINDOW).bit_length()


def pair(ids: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
    """The refined identifiers of places: the identifier there with the one at a later offset."""
    return mix(ids[at] * _C + ids[at + shift])


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place, first and last window, and bucket (the q-gram's identifier, spread once more) of each anchor."""
    grams, n = Prefix(BYTE_CODE[data]).windows(GRAM), len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    tagged = (grams >> np.uint64(BITS)) << np.uint64(BITS) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        tagged, width = np.minimum(tagged[: len(tagged) - width], tagged[width:]), 2 * width
    if width < span:
        tagged = np.minimum(tagged[: len(tagged) - (span - width)], tagged[span - width :])
    least = (tagged & np.uint64((1 << BITS) - 1)).astype(np.int64)[:n]
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    inside = np.flatnonzero(np.arange(n) + WINDOW <= ends)
    of = least[inside]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (inside[1:] != inside[:-1] + 1)
    begin = np.flatnonzero(new)
    place, low = of[begin], inside[begin]
    high = inside[np.append(begin[1:], len(of)) - 1] if len(of) else low
    # An anchor is a minimum, so its hash is small: mixed again, or all would fall into the first ranges.
    return place, low, high, mix(grams[place] ^ _C)


def spread(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low, low + 1, ... (``size`` of them) for each run, end to end."""
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Suffixes:
    """The anchors of a block, and what the rounds so far have found about them."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        found = [anchors_of(data, offsets) for data, offsets, _, _ in self.slices()]
        self.counts = [len(x[0]) for x in found]
        kinds = (np.int64, np.int64, np.int64, np.uint64)
        self.place, self.low, self.high, self.bucket = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, t) for i, t in enumerate(kinds))

    def slices(self):
        return slices(self.texts, SLICE, WINDOW - 1)

    def parts(self):
        """(slice, where its anchors begin and end) for each slice."""
        at = 0
        for piece, n in zip(self.slices(), self.counts, strict=True):
            yield piece, at, at + n
            at += n

    def refine(self, buckets: np.ndarray) -> None:
        """From the answers of the first round: ``live`` are the anchors whose buckets are no singletons."""
        self.live = np.flatnonzero(buckets[distinct(self.bucket)[2]] != ALONE)

    def covers(self) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers, in two halves, of all that the live anchors' windows cover, with their place around the anchor."""
        out = np.empty((2, len(self.live)), np.uint64)
        for (data, *_), a, b in self.parts():
            i, j = np.searchsorted(self.live, [a, b])
            mine = self.live[i:j]
            if len(mine):
                low, high = self.low[mine], self.high[mine]
                shape = ((high - low) * 4096 + (self.place[mine] - low)).astype(np.uint64)
                for k, base in enumerate(_BASES):
                    out[k, i:j] = mix(Field(data, base).of(low, high + WINDOW) * _C + shape)
        return out[0], out[1]

    def settle(self, said: np.ndarray) -> None:
        """From the answers of the second round: the runs of windows that are all repeated, and the cells that stay open."""
        agreed, open_ = settled(said, self.bucket[self.live], *self.covers())
        self.agreed = [(self.live[agreed], self.low[self.live[agreed]], self.high[self.live[agreed]])]
        mine = self.live[open_]
        nearest, farthest = (self.place[mine] - self.high[mine]) // CELL, (self.place[mine] - self.low[mine]) // CELL
        size = farthest - nearest + 1
        self.cell = spread(nearest, size)
        self.at = np.repeat(self.place[mine], size)
        self.first = np.maximum(np.repeat(self.low[mine], size), self.at - CELL * self.cell - (CELL - 1))
        self.last = np.minimum(np.repeat(self.high[mine], size), self.at - CELL * self.cell)
        self.owner = np.repeat(mine, size)

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each open cell the identifier of what its windows have in common, and of all they cover, in two halves."""
        out = np.empty((3, len(self.cell)), np.uint64)
        for (data, *_), a, b in self.parts():
            i, j = np.searchsorted(self.owner, [a, b])
            if i == j:
                continue
            at, first, last, cell = (x[i:j] for x in (self.at, self.first, self.last, self.cell.astype(np.uint64)))
            shape = ((at - first) * 4096 + (at - last)).astype(np.uint64)
            core = at - CELL * self.cell[i:j]
            for k, base in enumerate(_BASES):
                hashes = Field(data, base)
                out[1 + k, i:j] = mix(hashes.of(first, last + WINDOW) * _C + shape)
                if not k:
                    out[0, i:j] = mix(hashes.of(core, core + WINDOW - CELL + 1) * _C + cell)
        return out[0], out[1], out[2]

    def settle_cells(self, said: np.ndarray) -> None:
        """From the answers of the third round: more runs of repeated windows, and the cells whose windows are open."""
        agreed, open_ = settled(said, *self.cells())
        self.agreed.append((self.owner[agreed], self.first[agreed], self.last[agreed]))
        self.sent = np.flatnonzero(open_)

    def open_windows(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the open windows of the anchors from a to b, and their distance to the anchor."""
        mine = self.sent[slice(*np.searchsorted(self.owner[self.sent], [a, b]))]
        size = self.last[mine] - self.first[mine] + 1
        starts = spread(self.first[mine], size)
        return starts, (np.repeat(self.at[mine], size) - starts).astype(np.uint64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers, in two halves, of the open windows."""
        outs = []
        for (data, *_), a, b in self.parts():
            starts, around = self.open_windows(a, b)
            if not len(starts):
                continue
            halves = []
            for code, base in _FAMILIES:
                ids, width = Prefix(code[data], base).windows(GRAM), GRAM
                while 4 * width <= WINDOW:  # all places of the longest doubled strings
                    ids, width = mix(ids[: len(ids) - width] * _C + ids[width:]), 2 * width
                both = pair(ids, starts, width) * _C + pair(ids, starts + WINDOW - 2 * width, width)
                halves.append(mix(both * _C + around))
            outs.append(halves)
        return tuple(np.concatenate([x[k] for x in outs]) if outs else np.zeros(0, np.uint64) for k in (0, 1))

    def gone(self, said: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(document, base, mask) of each piece: which of its bytes a repeated window covers."""
        twice = said[distinct(*self.windows())[2]] != ALONE
        out, at = [], 0
        for (data, offsets, docs, bases), a, b in self.parts():
            starts, _ = self.open_windows(a, b)
            mine = starts[twice[at : at + len(starts)]]
            at += len(starts)
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, mine, 1)
            np.add.at(step, mine + WINDOW, -1)
            for owner, low, high in self.agreed:
                i, j = np.searchsorted(owner, [a, b])
                np.add.at(step, low[i:j], 1)
                np.add.at(step, high[i:j] + WINDOW, -1)
            mask = np.cumsum(step[:-1]) > 0
            out += [(int(d), int(base), mask[x:y]) for d, base, x, y in zip(docs, bases, offsets[:-1], offsets[1:], strict=True)]
        return out


def questions(block: int, parts: int, bucket: np.ndarray, one: np.ndarray, two: np.ndarray):
    """What a block asks of its runs: does their bucket fall apart, and is their refined identifier repeated?"""
    (group,), _, back = distinct(bucket)
    low, high = np.full(len(group), 2**64 - 1, np.uint64), np.zeros(len(group), np.uint64)
    np.minimum.at(low, back, one)
    np.maximum.at(high, back, one)
    yield sent(block, parts, [group, low, high, np.zeros(len(group), np.uint8)])
    (first, second), twice, _ = distinct(one, two)
    yield sent(block, parts, [first, second, np.zeros(0, np.uint64), twice], question=1)


def settled(said: np.ndarray, bucket: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the answers: which runs are repeated as a whole, and which stay open."""
    groups = distinct(bucket)
    apart = said[: len(groups[0][0])][groups[2]] > 0
    same = said[len(groups[0][0]) :][distinct(one, two)[2]]
    return same != ALONE, apart & ((same == ALONE) | (same == FIRST))


def _buckets(rows: pa.RecordBatch) -> tuple[np.ndarray]:
    return (Suffixes(rows.column("text")).bucket,)


def found(rows: pa.RecordBatch, *answers: np.ndarray) -> Suffixes:
    """A block's suffixes after so many rounds."""
    of = Suffixes(rows.column("text"))
    for step, said in zip((of.refine, of.settle, of.settle_cells), answers, strict=False):
        step(said)
    return of


def _windows(rows: pa.RecordBatch, *answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return found(rows, *answers).windows()


def _runs(rows: pa.RecordBatch, *answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of = found(rows, *answers)
    return (of.bucket[of.live], *of.covers()) if len(answers) == 1 else of.cells()


def _apart(blocks: np.ndarray, bucket: np.ndarray, low: np.ndarray, high: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """1 for each row of a bucket whose least and greatest identifiers differ."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    differ = np.minimum.reduceat(low[order], at) != np.maximum.reduceat(high[order], at)
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(differ, np.diff(np.append(at, len(order))))
    return out


def _round(blocks: DataFrame, name: str, parts: int) -> DataFrame:
    """Adds the answers of the second or third round."""

    def ask(batches):
        for batch in batches:
            for block, rows, answers in opened(batch):
                yield from questions(block, parts, *_runs(rows, *answers))

    asked = blocks.mapInArrow(ask, "part int, block long, c0 binary, c1 binary, c2 binary, c3 binary")
    return blocks.join(answered(asked, name, parts, (_apart, repeats)), "block", "left")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept`` (binary): the bytes that no repeated window covers.

    A byte goes if a string of 200 bytes that covers it also starts anywhere else, in the same document or another;
    a match never crosses documents. Null texts are empty; texts below 200 bytes lose nothing; repeated rows lose all
    their windows. A long text is hashed in overlapping pieces, so memory beyond its own few copies is bounded. Columns
    named like the new ones are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    docs = docs.drop(*new).withColumn("text", F.col("text").cast("string"))
    blocks = blocks_of(docs)
    parts = parts_for(blocks)
    blocks = repeated(blocks, _buckets, "buckets", parts)
    blocks = _round(_round(blocks, "runs", parts), "cells", parts)
    blocks = repeated(blocks, _windows, "windows", parts)

    def run(batches):
        for batch in batches:
            for _, rows, (*answers, windows) in opened(batch):
                masks: dict[int, list[tuple[int, np.ndarray]]] = {}
                for d, base, mask in found(rows, *answers).gone(windows):
                    masks.setdefault(d, []).append((base, mask))
                size, removed, spans, kept = [], [], [], []
                for d, value in enumerate(rows.column("text")):
                    raw = np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)
                    gone = np.zeros(len(raw), bool)
                    for base, mask in masks.get(d, []):
                        gone[base : base + len(mask)] |= mask
                    n = int(gone.sum())
                    size.append(len(raw))
                    removed.append(n)
                    spans.append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0]) if n else 0)
                    kept.append(raw[~gone].tobytes() if n else raw.tobytes())
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(kept, pa.binary())], names=[*rows.schema.names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return blocks.mapInArrow(run, f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary")

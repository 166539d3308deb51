"""Substring dedup on words, by difference-cover anchors.

Word places that lie in a difference cover modulo a period are anchors. For any two places there is one shift below the
period that brings both onto the cover, so two equal windows of WINDOW words share an anchor of
WINDOW - PERIOD + 1 words at the same place within them. Anchors that occur twice mark the windows around them, and
those windows are then compared at full length, by two hashes of 61 bits over a prime field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ALONE, blocks_of, distinct, opened, parts_for, repeated
from .common import buffer_of
from .hashing import FIELD_BASE, FIELD_BASE_2, Field, word_bounds, word_hashes

WINDOW, PERIOD = 35, 21
#: Every residue modulo 21 is a difference of two of these (a perfect difference set).
COVER = np.array([0, 1, 4, 14, 16])
ANCHOR = WINDOW - PERIOD + 1
#: Words that are hashed at once.
RUN = 1 << 18

_covered = np.isin(np.arange(PERIOD), COVER)
_BASES = (FIELD_BASE, FIELD_BASE_2)


class Words:
    """The words of a block's texts, and where the anchors and windows of their documents are."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = buffer_of(texts)
        self.starts, self.ends, self.first = word_bounds(self.data, self.offsets)
        self.codes: dict[int, np.ndarray] = {}

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first word, place in its document, words left in it), for so many words at once that begin a window."""
        sizes = np.diff(self.first)
        for begin in range(0, len(self.starts), RUN):
            at = np.arange(begin, min(begin + RUN, len(self.starts)))
            doc = np.searchsorted(self.first, at, side="right") - 1
            place = at - self.first[doc]
            yield begin, place, sizes[doc] - place

    def hashes(self, places: np.ndarray, width: int, family: int = 0) -> np.ndarray:
        """Identifiers of runs of ``width`` words at these (rising) places."""
        if family not in self.codes:
            self.codes[family] = word_hashes(self.data, self.starts, self.ends, base=_BASES[family])
        out = np.empty(len(places), np.uint64)
        for begin in range(0, len(self.starts), RUN):
            i, j = np.searchsorted(places, [begin, begin + RUN])
            if i < j:
                out[i:j] = Field(self.codes[family][begin : begin + RUN + width], _BASES[family]).of(places[i:j] - begin, places[i:j] - begin + width)
        return out

    def anchors(self) -> np.ndarray:
        """Places of the anchors of documents that hold a window."""
        found = [begin + np.flatnonzero(_covered[place % PERIOD] & (left >= ANCHOR) & (place + left >= WINDOW)) for begin, place, left in self.runs()]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def marked(self, said: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a repeated anchor within their first PERIOD places."""
        anchors = self.anchors()
        anchors = anchors[said[distinct(self.hashes(anchors, ANCHOR))[2]] != ALONE]
        step = np.zeros(len(self.starts) + 1, np.int32)
        first = self.first[np.searchsorted(self.first, anchors, side="right") - 1]
        np.add.at(step, np.maximum(first, anchors - PERIOD + 1), 1)
        np.add.at(step, anchors + 1, -1)
        near = np.cumsum(step[:-1]) > 0
        found = [begin + np.flatnonzero(near[begin : begin + len(left)] & (left >= WINDOW)) for begin, _, left in self.runs()]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def windows(self, said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the marked windows and both halves of their identifiers."""
        starts = self.marked(said)
        return starts, self.hashes(starts, WINDOW), self.hashes(starts, WINDOW, 1)

    def gone(self, of_anchors: np.ndarray, of_windows: np.ndarray) -> np.ndarray:
        """Which words a repeated window covers."""
        starts, *keys = self.windows(of_anchors)
        twice = starts[of_windows[distinct(*keys)[2]] != ALONE]
        step = np.zeros(len(self.starts) + WINDOW + 1, np.int32)
        step[twice] += 1
        step[twice + WINDOW] -= 1
        return np.cumsum(step)[: len(self.starts)] > 0


def _anchor_keys(rows: pa.RecordBatch) -> tuple[np.ndarray]:
    words = Words(rows.column("text"))
    return (words.hashes(words.anchors(), ANCHOR),)


def _window_keys(rows: pa.RecordBatch, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return Words(rows.column("text")).windows(said)[1:]


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (its text as string) with n_words, n_removed and ``kept_text``: the kept words, joined by one space.

    A word goes if a window of 35 consecutive words that covers it also starts anywhere else. Null and empty texts, and
    texts of fewer words than a window, lose nothing; an exact repeat of a row loses all its windows. No document ids
    are needed, so nulls or repeats among them change nothing. A long text is hashed piece by piece; a place in memory
    is held for each of its words. Columns named like the new ones are replaced.
    """
    new = ["n_words", "n_removed", "kept_text"]
    docs = docs.drop(*new).withColumn("text", F.col("text").cast("string"))
    # Arrow cannot carry some types (intervals of months, for one) into record batches; plain columns can.
    blocks = blocks_of(docs)
    parts = parts_for(blocks)
    blocks = repeated(blocks, _anchor_keys, "anchors", parts)
    blocks = repeated(blocks, _window_keys, "windows", parts)

    def run(batches):
        for batch in batches:
            for _, rows, (of_anchors, of_windows) in opened(batch):
                words = Words(rows.column("text"))
                gone = words.gone(of_anchors, of_windows)
                kept, lost = [], []
                first = words.first
                for a, b, at, end in zip(first[:-1].tolist(), first[1:].tolist(), words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
                    mine = gone[a:b]
                    n = int(mine.sum())
                    split = words.data[at:end].tobytes().split()
                    kept.append(b" ".join([w for w, g in zip(split, mine.tolist(), strict=True) if not g] if n else split))
                    lost.append(n)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(first), pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*rows.schema.names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return blocks.mapInArrow(run, f"{fields}, n_words long, n_removed long, kept_text string")

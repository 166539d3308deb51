"""Cost-balanced packing of token sequences.

Each task packs the documents of its own partition, in buffers of bounded size, so nothing is shuffled. A sequence's
cost is estimated as linear plus quadratic (attention is within a document's piece). Full stretches of a document
fill sequences of their own; the remainders go, longest first, to the lowest-cost sequence that still has room. What
fits nowhere whole is cut over the room that is left, and what is left at the end of a buffer becomes sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Ordinary

#: Tokens in a full sequence.
CAPACITY = 1024
#: Remainders that a task gathers before it packs them.
BUFFER = 8192
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Entries of the cache of encoded words; it starts anew when full.
CACHE = 400_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A word with the white space before it. Every match of a byte-level split pattern ends where white space follows
#: another character, so such runs encode alone as they do within the text.
#: Texts with white space of other kinds go to the tokenizers library whole.
WORD = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: White space that the libraries or Python see beyond ASCII: with any of it the text is encoded whole.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@lru_cache(maxsize=2)
def merges_of(path: str) -> Ordinary:
    """The same vocabulary for the tiktoken library, which encodes single words many times faster to the same ids."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shown = dict(zip(plain, plain, strict=True)) | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
    back = {chr(c): b for b, c in shown.items()}
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if all(c in back for c in token)}
    special = {token for token in vocab if token.startswith("<|") and token.endswith("|>")}
    return Ordinary({k: v for k, v in ranks.items() if k.decode("latin-1") not in special}, public_tokenizers.PATTERN)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes; words seen before are looked up."""

    def __init__(self, path: str):
        self.library, self.words, self.known = tokenizer(path), merges_of(path), {}

    def direct(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text.isascii() and OTHER_SPACE.search(text):
            return self.direct(text)
        words, known, new = WORD.findall(text), self.known, self.words.encode_ordinary
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            out = []
            for w in words:
                ids = known.get(w)
                if ids is None:
                    ids = array("I", new(w)).tobytes()
                    if len(w) < 64:
                        known[w] = ids
                out.append(ids)
            return b"".join(out)


def cost(length: float) -> float:
    return LINEAR * length + QUADRATIC * length * length


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where remainders (each shorter than a sequence) go: (document, start in it, length, sequence, offset)."""
    total, out = int(lengths.sum()), []
    n = total // capacity  # these are filled to the brim
    room, load = np.full(n, capacity, np.int64), np.zeros(n)
    late = []
    for d in np.argsort(-lengths, kind="stable"):
        size = int(lengths[d])
        if not size:
            continue
        open_ = np.where(room >= size, load, np.inf) if n else np.zeros(0)
        best = int(open_.argmin()) if n else -1
        if n and np.isfinite(open_[best]):
            out.append((int(d), 0, size, best, capacity - int(room[best])))
            room[best] -= size
            load[best] += cost(size)
        else:
            late.append((int(d), size))
    # What fits nowhere whole fills the room that is left, in order of cost.
    order = [int(s) for s in np.lexsort((np.arange(n), load)) if room[s]]
    tail, k = total - n * capacity, 0
    extra, at = n, 0
    sizes = [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if tail & (1 << b)]
    for d, size in late:
        start = 0
        while size:
            if k < len(order):
                s = order[k]
                part, offset = min(size, int(room[s])), capacity - int(room[s])
                room[s] -= part
                k += not room[s]
            else:
                s = extra
                part, offset = min(size, sizes[s - n] - at), at
                at += part
                if at == sizes[s - n]:
                    extra, at = extra + 1, 0
            out.append((d, start, part, s, offset))
            start, size = start + part, size - part
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, buffer: int = BUFFER) -> DataFrame:
    """A row for each piece of each document's ids (its text's ids, then 0): where it stands in which sequence.

    Control strings such as ``<|endoftext|>`` in a text are ordinary text, as the vocabulary's own description reads texts
    (``encode_special_tokens``): a document must not be able to end itself with a control id.

    Null and empty texts are the single id 0. Repeated rows are packed each for itself. Sequence ids hold the number
    of the partition in their upper half, so they are unique and come out the same when a task is run again.
    """

    def run(batches):
        encode, where = Encoder(tokenizer_path), TaskContext.get().partitionId() << 32
        used, end = 0, np.zeros(1, "<u4").tobytes()
        whole: list[tuple] = []
        rest: list[tuple] = []

        def flush():
            nonlocal used, whole, rest
            rows, whole = whole, []
            lengths = np.array([len(ids) // 4 for _, _, ids, _ in rest], np.int64)
            top = 0
            for d, start, length, sequence, offset in place(lengths, capacity) if rest else []:
                doc, first, ids, total = rest[d]
                rows.append((doc, first + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, where + used + sequence, offset))
                top = max(top, sequence + 1)
            used, rest = used + top, []
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(value.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n - capacity + 1, capacity):
                    whole.append((doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), n, where + used, 0))
                    used += 1
                if n % capacity:
                    rest.append((doc, n - n % capacity, ids[4 * (n - n % capacity) :], n))
                if len(rest) >= buffer or len(whole) >= 8 * buffer:
                    yield flush()
        yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)

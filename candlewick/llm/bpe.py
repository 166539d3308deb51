"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at places where every match of the split pattern ends anyway, so that the pieces encode to the
same ids as the whole. Ids go back to raw bytes, never through a lossy string.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a piece should have at least; it ends at the first safe boundary after them.
PIECE_CHARS = 1 << 15

#: A boundary is safe between a character that is surely no white space and an ASCII space or line feed: no alternative
#: of the pattern holds white space after another character, and the look-ahead for white space only looks forward.
#: It is safe between a letter or digit and what is neither (no match holds a letter before a mark or a digit), and, for
#: scripts without spaces, after ideographic punctuation before a letter or digit.
SAFE = re.compile(
    "[A-Za-z0-9.,;:!?)\\]}À-ɏͰ-ԯぁ-ヾ一-鿿](?=[ \n])|[。！，？](?=[0-9A-Za-z一-鿿])"
    "|[A-Za-zÀ-ÖØ-öø-ʯА-яא-תا-غぁ-ゖァ-ヺ一-鿿가-힣](?=[0-9,.;:!?()\"-])|[0-9](?=[A-Za-z,.;:!?()\"-])"
)
#: White space as the pattern's \s has it (fixed values), and so much of it that the library's look-ahead runs out of stack
#: at some hundred thousand characters.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACE = re.compile(f"[{SPACE}]{{4096,}}")


class Ordinary(tiktoken.Encoding):
    """The tiktoken library on texts of any form, without special tokens.

    The split pattern takes a run of white space whole at the end of a text, and else all of it but the last character.
    Runs too long for its look-ahead are cut so here and encoded as the one match that they are.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.match = tiktoken.Encoding("match", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def encode_ordinary(self, text: str) -> list[int]:
        if len(text) < 4096:
            return super().encode_ordinary(text)
        at, out = 0, []
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += super().encode_ordinary(text[at : run.start()])
            out += self.match.encode_ordinary(text[run.start() : end])
            at = end
        return out + super().encode_ordinary(text[at:])


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> Ordinary:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Ordinary(ranks, pattern)


def split_safely(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of a text, each ending at a safe boundary; one without any stays whole."""
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, tokens): the ids of each text, a row for each piece of it; null and empty texts give one empty row."""

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, piece in enumerate(split_safely(text.as_py() or "")):
                    ids = enc.encode_ordinary(piece)
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([k], pa.int32()), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "piece", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, tokens array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``data`` (binary): the raw bytes of each row's ``tokens``."""
    names = tokens.columns

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            data = [enc.decode_bytes(ids.as_py() or []) for ids in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*names, "data"])

    return tokens.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in tokens.schema)}, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of each text, piece by piece in bounded memory.

    Null and empty texts have no tokens and the digests of the empty string; repeated rows each give a row.
    """

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column("text"):
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for piece in split_safely(value.as_py() or ""):
                    ids = enc.encode_ordinary(piece)
                    if ids:
                        a.update((("," if n else "") + ",".join(map(str, ids))).encode())
                        b.update(enc.decode_bytes(ids))
                        n += len(ids)
                counts.append(n)
                of_ids.append(a.hexdigest())
                of_bytes.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

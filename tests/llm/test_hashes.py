"""Hashes of structured strings: Thue-Morse words and their mirrors agree under every polynomial modulo a power of two."""

import numpy as np
import pytest
from candlewick.llm import hashing, minhash, substrings, suffixes
from pyspark.sql import functions as F

MIRROR = str.maketrans("ab", "ba")


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(MIRROR)
    return s[:n]


def test_field_equals_plain_arithmetic():
    rng, p = np.random.default_rng(1), int(hashing.P61)
    a, b = (rng.integers(0, p, 500, dtype=np.uint64) for _ in range(2))
    a[:2], b[:2] = p - 1, p - 1
    assert hashing.times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]
    for data in (rng.integers(0, 256, 900, dtype=np.uint8), rng.integers(0, 2**64, 900, dtype=np.uint64)):
        codes = [int(c) + 1 for c in data] if data.dtype == np.uint8 else [int(c) for c in data]
        start, end = np.array([0, 5, 899]), np.array([900, 205, 899])
        want = [sum(c * pow(hashing.FIELD_BASE, k, p) for k, c in enumerate(codes[x:y])) % p for x, y in zip(start, end, strict=True)]
        assert hashing.Field(data).of(start, end).tolist() == hashing.mix(np.array(want, np.uint64)).tolist()
    with pytest.raises(ValueError, match="pieces"):
        hashing.Field(np.zeros(hashing.FIELD_RUN + 1, np.uint8))


def test_words_longer_than_a_run(monkeypatch):
    text = (b"x" * 300 + b" " + bytes(range(65, 91)) * 40 + b" y ") * 3
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = hashing.word_bounds(data, np.array([0, len(data)]))
    whole = hashing.word_hashes(data, starts, ends, lower=True)
    monkeypatch.setattr(hashing, "WORD_RUN", 64)
    hashing_of = hashing.word_hashes(data, starts, ends, lower=True)
    assert hashing_of.tolist() == whole.tolist() and len(set(whole.tolist())) == 3


@pytest.mark.parametrize("power", range(7, 13))
def test_mirrored_words_are_different_words(spark, power):
    """As words within 35-word windows (6), as one-word texts (1) and as byte strings (4)."""
    t = thue_morse(2**power)
    m = t.translate(MIRROR)
    around = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(0, f"{t} {around}"), (1, f"{m} {around}"), (2, t), (3, m)], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(docs).collect()}
    assert removed == {0: 0, 1: 0, 2: 0, 3: 0}
    linked = {r["doc_id"]: r["component_id"] for r in minhash.link(docs.filter("doc_id > 1")).collect()}
    assert linked == {2: 2, 3: 3}
    if power in (9, 12):
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        seen = {}
        for d, x in texts.items():
            for i in range(len(x) - 199):
                seen.setdefault(x[i : i + 200], []).append((d, i))
        for r in suffixes.dedup(docs).select("doc_id", "n_removed", F.col("kept").cast("string").alias("kept")).collect():
            gone = set()
            for places in seen.values():
                if len(places) > 1:
                    gone.update(k for d, i in places if d == r["doc_id"] for k in range(i, i + 200))
            assert r["n_removed"] == len(gone)
            assert r["kept"] == "".join(c for k, c in enumerate(texts[r["doc_id"]]) if k not in gone)

"""Text operators against brute force on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from candlewick.llm import beta, blocks, bpe, chat, components, fingerprints, hashing, minhash, packing, pii, quality, substrings, suffixes, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120, seed=3):
    """Texts with exact and near copies, shared passages, nulls, blanks and odd characters."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", "", ".", ",\n"]) for _ in range(k))
    passage, rows = prose(60), []
    for i in range(n):
        kind = i % 10
        if kind == 0 and rows:
            t = rng.choice(rows)[1]
        elif kind == 1 and rows:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        elif kind == 2:
            t = prose(rng.randint(0, 50)) + " " + passage + " " + prose(rng.randint(0, 50))
        else:
            t = prose(rng.randint(1, 200))
        rows.append((i, t))
    odd = [None, "", " \n\t ", "a", "a b", "A B c", "😀 é\u3000x", "x" * 700, "x" * 650, "one two " * 90]
    rows += [(n + i, t) for i, t in enumerate(odd)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, f"src{i % 3}", "clash", 1) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(5).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingles(t):
    w = WORD.findall(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(sets):
    inverse, up = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            inverse[x].append(i)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    both = Counter((b, a) for own in inverse.values() for k, a in enumerate(own) for b in own[:k])
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: top(i) for i in sets}


def test_minhash_equals_brute_force(docs, rows):
    sets = {i: shingles(t or "") for i, t in rows}
    want, got = classes(sets), by_id(minhash.link(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_minhash_large_group_of_edited_copies(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 3, 8, 15])):
            w[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    want = classes({i: shingles(t) for i, t in rows})
    got = by_id(minhash.link(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_minhash_repeated_and_null_ids(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.link(df).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("None", None, True)]
    assert minhash.link(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_bpe_round_trip(docs, rows):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoding(path, P.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    for i, r in by_id(bpe.round_trip(docs, path, P.PATTERN)).items():
        t = dict(rows)[i] or ""
        ids = enc.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    pieces = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).orderBy("doc_id", "piece").collect()
    joined = defaultdict(bytes)
    for r in pieces:
        joined[r["doc_id"]] += bytes(r["data"])
    assert joined == {i: (t or "").encode() for i, t in rows}


def test_bpe_pieces_encode_like_the_whole():
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for t in ["it's  a\n\n test, don't! " * 50, "中文。字，字！" * 60, "a\u3000 b \x1c c" * 40, "x" * 900, " \n " * 300]:
        cut = [i for p in bpe.split_safely(t, 37) for i in enc.encode_ordinary(p)]
        assert cut == enc.encode_ordinary(t) and "".join(bpe.split_safely(t, 37)) == t


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    pieces, seq = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, P.path("byte_bpe_50k.json")).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    for of, total in ((pieces, {i: len(x) for i, x in ids.items()}), (seq, None)):
        for k, parts in of.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            assert at == total[k] if total else at <= 1024
    lengths = [sum(x for _, x in p) for p in seq.values()]
    padding = sum(1024 - x for x in lengths if x & (x - 1))
    assert padding == 0


def test_packing_balances_cost():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1024, 300)
    load = Counter()
    for _, _, size, s, _ in packing.place(lengths):
        load[s] += packing.cost(size)
    full = [v for s, v in load.items() if s < lengths.sum() // 1024]
    assert max(full) < 1.6 * np.mean(full)


def test_word_encoder_equals_the_library():
    e = packing.Encoder(P.path("byte_bpe_50k.json"))
    for t in ["a\n\n b  c\t\td \n", "  x", "it's  don't 's", "<|endoftext|> hi<|endoftext|>", "a\xa0b c\u3000d", "中文。字 abc", "x" * 300, " \n \n", "\x1c\x1d a \x85b", ""]:
        assert e(t) == e.direct(t), t


def fuzz(rng, n):
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\xa0", "\u3000", "\u2009", "\x85", "\x1c", "a", "Zx", "é", "ß", "中", "。", "字", "7", "½", "'s", "'ll", "'", ".", ",!", "-", "_", "😀", "\u0301", "\u200b", "<|", "ท", "한"]
    return ["".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_both_encoders_equal_their_libraries_on_odd_texts():
    texts = fuzz(random.Random(6), 10_000)
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    own, word = bpe.encoding(ranks, P.PATTERN), packing.Encoder(P.path("byte_bpe_50k.json"))
    library = word.library.encode_batch(texts, add_special_tokens=False)
    for t, ids in zip(texts, library, strict=True):
        pieces = list(bpe.split_safely(t, 5))
        assert "".join(pieces) == t and [i for p in pieces for i in own.encode_ordinary(p)] == tiktoken.Encoding.encode_ordinary(own, t), repr(t)
        assert word(t) == np.asarray(ids.ids, "<u4").tobytes(), repr(t)


@pytest.mark.parametrize("run", [" ", "\n", "x", "\u0301", "\u3000", " \t\n"])
def test_encoders_take_long_runs(run):
    own, word = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), packing.Encoder(P.path("byte_bpe_50k.json"))
    for before, after in (("", ""), ("ab", "cd"), ("ab ", " 's"), ("", ".")):
        t = before + run * 60_000 + after  # the libraries can still take it
        assert [i for p in bpe.split_safely(t) for i in own.encode_ordinary(p)] == tiktoken.Encoding.encode_ordinary(own, t)
        assert word(t) == word.direct(t)
    t = "ab" + run * 3_000_000 + "cd"
    assert own.decode_bytes([i for p in bpe.split_safely(t) for i in own.encode_ordinary(p)]).decode() == t
    assert len(word(t)) > 4 * 100_000


def test_encoders_on_small_tables(spark):
    rows = [(1, None), (1, None), (2, "a b"), (2, "a b"), (None, ""), (3, "word " * 4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, bpe.round_trip(table, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()), key=str)
    assert len(got) == 6 and len({r for r in got if r[0] == 2}) == 1
    pieces = packing.pack(table, P.path("byte_bpe_50k.json")).collect()
    assert sum(r["length"] for r in pieces) == 2 * 1 + 2 * 3 + 1 + 4002 and max(r["length"] for r in pieces) == 1024
    empty = table.limit(0)
    assert bpe.round_trip(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0 == packing.pack(empty, P.path("byte_bpe_50k.json")).count()


def test_substrings(docs, rows):
    count, words = Counter(), {}
    for i, t in rows:
        words[i] = WORD.findall(t or "")
        count.update(tuple(words[i][k : k + 35]) for k in range(len(words[i]) - 34))
    got = by_id(substrings.dedup(docs))
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
        assert r["lang"] == "clash"
    assert any(r["n_removed"] for r in got.values())
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_cover_is_a_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_suffixes(docs, rows):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    got = by_id(suffixes.dedup(docs))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    assert suffixes.dedup(docs.limit(0)).count() == 0


def test_ranges_cover_all_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    at = blocks.starts_of(keys, 7)
    assert at[0] == 0 and at[-1] == 1000 and (np.diff(at) >= 0).all()


def test_anchor_buckets_fill_ranges_evenly():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    found = suffixes.Suffixes(pa.array([text]))
    sizes = np.diff(blocks.starts_of(np.sort(found.bucket), 16))
    assert sizes.sum() > 3000 and sizes.max() < 2 * sizes.mean()


def test_repeats_name_one_first():
    of = np.array([5, 3, 9, 3, 5], np.int64)
    one, two = (np.array(x, np.uint64) for x in ([7, 7, 7, 8, 9], [1, 1, 2, 1, 1]))
    assert blocks.repeats(of, one, two, np.array([0, 0, 0, 0, 1], np.uint8)).tolist() == [blocks.REPEATED, blocks.FIRST, blocks.ALONE, blocks.ALONE, blocks.FIRST]


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    same = noise(900)
    limit = suffixes.SLICE
    long = noise(limit - 400) + same + noise(limit - 800) + same[:450] + noise(3000) + "z" * 1500
    rows = [(1, long), (2, noise(50) + same + noise(70)), (3, "w" * 700_000), (4, same)]
    got = by_id(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    seen, gone = {}, {i: np.zeros(len(t), bool) for i, t in rows}
    for i, t in rows:
        for k in range(0 if i != 3 else len(t) - 300, len(t) - 199):
            seen.setdefault(hash(t[k : k + 200]), []).append((i, k))
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i][k : k + 200] = True
    gone[3][:] = True
    for i, t in rows:
        kept = "".join(c for c, g in zip(t, gone[i].tolist(), strict=True) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept"].decode()) == (len(t), int(gone[i].sum()), kept), i
    monkeypatch.setattr(hashing, "WORD_RUN", 64)
    monkeypatch.setattr(substrings, "RUN", 50)
    text = " ".join(noise(rng.choice([1, 5, 300])).replace(" ", "x") for _ in range(400))
    small = substrings.Words(pa.array([text, "", text[:900]]))
    at = np.arange(0, 300, 7)
    pieced = [small.hashes(at, 35, k) for k in (0, 1)]
    anchors = small.anchors()
    monkeypatch.undo()
    whole = substrings.Words(pa.array([text, "", text[:900]]))
    assert all((a == whole.hashes(at, 35, k)).all() for k, a in enumerate(pieced)) and (anchors == whole.anchors()).all()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def ok(kind, v):
        digits = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            s = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and s % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    return sorted((m.start(), k, kind, m.end()) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], t) if ok(kind, m.group()))


PRIVATE = [
    "", None, "a@b.c_d@e.f x@y.z.@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 0255.0.0.1", "+1 (310) 555-4510 tel +49-30-1234567 --", "4444 3333 2222 1111 0", "é😀 x.y+z@mail-1.example.com, 10.0.0.1é", "a" * 3000 + "@b.c",
    "+1" + " ." * 200 + "2", "4716 5953 0138 3524 123.4.5.6", "user.@-.-.a", "@@a@b.c", "1.1.1.1@b.c 5.5.5.5.5", "+123456789 +12345678 +1234567890123456",
]


def test_pii_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    for i, r in by_id(pii.digest(df)).items():
        want = base_spans(PRIVATE[i] or "")
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[2] == k for s in want) for k in BASE)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["spans"] == text


def test_pii_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"Some text here. Write to contact id: user{i}@mail.example.com today") for i in range(12)] + [(50, "Some more. Write to contact id: AB-77401 today"), (51, "the order AB-77402 came")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pii.digest(df))
    assert got[50]["spans"] == "id:32:40" and got[51]["spans"] == ""
    masked = by_id(pii.redact(df))
    assert masked[50]["text"] == "Some more. Write to contact id: [ID] today" and masked[51]["text"] == rows[-1][1] and "[EMAIL]" in masked[3]["text"]
    assert pii.digest(df.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be <|end|> nice \\"), (1, 1, "user", "hi <|turn|>x<|text|>"), (1, 2, "assistant", "a\\<|b"), (1, 3, "assistant", ""), (1, 4, "user", None), (2, 0, "user", "only"), (None, 0, None, "z"), (3, 1, "assistant", "<"), (3, 1, "assistant", "<"), (3, 0, "us<|text|>er", "|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat.expand(df)
    for r in chat.digests(ex).collect():
        own = sorted([(t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]])
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = [r for r in ex.collect() if r["conv_id"] == 1]
    assert [r["target"] for r in sorted(one, key=lambda r: r["example"])] == [2, 3, None]


def test_quality(docs, rows):
    got = by_id(quality.judge(docs))
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert r["kept"] <= (not r["base_failed"])


def test_quality_rejects_a_host_of_junk(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, "junk", "bad") for i in range(300)] + [(2000, good, "bad"), (2001, good, None)]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not got[2000]["kept"] and got[2001]["kept"] and all(got[i]["kept"] for i in range(200))


def test_urls(spark):
    url = ["http://A.example.NET/en/x?y", "https://example.net/fr/", "ftp://x.net", "http://b.com/de/", "http://m.example.com/de/1#t", "x.org/fr/", None, "http://Z.org/fr/é", "http://notexample.com/de/", "a://b://c/d", "http://h.net?/en/"]
    pages = spark.createDataFrame(list(enumerate(url)), "page_id long, url string")
    labels = spark.createDataFrame([(1, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, labels).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/fr/", "net/", "block"), 2: ("x.net", "", None, "allow"), 3: ("b.com", "/de/", None, "allow"), 4: ("m.example.com", "/de/1", "example.com/de/", "block"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("z.org", "/fr/é", "org/fr/", "allow"), 8: ("notexample.com", "/de/", None, "allow"), 9: ("b:", "//c/d", None, "allow"), 10: ("h.net", "", None, "allow"),
    }


def test_url_reputation(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'ok'}.site.xyz/p{i}") for i in range(120)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels).collect()}
    assert got[1] == "block" and got[61] == "allow"


def test_fingerprints(docs, rows):
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    got = by_id(fingerprints.compare(docs))
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        c = len(t) // 3
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - c] + after[:c]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = defaultdict(set)
    for i, t in rows:
        same[t or ""].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    long = [got[i]["near_edited"] for i, t in rows if len((t or "").split()) > 60]
    assert sum(long) / len(long) > 0.3


def test_next_row_with_sparse_ids(spark):
    ids = [5, -(2**63), 2**62, 2**62 - 1, 1 << 40, 0, 1023, 1024, 10**15]
    got = by_id(fingerprints.with_next(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string"), "doc_id", ["text"]))
    order = sorted(ids, reverse=True)
    assert {i: r["next_text"] for i, r in got.items()} == {a: str(b) for a, b in zip(order, [*order[1:], order[0]], strict=True)}


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    secret = " write me@mail.example.com or +1 (310) 555-4510 from 10.1.2.3 with 4716595301383524 "
    rows = [(i, t if t is None or i % 7 else t + secret, "en", f"src{i % 3}", len(t or "")) for i, t in corpus(90, seed=11)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {i: t for i, t, *_ in rows}

    def good(t):
        w = WORD.findall(t or "")
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        return len(w) >= 50 and 100 * len(rep) <= 50 * len(w)

    kept = {i: t for i, t in texts.items() if good(t)}  # no host fails nearly always here
    top = classes({i: shingles(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if top[i] == i}
    count = Counter(tuple(w[k : k + 35]) for t in kept.values() for w in [WORD.findall(t)] for k in range(len(w) - 34))
    for i, t in kept.items():
        w = WORD.findall(t)
        gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
        out, at = "", 0
        for a, _, kind, b in base_spans(kept[i]):
            if a >= at:
                out += kept[i][at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        kept[i] = out + kept[i][at:]
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    want = {i: zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in kept.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(want)
    for r in pieces:
        if r["start"] == 0 and r["length"] == r["doc_tokens"]:
            assert r["ids_crc32"] == want[r["doc_id"]]
    assert any("[EMAIL]" in t and "[PHONE]" in t and "[IP]" in t for t in kept.values())


def test_packed_pairs_compare_in_blocks(spark, monkeypatch):
    """Blocks smaller than a cluster give the same components."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 5, 9])):
            w[rng.randrange(100)] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    want = classes({i: shingles(t) for i, t in rows})
    assert {i: r["component_id"] for i, r in by_id(minhash.link(spark.createDataFrame(rows, "doc_id long, text string"))).items()} == want


def test_near_dedup_repeated_and_null_ids(spark):
    """Different texts of one id stay, near copies without an id go, blank rows stay and link nothing."""
    import corpus_pipeline

    def words(c):
        return " ".join(f"{c}{k}" for k in range(60))

    one, two, three, four = words("a"), words("b"), words("c"), words("d")
    rows = [(1, one), (1, two), (1, one), (None, one + " x"), (None, three), (None, three + " y"), (7, four), (3, four + " z"), (3, four + " z"), (5, None), (5, None), (None, " \n")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    c = next(t for i, t in got if i == "None" and t.startswith("c"))
    assert c in (three, three + " y")
    assert got == sorted([("1", one), ("1", two), ("None", c), ("3", four + " z"), ("5", "None"), ("5", "None"), ("None", " \n")])


def test_minhash_blank_rows_of_repeated_ids_link_nothing(spark):
    """Two ids that share an index key and each have a blank row besides are not near copies of each other."""
    assert not minhash.similar([np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.array([1], np.uint64)])[0, 1]
    pairs = spark.createDataFrame([(1, 2)], "u long, v long")
    texts = spark.createDataFrame([(1, "a b c d e f"), (1, " "), (2, "g h i j k l"), (2, None)], "node long, text string")
    assert minhash.confirmed(pairs, texts).count() == 0


def test_fingerprints_of_three_words_are_not_empty(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(3))) for i in range(40)] + [(40, None)]
    got = by_id(fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(got[i]["fingerprint"] and got[i]["near_next"] == 0 for i in range(40)) and got[40]["fingerprint"] == ""
    assert len({got[i]["fingerprint"] for i in range(40)}) == 40


def test_anchors_align_a_passage_shared_by_long_texts(spark):
    """All anchors of a shared passage agree at its shift, however long the texts are."""
    prose = lambda c, k: " ".join(f"{c}{i}" for i in range(k))
    shared = prose("s", 30)
    rows = [(1, prose("a", 3000) + " " + shared), (2, prose("b", 500) + " " + shared + " " + prose("c", 4000)), (3, None), (4, "x y z")]
    marks = fingerprints.placed(spark.createDataFrame(rows, "doc_id long, text string"))
    own = {r["place"] for r in marks.filter("doc_id = 1").collect()}
    (r,) = fingerprints.aligned(marks.filter("doc_id = 1"), marks.filter("doc_id = 2")).collect()
    inside = [p for p in own if 3000 <= p <= 3027]
    assert (r["shift"], r["n_anchors"], r["left_from"], r["left_to"]) == (2500, len(inside), min(inside), max(inside))
    assert marks.filter("doc_id = 3").count() == 0 and marks.filter("doc_id = 4").count() == 1


def test_beta_quantiles(spark):
    rng = np.random.default_rng(5)
    shapes = [(2.0, 5.0), (0.7, 9.0), (400.0, 600.0), (31.0, 3.0), (1.0, 1.0)]
    got = spark.createDataFrame(shapes, "a double, b double").select("a", "b", *(beta.quantile(F.col("a"), F.col("b"), q).alias(f"q{k}") for k, q in enumerate((0.05, 0.5, 0.95)))).collect()
    for r in got:
        draws = np.quantile(rng.beta(r["a"], r["b"], 400_000), (0.05, 0.5, 0.95))
        assert np.abs(np.array([r["q0"], r["q1"], r["q2"]]) - draws).max() < 0.004, r


def test_strength_finds_the_spread_of_hosts(spark):
    rng = np.random.default_rng(7)
    rates = rng.beta(3.0, 7.0, 4000)
    rows = [(50, int(rng.binomial(50, p)), 0.3) for p in rates]
    k = spark.createDataFrame(rows, "n long, b long, m double").agg(beta.strength(F.col("n"), F.col("b"), F.col("m"))).first()[0]
    assert 9 < k < 11
    alike = spark.createDataFrame([(50, 15, 0.3)] * 9, "n long, b long, m double").agg(beta.strength(F.col("n"), F.col("b"), F.col("m"))).first()[0]
    assert alike == beta.MOST


def quality_rows():
    good = " ".join(f"word{i}" for i in range(60))
    noisy = " ".join(f"word{i} ###" for i in range(60))
    rows = []
    for host, n, n_noisy in (("clean", 400, 1), ("plain", 400, 120), ("junk", 100, 0), (None, 40, 12)):
        for i in range(n):
            rows.append((len(rows), noisy if i < n_noisy else ("short" if host == "junk" and i else good + f" {host} {i}"), host))
    return rows + [(0, None, "clean"), (0, "", "clean"), (None, good, "one"), (None, good, "one")]


def test_hosts_decide_on_soft_failures_and_junk(spark):
    rows = quality_rows()
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit(7))).collect()
    assert len(got) == len(rows)
    of = defaultdict(list)
    for r in got:
        of[r["source"], bool(r["base_failed"]), bool(r["soft_failed"])].append(r["kept"])
    assert all(of["clean", False, True]) and all(of["clean", False, False])  # forgiven on a host that is cleaner than the rest
    assert not any(of["plain", False, True]) and all(of["plain", False, False]) and not any(of[None, False, True]) and all(of[None, False, False])
    assert len(of["junk", False, False]) == 1 and not any(of["junk", False, False])  # a good text on a host of junk
    assert len(of["one", False, False]) == 2 and not any(of["clean", True, False])
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_hosts_that_are_credibly_worse_are_blocked(spark):
    pages, labels = [], []
    for host, n, bad in (("bad.example.org", 80, 70), ("ok.example.org", 80, 10), ("a.fine.com", 200, 20), ("b.fine.com", 60, 7), ("few.fine.com", 2, 2)):
        for i in range(n):
            pages.append((len(pages), f"http://{host}/p{i}"))
            labels.append((len(labels), int(i >= bad), 0))
    pages += [(900, None), (901, "no scheme"), (902, "http://bad.example.org/x"), (902, "http://bad.example.org/y"), (903, "x://BAD.example.org?q://z/"), (904, "http://bad.example.org/fr/")]
    labels += [(0, None, 1), (1, 0, None), (150, 0, 0), (150, 1, 0)]  # nulls count for nothing; of two labels the worse
    p = spark.createDataFrame(pages, "page_id long, url string")
    got = urls.judge(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    by = defaultdict(set)
    for r in got:
        by[r["host"]].add((r["verdict"], r["rule"]))
    assert len(got) == len(pages) and by["bad.example.org"] == {("block", None), ("allow", "org/fr/")}
    assert all(by[h] == {("allow", None)} for h in ("ok.example.org", "a.fine.com", "b.fine.com", "few.fine.com", ""))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["verdict"] for r in urls.judge(p, none).collect()} == {"allow"} and urls.judge(p.limit(0), none).count() == 0


def brute_anchors(h2, words):
    """(k-mer, place) of the closed syncmers, with the inner hashes taken from Spark."""
    n = len(words)
    inner = [h2[words[i], words[i + 1]] for i in range(n - 1)]
    out = [(tuple(words[i : i + 8]), i) for i in range(n - 7) if min(inner[i], inner[i + 6]) <= min(inner[i + 1 : i + 6])]
    return out or ([(tuple(words), 0)] if words else [])


def brute_likeness(a, b):
    a, b = ({k: p for k, p in reversed(x)} for x in (a, b))
    if not a and not b:
        return 1.0
    shifts = Counter(b[k] - a[k] for k in a if k in b)
    few = min(len(a), len(b)) <= 1
    return sum(c for c in shifts.values() if c > 1 or few) / len(a.keys() | b.keys())


def test_fingerprints_equal_brute_force(spark):
    rows = corpus(60, seed=21) + [(900, "a b c d e f g h"), (901, "a b c d e f g h i j"), (None, "x y " * 30), (None, None), (900, "again a b c")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.compare(table).collect()
    assert len(got) == len(rows)
    pairs = {tuple(p) for _, t in rows for w in [WORD.findall(t or "")] for p in zip(w, w[1:], strict=False)}
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[i].append(t or "")
    edited = {}
    order = sorted(((i, t or "") for i, t in rows if i not in (None, 900)), reverse=True)
    for k, (i, t) in enumerate(order):
        if 0 < i < 900 and k + 1 < len(order):
            after = order[k + 1][1]
            edited[i] = (t, t[: len(t) - len(t) // 3] + after[: len(t) // 3], after)
            pairs |= {p for w in [WORD.findall(edited[i][1])] for p in zip(w, w[1:], strict=False)}
    listed = [(a, b) for a, b in pairs]
    hashed = spark.createDataFrame(listed, "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()
    h2 = {(r["a"], r["b"]): r["h"] for r in hashed}
    seen = 0
    for r in got:
        if r["doc_id"] not in edited:
            continue
        mine, changed, after = (brute_anchors(h2, WORD.findall(t)) for t in edited[r["doc_id"]])
        first = {k: p for k, p in reversed(mine)}
        assert sorted(first.values()) == sorted(int(x.split(":")[1]) for x in r["fingerprint"].split(",") if x)
        assert r["near_edited"] == pytest.approx(brute_likeness(mine, changed)) and r["near_next"] == pytest.approx(brute_likeness(mine, after))
        seen += r["near_edited"] > 0.2
    assert seen > 10
    assert fingerprints.compare(table.limit(0)).count() == 0
    many = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    linked = fingerprints.with_next(many, "doc_id", ["text"]).collect()
    after = {r["text"]: r["next_text"] for r in linked}
    at, steps = "t 0", 0
    while steps == 0 or at != "t 0":
        at, steps = after[at], steps + 1
    assert steps == 3000  # one ring over all rows


def test_repeated_words_of_clashing_and_long_texts(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (2, 3, 40, 200)] + [" ".join(f"w{rng.randrange(300)}" for _ in range(3000)), "a b c " * 9, "x"]
    table = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    words = quality.word_array(F.col("text"))

    def brute(t):
        w = t.split()
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        return len({k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)})

    got = {r["doc_id"]: r for r in table.select("doc_id", quality._repeat_words(words).alias("packed"), F.when(F.size(words) > 2, quality._repeat_words_long(words)).alias("long")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["packed"] == brute(t) and got[i]["long"] in (brute(t), None)
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # every window shares its bits
    clash = {r["doc_id"]: r["packed"] for r in table.select("doc_id", quality._repeat_words(words).alias("packed")).collect()}
    assert clash[3] is None and clash[6] == 0


def test_pipeline_stages_take_any_rows(spark):
    import corpus_pipeline

    long = " ".join(f"token{i}" for i in range(80))
    rows = [(1, long, "en", "a", 3), (1, long, "en", "a", 3), (1, long + " more of it", "en", None, 3), (None, long, None, "a", None), (None, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n ", "en", "", 2), (4, "write me@mail.example.com " + " ".join(f"other{i}" for i in range(60)), "de", "b", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame(rows, schema)
    # Columns of names that the operators use themselves.
    clash = table.withColumns({n: F.lit("mine") for n in ("kept", "n_words", "n_removed", "kept_text", "spans", "base", "component_id", "text_hash", "host_rate", "_h", "_k", "_i")})
    sizes = {"quality": 5, "near_dedup": 5, "substring_dedup": 8, "pii": 8}
    for name, stage in corpus_pipeline.STAGES:
        for docs in (table, clash):
            out = stage(spark, docs, "")
            if name == "packing":
                assert out.groupBy("doc_id").count().count() == 5 and out.agg(F.sum("length")).first()[0] > 300
                continue
            assert out.columns == corpus_pipeline.COLUMNS and out.count() == sizes[name], name
        empty = stage(spark, table.limit(0), "")
        assert empty.count() == 0 and (name == "packing" or empty.columns == corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.near_dedup(spark, table, "").filter("text LIKE 'token0%'").collect()
    assert len(kept) == 1 and kept[0]["doc_id"] == 1
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, table, "").collect()}
    assert masked[4].startswith("write [EMAIL] other0") and masked[2] == ""


def test_contexts_find_what_no_expression_knows(spark):
    rng = random.Random(31)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    rows = [(i, f'some {rng.choice("abc")} prose with token = "{hexa(40)}" and more') for i in range(12)]
    rows += [(20, 'here the token = "odd-shape_77X" is found'), (21, f"a bare {hexa(40)} marks nothing"), (22, "the version = v2024beta stays")]
    rows += [(i, f"write to mail of user{i}@mail.example.com; case number QX-{i}77 open") for i in range(30, 40)]
    rows += [(50, None), (51, ""), (52, 'token = "' + "z9" * 400 + '" ends'), (53, " ".join(f"1.2.3.{i % 250}" for i in range(3000)))]
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["spans"].startswith("id:") and got[i]["n_spans"] == 1 for i in range(12))
    assert got[20]["spans"] == "id:18:31" and got[21]["spans"] == "" and got[22]["spans"] == ""
    assert got[52]["n_spans"] == 1 and got[53]["n_ip"] == 3000 and got[53]["n_spans"] == 3000 and got[50]["n_spans"] == 0
    text = " ".join(f"1.2.3.{i % 250}" for i in range(3000))
    assert got[53]["base_sha256"] == hashlib.sha256(",".join(f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9.]+", text)).encode()).hexdigest()
    masked = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert masked[53] == " ".join(["[IP]"] * 3000) and masked[20] == 'here the token = "[ID]" is found' and masked[50] is None


def test_minhash_of_a_large_group_and_a_very_long_text(spark):
    rng = random.Random(41)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(3000):
        words = list(base)
        words[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    long = " ".join(f"v{k}" for k in range(200_000))
    rows += [(5000, long), (5001, long + " and one more"), (5002, " ".join(f"u{k}" for k in range(1000)))]
    got = {r["doc_id"]: r for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    sets = [shingles(t) for _, t in rows[:40]]
    assert all(100 * len(a & b) >= 75 * len(a | b) for a in sets for b in sets)
    assert {got[i]["component_id"] for i in range(3000)} == {0} and sum(r["kept"] for r in got.values()) == 3
    assert got[5001]["component_id"] == 5000 and got[5000]["n_shingles"] == 199_996

"""Ranked search, nearest vectors and the manifest against brute force: nulls, ties, repeated and empty rows, hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from candlewick.llm import manifest, nearest, ranking
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_search(docs, items, k=10):
    cut = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n, total = sum(bool(c) for _, c in cut), sum(c.total() for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in cut:
            if c:
                m = 25 + (75 * c.total() * n) // total
                score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in Counter(TERM.findall((text or "").translate(LOWER))).items() if t in c)
                if score > 0:
                    scores.append((-score, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcÄß9Z") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)] + [(200 + i, "same words here aZ") for i in range(40)]
    docs += [(7, text(9)), (None, "same words here aZ"), (300, None), (301, ""), (302, " ,;"), (303, "aZ " * 3000), (304, "x" * 5000)]
    items = [(i, text(rng.randint(1, 25))) for i in range(12)] + [(3, "same here"), (None, "words"), (20, None), (21, ""), (22, "unheardof"), (23, "aZ az AZ same same")]
    return docs, items


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    docs, items = search_rows()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score long, item_id string").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    want = brute_search(docs, items)
    assert rows_of(ranking.search(d, q)) == want
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 300)  # several blocks of items
    assert rows_of(ranking.search(d, q)) == want


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for x, y in ((d.limit(0), q), (d, q.limit(0)), (d.withColumn("text", F.lit(None).cast("string")), q), (d, q.withColumn("text", F.lit("...")))):
        assert rows_of(ranking.search(x, y)) == []
    assert ranking.search(d, q.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "ab" * 40 + " x9 " + "ä" * 33 + ";" + "Q r s " * 20
    whole = Counter(TERM.findall(text.translate(LOWER)))
    for size in (1, 7, 64):
        monkeypatch.setattr(ranking, "PIECE", size)
        assert ranking.terms_of(text) == whole


def test_shared_sums_are_there_once(spark):
    """Terms of the same items are one leaf, and a pair of leaves that many items have is one node."""
    q = spark.createDataFrame([(i, f"a b c d own{i}") for i in range(8)] + [(8, "a b")], "item long, text string")
    plan = ranking.planned(ranking.item_terms(q))
    assert [set(s) for s in plan.sets[:2]] == [{"a", "b"}, {"c", "d"}] and len(plan.sets) == 10
    pairs = [(int(a), int(b)) for _, left, right in plan.steps for a, b in zip(left, right, strict=True)]
    assert pairs.count((0, 1)) == 1 and len(pairs) == len(set(pairs)) == 1 + 8


def brute_nearest(rows, k=10, every=100):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)})
    out = set()
    for i, v in good:
        if i % every == 0:
            near = {}
            for j, w in good:
                if j != i and len(w) == len(v):
                    s = math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)))
                    near[j] = min(near.get(j, s), s)
            out |= {(i, r + 1, j, s) for r, (j, s) in enumerate(sorted(near.items(), key=lambda x: (x[1], x[0]))[:k])}
    return out


def vectors(n=3000, hot=1200):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.1 * rng.normal(size=8)).tolist()) for i in range(n)]
    common = [1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, -1.0]
    rows += [(10_000 + i, common) for i in range(hot)] + [(20_000, [-0.0, *common[1:]]), (20_001, common)]
    rows += [(30_000, None), (30_100, []), (30_200, [0.0] * 8), (30_300, [1.0, None] * 4), (30_400, [math.nan] * 8), (30_500, [math.inf] + [0.0] * 7), (None, common)]
    rows += [(5, rows[5][1]), (100, common), (40_000, [1.0, 2.0]), (40_001, [2.0, 2.0])]
    return rows


def test_nearest_reaches_its_recall(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    want = brute_nearest(rows)
    whole = {tuple(r) for r in nearest.exact(df).collect()}
    pick = lambda s: {(q, v) for q, _, v, _ in s}
    assert {(q, r, v, round(s, 12)) for q, r, v, s in whole if q != 100} == {(q, r, v, round(s, 12)) for q, r, v, s in want if q != 100}
    monkeypatch.setattr(nearest, "CHUNK", 500)  # hot cells in several tasks
    got = [tuple(r) for r in nearest.search(df).collect()]
    assert len(pick(got) & pick(whole)) >= 0.9 * len(pick(whole))
    count = Counter(q for q, *_ in got)
    assert all(n == 10 for q, n in count.items() if q not in (100, 40_000)) and count[40_000] == 1 and count[100] == 20
    # Queries among the copies of one vector see the smallest ids first.
    assert [v for q, r, v, s in sorted(got) if q == 10_000] == list(sorted({100, *range(10_001, 10_010)}))
    vec = {i: v for i, v in rows}
    assert all(s == pytest.approx(math.dist(vec[q], vec[v]), rel=1e-12) for q, _, v, s in got if 100 not in (q, v))


def test_nearest_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [9.0, 9.0])], schema)
    assert [(r["rank"], r["vec_id"]) for r in nearest.search(few).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    for none in (few.limit(0), few.filter("vec_id = 0"), few.filter("vec_id > 0"), spark.createDataFrame([(0, [0.0]), (100, None)], schema)):
        assert nearest.search(none).collect() == []


def test_probes_come_in_the_order_of_their_chance():
    sets = nearest.probe_sets(3, 27).tolist()
    assert sets[:3] == [0, 1, 2] and len(sets) == len(set(sets)) == 27
    t = nearest.Tables(4, 3, 1.0, 27)
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 4))
    b = a + 0.2 * rng.normal(size=(40, 4))
    ranks, probes, cells = t.ranks(a, b), t.probes(a), t.cells(b)
    for i in range(40):
        for tab in range(nearest.TABLES):
            met = np.flatnonzero(probes[i, tab] == cells[i, tab])
            assert ranks[i, tab] == (met[0] if len(met) else 27)


def brute_manifest(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r, n: h(*(enc(v) for v in (r[0], r[1], r[2], n, r[4])))

    def climb(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            levels.append(nodes)
        return levels

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf_of(r, r[3]), i) for i, r in enumerate(rows) if r[2] == g))
        trees[g] = ([x[3] for x in mine], climb([x[2] for x in mine]))
    top = climb([trees[g][1][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        order, levels = trees[g]
        for at, i in enumerate(order):
            r = rows[i]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded, proof = leaf_of(r, r[3] + 1 if bad and r[3] is not None else r[3]), []
            for nodes, p in ((levels, at), (top, k)):
                for level in nodes[:-1]:
                    pair = level[p - p % 2 : p - p % 2 + 2]
                    proof += [x for j, x in enumerate(pair) if j != p % 2]
                    pair[p % 2] = folded
                    folded, p = h(*pair), p // 2
            out.append((r[0], levels[0][at], levels[-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int"


def manifest_rows(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(3)
    return sorted((tuple(r) for r in manifest.manifest(df).select(*NAMES).collect()), key=repr)


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "SLOTS", 1 << levels)
    rng = random.Random(6)
    lang = lambda i: rng.choice(["en", "en", "en", "de", None, "ä"])
    rows = [(i, f"s{i % 3}", lang(i), rng.randint(0, 9), rng.choice(["tëxt", "", None, "long " * 200])) for i in rng.sample(range(-300, 4000), 130)]
    rows += [(2**62 + i, None, "en", None, "far") for i in (0, 1, 63, 64)] + [(-(2**62), "s", "en", 1, "far below"), (77, "s", "xx", 1, "alone")]
    assert manifest_rows(spark, rows) == brute_manifest(rows)
    # Repeated ids, equal rows, and rows without an id.
    rows += [(rows[k][0], f"other{j}", rows[k][2], 5, "again") for k in range(12) for j in range(3)] + [rows[0]] * 3 + [(None, "s", "en", j % 2, f"none{j // 2}") for j in range(9)] + [(None, None, None, None, None)]
    assert manifest_rows(spark, rows) == brute_manifest(rows)


def test_manifest_of_small_tables(spark):
    assert manifest_rows(spark, []) == []
    for rows in ([(1, "s", None, 1, "t")], [(7, "s", "en", 1, "t")], [(1, "s", "en", 1, "t"), (2, "s", "de", 1, "t")]):
        assert manifest_rows(spark, rows) == brute_manifest(rows)

"""MinHash near-duplicates by a multi-index Hamming join.

A document is its set of distinct word shingles. Its signature is 64 min-hashes of 16 bits each; the distance of two
signatures is the number of positions that differ. The signature is split into 16 chunks of four: two signatures at
distance 31 or less have a chunk with at most one error (pigeonhole), so a key for each chunk and each place of that
error brings together all such pairs. At a Jaccard similarity of 0.75 a pair's distance is 16 on average, and the chance
that it shares no key at all is below 1e-9. Candidates are confirmed on the full sets.

Equal sets are collapsed first. Only membership of components is asked for, so a bucket does not expand into pairs:
its members meet one pivot, and confirmed links are merged. Members of a bucket that are then still apart are compared
on their full sets in blocks of bounded size, which return a spanning forest and not pairs. Shingles that no other open
document has are in no intersection, which rules out heavily edited copies of a large group before that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, compact, pieces
from .components import components
from .hashing import Field, mix, word_bounds, word_hashes

SHINGLE = 5
#: Similarity from which documents are linked, as a ratio.
NUMERATOR, DENOMINATOR = 75, 100
HASHES, CHUNKS = 64, 16
ROWS = HASHES // CHUNKS
#: Distance up to which the join is whole by construction, and from which a candidate is not checked exactly at once: at
#: similarity 0.75 a distance over 40 has a chance below 1e-10. Such a candidate is not dropped: it stays apart in its
#: bucket, whose members are then compared on their full sets.
SURE, HOPELESS = 2 * CHUNKS - 1, 40
#: Documents that a task compares with each other at once.
BLOCK = 512

_rng = np.random.default_rng(75)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of k words, or of all words if there are fewer."""
    data, offsets = buffer_of(texts)
    starts, ends, first = word_bounds(data, offsets)
    run = Field(word_hashes(data, starts, ends, lower=True))
    whole = run.windows(k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        else:
            out.append(run.of(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit min-hashes, a row of 64 for each non-empty set."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint16)
    for p in range(HASHES):
        low = np.minimum.reduceat(flat * _A[p] + _B[p], begins)
        out[:, p] = (mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, sig): set_id is a 128-bit digest of the set; both are null for an empty set."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(piece.column("text"))
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full)) if full else iter(())
                ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "set_id", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig binary")


def keys_of(sig: np.ndarray) -> np.ndarray:
    """The 64 keys of each signature: for each chunk and each place of the allowed error, the other three values."""
    parts = sig.reshape(len(sig), CHUNKS, ROWS).astype(np.uint64)
    out = np.empty((len(sig), CHUNKS, ROWS), np.uint64)
    for hole in range(ROWS):
        a, b, c = (parts[:, :, i] for i in range(ROWS) if i != hole)
        out[:, :, hole] = (a << np.uint64(32)) | (b << np.uint64(16)) | c
    tag = (np.arange(CHUNKS, dtype=np.uint64)[:, None] * np.uint64(ROWS) + np.arange(ROWS, dtype=np.uint64)) << np.uint64(48)
    return (out | tag).reshape(len(sig), CHUNKS * ROWS)


def entries(classes: DataFrame) -> DataFrame:
    """(key, node): the index entries of (node, sig)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
                keys = keys_of(sig)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(part.column("node")), keys.shape[1]))], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose signatures are not hopelessly far apart."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("su", "sv"))
            yield batch.select(["u", "v"]).filter(pa.array((a != b).sum(axis=1) <= HOPELESS))

    sig = classes.select("node", "sig")
    joined = pairs.join(sig.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u").join(sig.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")
    return joined.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough; ``texts``: (node, text) of every node in a pair."""

    def run(batches):
        kept: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in batches:
            right = []
            for piece in pieces(batch):
                right += shingle_sets(piece.column("text"))
            good = []
            for left, b in zip(batch.column("left"), right, strict=True):
                left = left.as_py()
                if left != kept[0]:
                    kept = (left, shingle_sets(pa.array([left], pa.string()))[0])
                a = kept[1]
                both = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - both
                good.append(union > 0 and DENOMINATOR * both >= NUMERATOR * union)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    right = pairs.join(texts.select(F.col("node").alias("v"), "text"), "v")
    both = right.join(texts.select(F.col("node").alias("u"), F.col("text").alias("left")), "u")
    return both.select("u", "v", "left", "text").mapInArrow(run, "u long, v long").distinct()


def own_shingles(texts: DataFrame) -> DataFrame:
    """(node, shared, own): how many of a node's shingles other nodes of ``texts`` have too, and how many are its own.

    Both are null for a node with several texts (rows that repeat its id), of which no bound is known.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(piece.column("text"))
                nodes = np.repeat(np.asarray(piece.column("node")), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "shingle"])

    rows = texts.select("node", "text").mapInArrow(run, "node long, shingle long")
    twice = texts.groupBy("node").agg((F.count(F.lit(1)) > 1).alias("many"))
    by = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("top"))
    own = by.filter(F.col("node") == F.col("top")).groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    counted = size.join(own, "node", "left").join(twice, "node")
    mine = F.coalesce("own", F.lit(0))
    return counted.select("node", F.when(~F.col("many"), F.col("n") - mine).alias("shared"), F.when(~F.col("many"), mine).alias("own"))


def _tree(near_: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a similarity matrix whose rows are in groups already."""
    _, group = np.unique(group, return_inverse=True)
    n = int(group.max()) + 1
    rows, cols = np.nonzero(near_ & (group[:, None] < group[None, :]))
    first: dict[tuple[int, int], tuple[int, int]] = {}
    key, at = np.unique(group[rows].astype(np.int64) * n + group[cols], return_index=True)
    for k, i in zip(key.tolist(), at.tolist(), strict=True):
        first[divmod(k, n)] = (int(rows[i]), int(cols[i]))
    up = list(range(n))
    out = []
    for (a, b), edge in first.items():
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append(edge)
    return out


def similar(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Which pairs of sets are similar enough: counts of common members, by products of 0/1 matrices of so many columns."""
    sizes = np.array([len(x) for x in sets], np.int64)
    shingle, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df > 1
    place = np.cumsum(keep) - 1
    row, code = np.repeat(np.arange(len(sets)), sizes), code
    inside = keep[code]
    row, code = row[inside], place[code[inside]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(keep.sum()), columns):
        a, b = np.searchsorted(code, [low, low + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[row[a:b], code[a:b] - low] = 1
        both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    return (union > 0) & (DENOMINATOR * both >= NUMERATOR * union)


def block_links(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) that join what is apart in ``open_`` (key, node, c): enough of them for the components.

    Nodes that share open keys, by whatever chain, form a cluster; clusters are dealt to blocks of about BLOCK nodes,
    and larger ones to all pairs of their blocks. A task compares its block on the full sets and returns a spanning
    forest, so no list of pairs is ever made. Nodes that have too many shingles of their own are left out first.
    """
    nodes = open_.select("node", "c").distinct()
    sizes = own_shingles(texts.join(nodes.select("node"), "node", "left_semi"))
    able = compact(nodes.join(sizes.filter(F.col("own").isNull() | (DENOMINATOR * F.col("shared") >= NUMERATOR * (F.col("own") + F.col("shared")))).select("node"), "node"))
    first = open_.join(able.select("node"), "node").select("key", "node")
    star = first.join(first.groupBy("key").agg(F.min("node").alias("v")), "key").filter(F.col("node") != F.col("v")).select(F.col("node").alias("u"), "v").distinct()
    cluster = compact(components(star))
    counts = cluster.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = counts.filter(F.col("n") <= BLOCK).agg(F.sum("n")).first()[0] or 0
    lone = F.col("n") <= BLOCK
    dealt = cluster.join(counts, "component").select(
        "node", F.when(lone, -1 - F.pmod(F.xxhash64("component"), F.lit(1 + small // BLOCK))).otherwise(F.col("component")).alias("g"), lone.alias("lone"), F.when(lone, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks"),
    )
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.select("node", "g", "lone", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")).join(able, "node").join(texts, "node")

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        sets = [x for piece in pieces(batch) for x in shingle_sets(piece.column("text"))]
        node, c = np.asarray(batch.column("node")), np.asarray(batch.column("c"))
        edges = _tree(similar(sets), c)
        return pa.table({"u": pa.array([int(node[i]) for i, _ in edges], pa.int64()), "v": pa.array([int(node[j]) for _, j in edges], pa.int64())})

    return placed.groupBy("g", "lone", "a", "b").applyInArrow(run, "u long, v long")


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, component) after more links (u, v): only the components that these touch are merged anew."""
    root = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    edges = links.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    new = components(edges)
    known = groups.join(new.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return known.unionByName(new.join(groups.select("node"), "node", "left_anti").select("node", "component"))


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; kept = it names its component.

    Null, empty and blank texts have an empty set, are linked with nothing and kept. Rows that repeat a doc_id are one
    document, so their sets are linked; all of them return, and all are kept if they name the component. Rows without a
    doc_id have no component: null, and kept.
    """
    rows = compact(signed(docs), 25_000)
    named = rows.filter(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull())
    classes = compact(named.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), 10_000)
    # One shuffle for both the pivots and the join: no key holds more than one entry of each class, 1 in 64 of its own.
    found = entries(classes).repartition("key")
    shared = found.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).filter(F.col("pivot") < F.col("top")).select("key", "pivot")
    members = compact(found.join(shared, "key").select("key", "node", "pivot"))
    # Repeated doc_ids tie their sets together.
    twice = named.join(classes.select("set_id", "node"), "set_id").filter(F.col("doc_id") != F.col("node")).select("doc_id", "node").distinct()
    tied = twice.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter(F.col("u") < F.col("v")).select("u", "v")
    selves = twice.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))

    nodes = members.select("node").distinct()
    texts = compact(docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).join(nodes, "node").dropDuplicates(["node", "text"]), 10_000)
    asked = compact(near(members.filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct(), classes))
    links = compact(confirmed(asked, texts).unionByName(tied).unionByName(selves))
    groups = components(links)
    # Buckets whose members are not yet all together meet in blocks.
    at = members.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    apart = at.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter(F.col("a") < F.col("b")).select("key")
    open_ = compact(at.join(apart, "key"))
    if not open_.isEmpty():
        groups = merged(groups, block_links(open_, texts))
    of_set = classes.select("set_id", "node").join(groups, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    out = rows.join(of_set, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Merkle manifest of a table, with leaf places found by bitmap ranks.

1. Ids: every row sets a bit in the 64-bit word of its group and its id divided by 64; words of all tasks merge by OR. Only
   words with bits exist, so the bitmap is as sparse as the ids. A directory holds how many rows lie before each word: sums
   over the words of 2^16 ids' range, then over those ranges, and so on up to the group, each within a bounded window.
2. Places: a row's place in its group is the count before its word plus the bits set before its own. No sort of rows.
   Words with repeated ids are counted row by row instead.
3. Slots: rows are dealt to arrays of SLOTS consecutive leaves by place. An array folds to one node; its nodes, dealt to
   arrays by their places again, fold on until one is left. A few rounds reach the root, and each node's way to it is handed
   down to its array, where the proofs of all its leaves are put together.

Every array but the last of a round is full; it folds as many levels as the full ones do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Levels that one array folds, and its leaves.
LEVELS = 10
SLOTS = 1 << LEVELS
#: Langs up to which their table is sent to all tasks.
MOST_LANGS = 100_000
#: Bits of a place in the directory that one window counts.
STEP = 16


def encoded(value: Column) -> Column:
    """A value with its length in UTF-8 bytes; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def hash_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def before(words: DataFrame) -> DataFrame:
    """Adds ``base``: the rows in all words of a group before each; ``words``: grp, word, rows.

    Words are counted by ranges of 2^STEP, these by ranges of as many, and so on; a range's base is that of the range that
    holds it and what lies before it there. Windows and joins see 2^STEP rows of a key at most.
    """
    known = None
    for shift in reversed(range(0, 64, STEP)):
        level = words.groupBy("grp", F.shiftright("word", shift).alias("_low")).agg(F.sum("rows").alias("_n")) if shift else words.withColumnsRenamed({"word": "_low", "rows": "_n"})
        within = ["grp"] if known is None else ["grp", F.shiftright("_low", STEP)]
        w = Window.partitionBy(*within).orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("base", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        if known is not None:
            above = known.select("grp", F.col("_low").alias("_high"), F.col("base").alias("_above"))
            level = level.withColumn("_high", F.shiftright("_low", STEP)).join(above, ["grp", "_high"]).withColumn("base", F.col("base") + F.col("_above")).drop("_high", "_above")
        known = level
    return known.withColumnsRenamed({"_low": "word", "_n": "rows"})


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``place``: the rank of each row of (grp, doc_id, leaf, rid, ...) among its group, by doc_id.

    Rows without an id come first; rows of one id are in the order of their leaves, and rows that are equal in that, too, of ``rid``.
    """
    word, bit = F.shiftright("doc_id", 6), F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")
    keyed = rows.withColumns({"word": word, "bit": bit})
    ids = keyed.filter("doc_id IS NOT NULL")
    words = cut(ids.groupBy("grp", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count(F.lit(1)).alias("rows")))
    nulls = keyed.filter("doc_id IS NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("nulls"))
    none = nulls.isEmpty()
    directory = before(words)
    if not none:
        directory = directory.join(nulls, "grp", "left").withColumn("base", F.col("base") + F.coalesce("nulls", F.lit(0)))
    directory = cut(directory.select("grp", "word", "bits", "base", (F.bit_count("bits") == F.col("rows")).alias("plain")))
    met = ids.join(directory, ["grp", "word"])
    mask = F.expr("bits & ~shiftleft(-1L, bit)")
    out = met.filter("plain").withColumn("place", F.col("base") + F.bit_count(mask)).select(*rows.columns, "place")
    if not directory.filter("NOT plain").isEmpty():
        out = out.unionByName(_repeated(met.filter("NOT plain").withColumn("id", F.col("doc_id")), rows.columns))
    if not none:
        zero = F.lit(0).cast("long")
        out = out.unionByName(_repeated(keyed.filter("doc_id IS NULL").withColumns({"id": zero, "word": zero, "base": zero}), rows.columns))
    return out


def _repeated(met: DataFrame, columns: list[str]) -> DataFrame:
    """Places of rows whose word holds an id several times: ids, then leaves, are counted in windows of bounded size.

    Leaves are hashes, so their first digits part the rows of one id evenly; rows that are equal altogether are parted by ``rid``.
    """
    tag = {"_p": F.substring("leaf", 1, 3), "_s": F.pmod(F.xxhash64("rid"), F.lit(256))}
    x = met.withColumns(tag)
    by, one = ["grp", "word", "id"], ["grp", "word", "id", "_p"]
    some = cut(x.groupBy(*one, "leaf", "_s").agg(F.count(F.lit(1)).alias("_n")))
    run = lambda keys, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = lambda keys: some.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    of_id = total(by).withColumn("_a", run(["grp", "word"], ["id"])).drop("_n")
    of_part = total(one).withColumn("_b", run(by, ["_p"])).drop("_n")
    of_leaf = some.withColumn("_c", run(one, ["leaf", "_s"])).drop("_n")
    y = x.join(of_id, by).join(of_part, one).join(of_leaf, [*one, "leaf", "_s"])
    last = F.row_number().over(Window.partitionBy(*one, "leaf", "_s").orderBy("rid")) - 1
    return y.withColumn("place", F.col("base") + F.col("_a") + F.col("_b") + F.col("_c") + last).select(*columns, "place")


def levels_of(n: int) -> int:
    """Levels that fold n nodes to one."""
    return max(0, n - 1).bit_length()


def up(nodes: list[str], levels: int) -> list[list[str]]:
    """Every level of a fold, the nodes themselves first: two nodes give the hash of both, a lone last one that of itself."""
    out = [nodes]
    for _ in range(levels):
        nodes = [hash_of(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def way(tree: list[list[str]], at: int) -> list[str]:
    """What each level adds to the way up from a node: its sibling, marked L or R by its side; empty where it is alone."""
    out = []
    for nodes in tree[:-1]:
        other = at ^ 1
        out.append(("LR"[other > at] + nodes[other]) if other < len(nodes) else "")
        at >>= 1
    return out


def fold(leaf: str, path: list[str]) -> str:
    for s in path:
        leaf = hash_of([leaf] if not s else [s[1:], leaf] if s[0] == "L" else [leaf, s[1:]])
    return leaf


def nodes_of(arrays: DataFrame, field: str) -> DataFrame:
    """(grp, place, node): what each array (grp, at, n, slots) folds to; n is the number of its group's slots."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                grp, at, n, slots = (batch.column(c)[k].as_py() for c in range(4))
                yield pa.RecordBatch.from_pydict({"grp": pa.array([grp], pa.int64()), "place": pa.array([at], pa.int64()), "node": [up(slots, min(LEVELS, levels_of(n)))[-1][0]]})

    return arrays.select("grp", "at", "n", F.transform("slots", lambda s: s[field]).alias("slots")).mapInArrow(run, "grp long, place long, node string")


def folded_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, ways) of (grp, place, node), a row each: roots is (grp, n, root); ways is (grp, place, way), the way of each
    node up to the root of its group, as an array.

    Each round deals nodes to arrays of SLOTS by their places, and goes on with the arrays' nodes.
    """
    rounds, now = [], nodes
    most = nodes.agg(F.max("place")).first()[0] or 0
    sizes = nodes.groupBy("grp").agg((F.max("place") + 1).alias("n"))
    while True:
        arrays = cut(now.withColumns({"at": F.shiftright("place", LEVELS)}).groupBy("grp", "at").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("slots")).join(sizes, "grp"))
        rounds.append(arrays)

        now = nodes_of(arrays, "node")
        sizes = sizes.withColumn("n", F.shiftright(F.col("n") + (SLOTS - 1), LEVELS))
        most >>= LEVELS
        if most == 0:
            break
    roots = cut(now).select("grp", F.col("node").alias("root"))

    def ways_down(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                tree = up([s["node"] for s in r["slots"]], min(LEVELS, levels_of(r["n"])))
                first = r["at"] << LEVELS
                ways = [way(tree, i) + (r["above"] or []) for i in range(len(r["slots"]))]
                yield pa.RecordBatch.from_arrays([pa.array([r["grp"]] * len(ways), pa.int64()), pa.array(range(first, first + len(ways)), pa.int64()), pa.array(ways, pa.list_(pa.string()))], names=["grp", "place", "way"])

    above = None
    for arrays in reversed(rounds):
        with_above = arrays.withColumn("above", F.array().cast("array<string>")) if above is None else arrays.join(above.select("grp", F.col("place").alias("at"), F.col("way").alias("above")), ["grp", "at"])
        above = with_above.mapInArrow(ways_down, "grp long, place long, way array<string>")
    return roots, above


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    A leaf hashes doc_id, source, lang, n_chars and text, null or not. Leaves of a lang (null: a group of its own, the
    first) are in the order of their ids, null ids first; rows of one id in that of their leaves, so equal rows differ in
    their places and proofs only. Tampering is tried on rows whose id's crc32 7 divides; a null id has none. Other columns
    are not read. An empty table gives no rows.
    """
    n = F.col("n_chars").cast("long")
    fields = lambda chars: digest(F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), chars, F.col("text"))
    bad = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaf = fields(n)
    rows = cut(docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), F.when(bad, fields(n + 1)).otherwise(leaf).alias("tried"), F.monotonically_increasing_id().alias("rid")))
    # Langs are numbered by a sort over ranges; each task of it counts its own.
    langs = rows.select("lang").distinct().orderBy(F.asc_nulls_first(F.col("lang").cast("binary")))
    spark = docs.sparkSession
    numbered = langs.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    groups = cut(spark.createDataFrame(numbered, "lang string, grp long"))
    if groups.isEmpty():
        return rows.select("doc_id", "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.col("leaf").alias("proof_sha256"), F.col("leaf").alias("folded_root"), F.lit(True).alias("verified"))
    sent = F.broadcast if groups.count() <= MOST_LANGS else lambda df: df
    known = rows.join(sent(groups), rows["lang"].eqNullSafe(groups["lang"])).select("grp", "doc_id", "leaf", "tried", "rid")
    leaves = cut(placed(known).withColumn("at", F.shiftright("place", LEVELS)).groupBy("grp", "at").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "tried"))).alias("slots")))
    sizes = leaves.groupBy("grp").agg(F.max(F.col("slots")[F.size("slots") - 1]["place"] + 1).alias("n"))
    arrays = leaves.join(sent(sizes), "grp")

    subroots, ways = folded_nodes(cut(nodes_of(arrays, "leaf")))
    top, langs_up = folded_nodes(cut(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.col("root").alias("node"))))
    top_root = top.select(F.col("root").alias("top"))  # one row
    of_lang = cut(subroots.join(langs_up.select(F.col("place").alias("grp"), F.col("way").alias("over")), "grp").crossJoin(F.broadcast(top_root)))
    ready = arrays.join(ways.select("grp", F.col("place").alias("at"), F.col("way").alias("above")), ["grp", "at"]).join(sent(of_lang), "grp")

    def finish(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                slots, over = r["slots"], r["above"] + r["over"]
                tree = up([s["leaf"] for s in slots], min(LEVELS, levels_of(r["n"])))
                ids, own, proofs, folded = [], [], [], []
                for i, s in enumerate(slots):
                    path = way(tree, i) + over
                    ids.append(s["doc_id"])
                    own.append(s["leaf"])
                    proofs.append(hash_of([p[1:] for p in path]))
                    folded.append(fold(s["tried"], path))
                m = len(slots)
                columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (own, [r["root"]] * m, [r["top"]] * m, proofs, folded)), pa.array([f == r["top"] for f in folded])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return ready.mapInArrow(finish, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

"""Ranked lexical search of many items at once, by common subexpressions of their scores.

An item's score of a document is a sum over its terms, so items that share terms share parts of their sums:

1. Mine: terms that occur in the same items equally often form a *set*; its sum over a document is one accumulator.
   Sets are put in order, those of many items first, and numbered.
2. Share: an item is a list of set numbers. Lists are halved by the binary digits of their numbers, as in a radix tree,
   and equal halves are one node, whichever items they come from. Leaves are the sets, roots the items: a DAG in which a
   sum that several items need is there once.
3. Materialise and combine: a task fills the leaves' accumulators for a few hundred documents from their terms, adds up
   the DAG level by level, and keeps each item's best rows. Only these leave the task.

Documents are read and cut into terms once; what is kept of a document is its length and its counts of query terms.
Items are worked on in blocks of bounded size, and only a block's plan is sent to the tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import compact, cut

#: A term: what no ASCII character but a letter or digit interrupts.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM, _BREAK = re.compile(TERM), re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Characters of a long text that are cut into terms at once.
PIECE = 1 << 20
#: Bytes of item texts in a block: bounds the plan that is sent to the tasks.
BLOCK_BYTES = 8 << 20
#: Accumulators that a task holds at once.
CELLS = 1 << 21


def terms_of(text: str) -> Counter:
    """Terms of a whole text with their counts; a long text is cut between terms."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        stop = _BREAK.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = stop.start() if stop else len(text)
        found.update(_TERM.findall(text[at:end].translate(_LOWER)))
        at = end
    return found


def counted(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, n, terms, counts): a document's number of terms, and its query terms by number with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        number = known.value
        for batch in batches:
            size, ids, counts, ends = [], [], [], [0]
            for text in batch.column("text"):
                found = terms_of(text.as_py() or "")
                size.append(found.total())
                for term in found.keys() & number.keys() if len(found) > len(number) else (t for t in found if t in number):
                    ids.append(number[term])
                    counts.append(found[term])
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())).cast(pa.list_(pa.int64())) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, terms array<long>, counts array<long>")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of ``items`` (item, text)."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))
    return items.select("item", F.explode(words).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


@dataclass
class Plan:
    """The DAG of a block of items. Nodes below ``len(sets)`` are leaves; ``steps`` are (first, left, right) by level."""

    sets: list[list[str]]
    times: list[dict[int, int]]
    steps: list[tuple[int, np.ndarray, np.ndarray]]
    nodes: int
    items: list[int]
    root: np.ndarray

    def vocabulary(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(t for s in self.sets for t in s)}


def shared_sets(terms: DataFrame) -> DataFrame:
    """(set, who, terms): terms that have the same items and multiplicities, numbered with sets of many items first.

    ``terms`` is one block's (item, term, times), so its size is bounded, and so is that of what is numbered here.
    """
    by = terms.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("item", "times"))).alias("who"))
    sets = by.groupBy("who").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    return sets.withColumn("set", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.size("who")), F.col("terms")[0])) - 1)


def planned(terms: DataFrame) -> Plan | None:
    """The plan of one block of items; None where they hold no term."""
    rows = shared_sets(terms).orderBy("set").collect()  # bounded by BLOCK_BYTES
    if not rows:
        return None
    lists: dict[int, list[int]] = {}
    for r in rows:
        for w in r["who"]:
            lists.setdefault(w["item"], []).append(r["set"])
    # An item's multiplicity of a set is part of the set's signature, so a leaf for each (set, times).
    times = [{w["item"]: w["times"] for w in r["who"]} for r in rows]
    leaf: dict[tuple[int, int], int] = {}
    for k, t in enumerate(times):
        for n in sorted(set(t.values())):
            leaf[k, n] = len(leaf)
    number: dict[tuple[int, ...], int] = {}
    level: dict[int, int] = {k: 0 for k in range(len(leaf))}
    pairs: list[tuple[int, int]] = []

    def node(members: tuple[int, ...]) -> int:
        if len(members) == 1:
            return members[0]
        if members not in number:
            bit = (members[0] ^ members[-1]).bit_length() - 1
            half = next(i for i, m in enumerate(members) if m >> bit & 1)
            left, right = node(members[:half]), node(members[half:])
            number[members] = len(leaf) + len(pairs)
            pairs.append((left, right))
            level[number[members]] = 1 + max(level[left], level[right])
        return number[members]

    items = sorted(lists)
    roots = [node(tuple(leaf[k, times[k][i]] for k in lists[i])) for i in items]
    # Nodes of one level side by side, so that a level is one vector sum.
    order = sorted(range(len(leaf), len(leaf) + len(pairs)), key=lambda k: (level[k], k))
    place = {k: k for k in range(len(leaf))} | {k: len(leaf) + i for i, k in enumerate(order)}
    steps, i = [], 0
    while i < len(order):
        j = i
        while j < len(order) and level[order[j]] == level[order[i]]:
            j += 1
        left, right = (np.array([place[pairs[k - len(leaf)][side]] for k in order[i:j]]) for side in (0, 1))
        steps.append((len(leaf) + i, left, right))
        i = j
    return Plan([r["terms"] for r in rows], [{n: leaf[k, n] for n in t.values()} for k, t in enumerate(times)], steps, len(leaf) + len(pairs), items, np.array([place[r] for r in roots]))


def accumulators(plan: Plan, leaf_terms: np.ndarray, leaf_of: np.ndarray, multiple: np.ndarray, doc: np.ndarray, term: np.ndarray, part: np.ndarray, docs: int) -> np.ndarray:
    """Scores by (item, document): leaves are filled from a document's terms, then each level of the DAG is one sum.

    ``leaf_terms`` are the offsets by which a term finds its leaves in ``leaf_of`` and ``multiple``.
    """
    sums = np.zeros((plan.nodes, docs), np.int64)
    size = leaf_terms[term + 1] - leaf_terms[term]
    at = np.repeat(leaf_terms[term] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    np.add.at(sums, (leaf_of[at], np.repeat(doc, size)), np.repeat(part, size) * multiple[at])
    for first, left, right in plan.steps:
        np.add(sums[left], sums[right], out=sums[first : first + len(left)])
    return sums[plan.root]


def best_rows(held: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each item: by score, then by doc_id (null, marked in the fourth column, last)."""
    item, score, doc, null = held
    order = np.lexsort((doc, null, -score, item))
    item = item[order]
    first = np.searchsorted(item, item, side="left")
    order = order[np.arange(len(item)) - first < k]
    return tuple(x[order] for x in held)


def ranked(counts: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item."""
    offsets, leaves, multiples = [0], [], []
    for s, t in zip(plan.sets, plan.times, strict=True):
        for _ in s:
            for n, node in sorted(t.items()):
                leaves.append(node)
                multiples.append(n)
            offsets.append(len(leaves))
    sent = counts.sparkSession.sparkContext.broadcast((plan, weights, np.array(offsets), np.array(leaves, np.int64), np.array(multiples, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]):
        plan, weights, offsets, leaves, multiples = sent.value
        step = max(1, min(512, CELLS // plan.nodes))
        held = tuple(np.zeros(0, np.int64) for _ in range(4))
        floor = np.zeros(len(plan.items), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                size = np.asarray(rows.column("terms").value_lengths()).astype(np.int64)
                term, count = (np.asarray(rows.column(c).flatten()) for c in ("terms", "counts"))
                doc = np.repeat(np.arange(rows.num_rows), size)
                long_ = 25 + (75 * np.asarray(rows.column("n")) * n_docs) // n_terms
                part = weights[term] * ((1_000_000_000 * count) // (1000 * count + 8 * long_[doc]))
                scores = accumulators(plan, offsets, leaves, multiples, doc, term, part, rows.num_rows)
                item, who = np.nonzero((scores >= floor[:, None]) & (scores > 0))
                ids = rows.column("doc_id")
                null = np.asarray(ids.is_null()).astype(np.int64)
                new = (item, scores[item, who], np.asarray(ids.fill_null(0))[who], null[who])
                held = best_rows(tuple(np.concatenate(x) for x in zip(held, new, strict=True)), k)
                full, many = np.unique(held[0], return_counts=True)
                last = np.cumsum(many) - 1
                floor[full[many == k]] = held[1][last[many == k]]
        named = np.array(plan.items, np.int64)[held[0]]
        yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(held[2], mask=held[3] > 0), pa.array(held[1])], names=["item", "doc_id", "score"])

    return counts.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of ``docs`` (doc_id, text) for each row of ``items``
    (item_id, text), scores above 0 only, ties to the smaller doc_id.

    Null texts have no term: such documents count for nothing, such items have no row; so do items none of whose terms
    occurs. Each row of ``items`` is an item of its own, with its own ranks, even where it repeats an item_id or has none;
    each row of ``docs`` is a document of its own, repeated rows take ranks side by side, and a null doc_id comes last
    among equals. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    given = cut(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), F.col("text").cast("string")))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = -(-size // BLOCK_BYTES), None
    for b in range(blocks):
        mine = given.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else given
        plan = planned(item_terms(mine))
        if plan is None:
            continue
        vocabulary = plan.vocabulary()
        counts = compact(counted(docs, vocabulary), 50_000)
        total = counts.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            continue
        seen = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weigh = F.floor(1000 * F.log(F.lit(2.0 * total["docs"] + 2) / (2 * F.col("df") + 1)))
        weights = np.zeros(len(vocabulary), np.int64)
        for r in seen.select("term", weigh.alias("w")).collect():  # a row for each query term of the block
            weights[r["term"]] = r["w"]
        rows = ranked(counts, plan, weights, total["docs"], total["terms"], k)
        out = rows if out is None else out.unionByName(rows)
    named = given.select("item", "item_id")
    if out is None:
        return named.filter("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).join(named, "item").select("item_id", "rank", "doc_id", "score")

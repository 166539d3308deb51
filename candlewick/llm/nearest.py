"""Nearest vectors by multiprobe p-stable hashing.

A table hashes a vector to the cell of a few random Gaussian projections, cut into steps of one width. A query visits its
own cell in each table and then perturbed cells (steps up or down in some projections), in the order of their estimated
chance to hold a neighbour: sets of small perturbations first, by the expected squared distances to the step's edges.
What all tables' cells hold is merged and ranked by exact distances.

The number of projections and the probes of each table are fitted: the true neighbours of FIT_QUERIES sampled queries are
found by a scan, and the least work is taken that would have found FIT_RECALL of them. All vectors are indexed, and all
of a cell is compared; cells of more than CHUNK vectors or queries are dealt to several tasks. Equal vectors are one class
in the index, of which the ids that can be among the k nearest are kept; a query that found fewer than k is answered by a scan.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import compact, cut
from .hashing import mix

#: Sampled queries whose true neighbours are found, random pairs that the work is estimated on, and the share to be found.
FIT_QUERIES, FIT_PAIRS, FIT_RECALL = 200, 2000, 0.96
#: Tables, and most probes of a table.
TABLES, MOST_PROBES = 4, 32
#: Vectors (and queries) of a cell that one task compares.
CHUNK = 4096
#: Copies of a vector are first thinned in so many groups.
SALTS = 16


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    return F.coalesce(F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False))), F.lit(False))


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """(vec, ids, low): distinct vectors with the k + 1 smallest of their ids; low is the smallest.

    No more ids are needed: of equal vectors the smaller id is nearer, and at most one of them is the query's own.
    """
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id")) <= k + 1
    few = vectors.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("ok", first("vec", "salt")).filter("ok")
    few = few.withColumn("ok", first("vec")).filter("ok")
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("low", F.col("ids")[0])


def probe_sets(k: int, most: int) -> np.ndarray:
    """The perturbation sets in the order of their expected score, as masks over the 2k sorted distances to the edges.

    Bit j stands for the j-th smallest distance; j and 2k - 1 - j are the two edges of one projection, so a set holds one
    of them at most. The first set is empty: the query's own cell.
    """
    score = [0.0] * (2 * k)
    for j in range(1, k + 1):
        score[j - 1] = j * (j + 1) / (4 * (k + 1) * (k + 2))
        score[2 * k - j] = 1 - j / (k + 1) + j * (j + 1) / (4 * (k + 1) * (k + 2))
    fits = lambda s: not any(2 * k - 1 - j in s for j in s)
    out, heap = [0], [(score[0], (0,))]
    while heap and len(out) < most:
        value, s = heapq.heappop(heap)
        if fits(s):
            out.append(sum(1 << j for j in s))
        top = s[-1]
        if top + 1 < 2 * k:
            heapq.heappush(heap, (value - score[top] + score[top + 1], (*s[:-1], top + 1)))
            heapq.heappush(heap, (value + score[top + 1], (*s, top + 1)))
    return np.array(out, np.int64)


class Tables:
    """Projections of every table for vectors of ``dim`` components, of which the first ``k`` of each table are used."""

    def __init__(self, dim: int, k: int, width: float, probes: int):
        rng = np.random.default_rng([12, dim])
        most = 16
        self.a = rng.standard_normal((TABLES, most, dim))[:, :k]
        self.b = rng.random((TABLES, most))[:, :k] * width
        self.k, self.width, self.sets = k, width, probe_sets(k, probes)

    def steps(self, vectors: np.ndarray) -> np.ndarray:
        """Places (vectors, tables, k) along the projections, in widths."""
        return (np.einsum("nd,tkd->ntk", vectors, self.a) + self.b) / self.width

    def order(self, steps: np.ndarray) -> np.ndarray:
        """For each place the 2k moves, nearest edge first: j < k is a step down in projection j, else up."""
        inside = steps - np.floor(steps)
        return np.argsort(np.concatenate([inside, 1 - inside], axis=-1), axis=-1, kind="stable")

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, tables): the own cells."""
        return self.keys(np.floor(self.steps(vectors)).astype(np.int64))

    def probes(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, tables, probes): cells in the order in which they are visited."""
        steps = self.steps(vectors)
        home, order = np.floor(steps).astype(np.int64), self.order(steps)
        place = np.arange(self.k)
        out = []
        for mask in self.sets.tolist():
            move = np.zeros_like(home)
            for j in range(2 * self.k):
                if mask >> j & 1:
                    which = order[:, :, j, None]
                    move += np.where(which == place, -1, 0) + np.where(which == place + self.k, 1, 0)
            out.append(self.keys(home + move))
        return np.stack(out, axis=-1)

    def ranks(self, queries: np.ndarray, others: np.ndarray) -> np.ndarray:
        """(pairs, tables): the probe at which each query meets the other vector; the number of probes if at none."""
        steps = self.steps(queries)
        order, move = self.order(steps), np.floor(self.steps(others)).astype(np.int64) - np.floor(steps).astype(np.int64)
        back = np.argsort(order, axis=-1)
        bit = np.where(move < 0, 1 << back[..., : self.k], np.where(move > 0, 1 << back[..., self.k :], 0)).sum(axis=-1)
        bit = np.where(np.abs(move).max(axis=-1) > 1, -1, bit)
        by = np.argsort(self.sets)
        at = np.minimum(np.searchsorted(self.sets[by], bit), len(by) - 1)
        return np.where(self.sets[by][at] == bit, by[at], len(self.sets))

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit key of each cell; cells that share one are compared together, which costs time only."""
        out = np.zeros(cells.shape[:-1], np.uint64)
        for j in range(self.k):
            out = mix(out * np.uint64(31) + cells[..., j].astype(np.uint64) + np.uint64(1))
        return out.view(np.int64)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, as rows."""
    flat = pa.concat_arrays([c.flatten() for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])])
    return np.asarray(flat).astype(np.float64).reshape(len(column), -1)


def distances(queries: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances in doubles, summed in the order of the components."""
    out = np.zeros((len(queries), len(others)))
    for j in range(queries.shape[1]):
        out += (queries[:, j, None] - others[None, :, j]) ** 2
    return np.sqrt(out)


def _nearest(left: pa.Table, right: pa.Table, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, other row, distance) of the ``keep`` nearest of each query within each key of two tables; ties go to ``low``."""
    q_key, m_key = np.asarray(left.column("key")), np.asarray(right.column("key"))
    q_at, m_at = np.argsort(q_key, kind="stable"), np.argsort(m_key, kind="stable")
    queries, others, low = matrix(left.column("q_vec")), matrix(right.column("vec")), np.asarray(right.column("low"))
    out = []
    for key in np.intersect1d(q_key, m_key):
        mine, theirs = (at[np.searchsorted(of[at], key, side="left") : np.searchsorted(of[at], key, side="right")] for of, at in ((q_key, q_at), (m_key, m_at)))
        for at in range(0, len(mine), 256):
            some = mine[at : at + 256]
            d = distances(queries[some], others[theirs])
            row = np.repeat(np.arange(len(some)), len(theirs)).reshape(d.shape)
            if d.shape[1] > keep:  # all that are no farther than the keep-th
                near = d <= np.partition(d, keep - 1, axis=1)[:, keep - 1 : keep]
            else:
                near = np.ones(d.shape, bool)
            i, j = row[near], np.broadcast_to(np.arange(len(theirs)), d.shape)[near]
            order = np.lexsort((low[theirs[j]], d[i, j], i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < keep
            out.append((some[i[first]], theirs[j[first]], d[i[first], j[first]]))
    return tuple(np.concatenate([x[c] for x in out]) if out else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, float)))


def in_cells(members: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """(query, cls, low, score): the ``keep`` nearest classes of each query within each cell that it visits.

    ``members``: dim, cell, key, cls, low, vec; ``queries``: dim, cell, key, query, vec. ``cell`` deals keys to tasks; a cell of
    more than CHUNK members or queries is dealt to pairs of their chunks. Only the nearest rows leave a task.
    """
    by = ["dim", "cell"]
    size = lambda df, n: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(n))
    sizes = size(members, "m").join(size(queries, "q"), by)
    part = lambda of, n: F.pmod(F.xxhash64(of, "key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, by).withColumn("qp", part("query", "q")).withColumn("mp", every("m")).select(*by, "mp", "qp", "key", "query", "vec")
    right = members.join(sizes, by).withColumn("mp", part("cls", "m")).withColumn("qp", every("q")).select(*by, "mp", "qp", "key", "cls", "low", "vec")

    def run(q: pa.Table, m: pa.Table) -> pa.Table:
        if not q.num_rows or not m.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("query", pa.int64()), ("cls", pa.int64()), ("low", pa.int64()), ("score", pa.float64()))})
        i, j, d = _nearest(q, m, keep)
        return pa.table({"query": q.column("query").take(pa.array(i)), "cls": m.column("cls").take(pa.array(j)), "low": m.column("low").take(pa.array(j)), "score": pa.array(d)})

    deal = [*by, "mp", "qp"]
    left = left.select(*(F.col(c).alias(f"q_{c}") for c in deal), "key", "query", F.col("vec").alias("q_vec"))  # other names, as both may stem from one table
    return left.groupBy(*(f"q_{c}" for c in deal)).cogroup(right.groupBy(*deal)).applyInArrow(run, "query long, cls long, low long, score double")


def indexed(rows: DataFrame, k: int) -> DataFrame:
    """(cls, vec, ids, low, dim): the classes, numbered."""
    return compact(classes_of(rows, k).withColumns({"dim": F.size("vec"), "cls": F.monotonically_increasing_id()}), 50_000)


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")).filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    return rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # no negative zeros


def scan(index: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """(query, cls, low, score): the nearest of all classes, for a few queries: the whole index is one cell, in chunks."""
    one = {"cell": F.lit(0).cast("long"), "key": F.lit(0).cast("long")}
    return best(in_cells(index.withColumns(one), queries.withColumns(one), keep), keep)


def best(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest distinct classes of each query."""
    one = found.groupBy("query", "cls").agg(F.first("low").alias("low"), F.min("score").alias("score"))
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("score", "low", "cls"))).filter(F.col("_r") <= keep).drop("_r")


def fitted(index: DataFrame, queries: DataFrame, keep: int) -> dict[int, tuple[int, float, int]]:
    """By dimension: (projections, width, probes) of the least work that finds FIT_RECALL of the sample's neighbours.

    The samples are the FIT_QUERIES queries and FIT_PAIRS classes of least hash; their neighbours are those in all vectors.
    """
    few = lambda df, by, n: df.orderBy(F.xxhash64(by), by).limit(n)
    asked = cut(few(queries, "query", FIT_QUERIES))
    near = scan(index, asked, keep).join(asked.select("query", "dim", F.col("vec").alias("a")), "query").join(index.select("cls", F.col("vec").alias("b")), "cls").filter("score > 0")
    pairs = near.select("dim", "a", "b").toArrow()  # FIT_QUERIES times keep rows at most
    others = few(index, "cls", FIT_PAIRS).select("dim", "vec").toArrow()
    out = {}
    for dim in set(others.column("dim").to_pylist()):
        rest = matrix(others.filter(pc.equal(others.column("dim"), dim)).column("vec"))
        mine = pairs.filter(pc.equal(pairs.column("dim"), dim))
        a, b = (matrix(mine.column(c)) for c in "ab") if len(mine) else (rest[:1], rest[:1])
        spread = float(np.sqrt(rest.var(axis=0).sum())) or 1.0
        out[dim] = min(_choices(a, b, rest, spread, dim))[1:]
    return out


def _choices(a: np.ndarray, b: np.ndarray, rest: np.ndarray, spread: float, dim: int) -> Iterator[tuple[float, int, float, int]]:
    """(work, projections, width, probes): for each number of projections and width the probes that suffice, if any do."""
    left, right = rest[::2][: len(rest) // 2], rest[1::2][: len(rest) // 2]
    for k in range(1, 17):
        for times in (0.5, 1.0, 2.0, 4.0):
            t = Tables(dim, k, times * spread, MOST_PROBES)
            met = np.sort(t.ranks(a, b).min(axis=1))
            probes = int(met[min(len(met) - 1, math.ceil(FIT_RECALL * len(met)) - 1)]) + 1
            if probes > len(t.sets):
                continue
            share = float((t.ranks(left, right) < probes).sum(axis=1).mean()) if len(left) else 1.0
            yield share + 1e-4 * probes * TABLES, k, times * spread, probes
    yield float(TABLES), 1, 1e9 * spread, 1  # one cell: a scan


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) whose id ``every`` divides, the k
    nearest rows of other ids that were found (all, where there are fewer); ties go to the smaller vec_id.

    Null, empty and zero vectors, vectors with null or non-finite components, and rows without an id take no part. Rows
    that repeat both id and vector are one; a repeated id with another vector is a further candidate (and query) of that
    id. Vectors are compared with those of their own length only. Other columns are not read.
    """
    rows = usable_rows(vectors)
    index = indexed(rows, k)
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).distinct().withColumn("dim", F.size("vec"))
    asked = compact(asked.withColumn("query", F.monotonically_increasing_id()))
    keep = k + 1
    total = {r["dim"]: r["n"] for r in index.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = fitted(index, asked, keep) if total else {}
    tables = {d: Tables(d, *c) for d, c in chosen.items()}
    deal = {d: max(1, n // CHUNK) for d, n in total.items()}

    def cells(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for dim in set(batch.column("dim").to_pylist()):
                    mine = batch.filter(pc.equal(batch.column("dim"), dim))
                    step = max(1, 16384 // (TABLES * len(tables[dim].sets) if probe else TABLES))
                    for at in range(0, mine.num_rows, step):
                        part = mine.slice(at, step)
                        v = matrix(part.column("vec"))
                        keys = tables[dim].probes(v) if probe else tables[dim].cells(v)[..., None]
                        tab = np.broadcast_to(np.arange(TABLES)[None, :, None], keys.shape).reshape(-1)
                        flat = keys.reshape(-1)
                        # Cells are dealt to about as many tasks a table as there are chunks of vectors.
                        cell = tab * (1 << 40) + ((flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) % deal[dim]
                        again = part.take(pa.array(np.repeat(np.arange(len(part)), keys[0].size)))
                        named = {n: again.column(n) for n in part.schema.names if n not in ("dim", "vec")}
                        named |= {"dim": pa.array(np.full(len(flat), dim, np.int32)), "cell": pa.array(cell), "key": pa.array(flat ^ tab), "vec": again.column("vec")}
                        yield pa.RecordBatch.from_pydict(named)

        return run

    if not tables:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).filter("false")
    probes = asked.select("query", "dim", "vec").mapInArrow(cells(True), "query long, dim int, cell long, key long, vec array<double>")
    members = index.select("cls", "low", "dim", "vec").mapInArrow(cells(False), "cls long, low long, dim int, cell long, key long, vec array<double>")
    found = cut(best(in_cells(members, probes, keep), keep))
    # What the probes did not fill is found by a scan; that holds an index of fewer rows than asked for, too.
    enough = _rows(found, index, asked).groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = cut(asked.join(enough, "query", "left_anti").select("query", "dim", "vec"))
    if not short.isEmpty():
        found = found.join(short.select("query"), "query", "left_anti").unionByName(scan(index, short, keep))
    return _ranked(found, index, asked, k)


def exact(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """What ``search`` returns, by a scan of all vectors: the measure of its recall."""
    rows = usable_rows(vectors)
    index = indexed(rows, k)
    asked = cut(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).distinct().withColumns({"dim": F.size("vec"), "query": F.monotonically_increasing_id()}))
    return _ranked(scan(index, asked.select("query", "dim", "vec"), k + 1), index, asked, k)


def _rows(found: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, query_id, vec_id, score): the rows of found classes that have other ids than the query."""
    rows = found.join(index.select("cls", F.explode("ids").alias("vec_id")), "cls").join(asked.select("query", F.col("vec_id").alias("query_id")), "query")
    return rows.filter(F.col("vec_id") != F.col("query_id")).groupBy("query", "query_id", "vec_id").agg(F.min("score").alias("score"))


def _ranked(found: DataFrame, index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    ranked = _rows(found, index, asked).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

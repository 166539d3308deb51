"""Document fingerprints from closed syncmers, in DataFrame functions only.

The text's k-mers are runs of eight words, their inner substrings runs of two. A k-mer is an anchor if its least inner
hash lies at an edge: that depends on the k-mer alone, so texts that share a passage share its anchors wherever it
stands. A fingerprint holds all anchors of the text, each with its place in words; texts are compared by the anchors that
agree at a shift that other anchors agree on too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .beta import let
from .common import cut
from .quality import word_array

#: Words in a k-mer, and in its inner substrings: two of the seven inner places are edges.
KMER, INNER = 8, 2
LEAST_ID = -(2**63)
ANCHORS = "array<struct<hash:bigint,place:int>>"


def _selected(words: Column) -> Column:
    """Array of (hash, place) of all closed syncmers of an array of words, by place.

    A text of fewer words than a k-mer, or without a closed syncmer, is one anchor as a whole; one without words has none.
    """
    last = KMER - INNER

    def of_inner(p: Column) -> Column:
        s = p["s"]

        def closed(i: Column) -> Column:
            return F.least(s[i], s[i + last]) <= F.least(*(s[i + j] for j in range(1, last)))

        places = F.filter(F.sequence(F.lit(0), F.size(p["h"]) - KMER), closed)
        marks = F.transform(places, lambda i: F.struct(F.xxhash64(*(s[i + j] for j in range(0, last + 1, INNER))).alias("hash"), i.alias("place")))
        return F.when(F.size(p["h"]) >= KMER, marks).otherwise(F.array().cast(ANCHORS))

    def inner(h: Column) -> Column:
        s = F.when(F.size(h) >= KMER, F.transform(F.sequence(F.lit(0), F.size(h) - INNER), lambda i: F.xxhash64(h[i], h[i + 1]))).otherwise(F.array().cast("array<long>"))
        return F.struct(h.alias("h"), s.alias("s"))

    def whole(p: Column) -> Column:
        one = F.array(F.struct(F.xxhash64(p["h"]).alias("hash"), F.lit(0).alias("place")))
        return F.when(F.size(p["h"]) == 0, F.array().cast(ANCHORS)).when(F.size(p["m"]) == 0, one).otherwise(p["m"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(let(hashes, inner), lambda p: F.struct(p["h"].alias("h"), of_inner(p).alias("m"))), whole)


def anchors(text: Column) -> Column:
    """The fingerprint's anchors: (hash, place) of each distinct anchor at its first place, by rising hash."""

    def first(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (x["hash"] != F.get(s, i - 1)["hash"]))

    return let(F.sort_array(_selected(word_array(text))), first)


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, anchor, place): every anchor of every row of ``docs``, at every place in words; nothing is left out."""
    marks = _selected(word_array(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs.select("doc_id", F.explode(marks).alias("m")).select("doc_id", F.col("m")["hash"].alias("anchor"), F.col("m")["place"].alias("place"))


def aligned(left: DataFrame, right: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, shift, n_anchors, left_from, left_to) of two tables of ``placed``: anchors that agree at one shift.

    ``shift`` is the place in the left text less that in the right; the range is of the places in the left text. Only
    ``pairs`` (left_id, right_id) are compared; without them, all of the left table (a stated set of queries) with all
    of the right one that share an anchor.
    """
    a = left.select(F.col("doc_id").alias("left_id"), "anchor", F.col("place").alias("p"))
    b = right.select(F.col("doc_id").alias("right_id"), "anchor", F.col("place").alias("q"))
    on = ["anchor"] if pairs is None else ["right_id", "anchor"]
    both = (a if pairs is None else a.join(pairs.distinct(), "left_id")).join(b, on).groupBy("left_id", "right_id", (F.col("p") - F.col("q")).alias("shift"))
    return both.agg(F.count(F.lit(1)).alias("n_anchors"), F.min("p").alias("left_from"), F.max("p").alias("left_to"))


def shown(marks: Column) -> Column:
    """A fingerprint as a string: hash in hexadecimal, colon, place; comma-joined."""
    return F.array_join(F.transform(marks, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(":"), x["place"].cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of all distinct anchors of two fingerprints that both have at a shift that another common anchor has too.

    A single common anchor counts if a fingerprint has no more than one. 0 to 1; two empty fingerprints are alike.
    """

    def tagged(x: Column, side: int) -> Column:
        return F.transform(x, lambda m: F.struct(m["hash"].alias("hash"), F.lit(side).alias("side"), m["place"].alias("place")))

    def pair(p: Column) -> Column:
        def shifts(m: Column) -> Column:
            common = F.array_compact(F.transform(m, lambda x, i: F.when((i > 0) & (x["hash"] == F.get(m, i - 1)["hash"]), x["place"] - F.get(m, i - 1)["place"])))
            return F.struct(F.sort_array(common).alias("d"), F.size(m).alias("n"))

        def share(s: Column) -> Column:
            few = F.least(F.size(p["a"]), F.size(p["b"])) <= 1
            d = s["d"]
            counted = F.filter(d, lambda x, i: few | F.coalesce(x == F.get(d, i - 1), F.lit(False)) | F.coalesce(x == F.get(d, i + 1), F.lit(False)))
            return F.size(counted).cast("double") / (s["n"] - F.size(d))

        return let(let(F.sort_array(F.concat(tagged(p["a"], 0), tagged(p["b"], 1))), shifts), share)

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(F.struct(a.alias("a"), b.alias("b")), pair))


def _below(ids: DataFrame, bits: int) -> DataFrame:
    """(k, down): the next smaller of the distinct longs ``k``, null for the least.

    Numbers that agree but for their low 16 bits are ordered together, groups of them by recursion, so that no window
    holds more than 2**16 rows, whatever the numbers are.
    """
    if bits <= 16:
        return ids.select("k", F.lead("k").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("k"))).alias("down"))
    grouped = ids.select("k", F.shiftright("k", 16).alias("g"))
    inner = grouped.select("k", "g", F.lead("k").over(Window.partitionBy("g").orderBy(F.desc("k"))).alias("near"))
    tops = grouped.groupBy("g").agg(F.max("k").alias("top"))
    over = _below(tops.select(F.col("g").alias("k")), bits - 16).select(F.col("k").alias("g"), F.col("down").alias("og"))
    far = over.join(tops.select(F.col("g").alias("og"), "top"), "og").select("g", "top")
    return inner.join(far, "g", "left").select("k", F.coalesce("near", "top").alias("down"))


def with_next(docs: DataFrame, order: str, carried: list[str], bits: int = 8, derived: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with ``next_<c>`` of each carried column: that of the next row by falling ``order``; after the last, the first.

    ``derived`` columns are made of carried ones, added, and carried too; they are computed once a row, after the rows have
    moved, so they do not move themselves.

    Rows are ordered within ranges of 2**bits numbers; only the first row of each range is joined to the end of the
    range before it. Ties stand by a hash of the carried columns, then by these. Null numbers come last, in as many
    ranges of that hash as there would be for 2**16 rows, so many of them do not meet in one task.
    """
    h = F.xxhash64(*carried)
    keyed = docs.withColumns({"_k": F.coalesce(F.col(order).cast("long"), F.lit(LEAST_ID)), "_h": F.when(F.col(order).isNull(), F.shiftrightunsigned(h, 1)).otherwise(h)})
    # Ranges of null numbers are below all others.
    keyed = keyed.withColumn("_r", F.when(F.col(order).isNull(), F.shiftright("_h", 63 - (16 - bits)) - F.lit(2**62)).otherwise(F.shiftright("_k", bits)))
    rank = ["_h", *carried]
    w = Window.partitionBy("_r").orderBy(F.desc("_k"), *(F.desc(c) for c in rank))
    value = F.struct(*carried)
    inner = keyed.withColumns({"_near": F.lead(value).over(w)})
    heads = cut(keyed.groupBy("_r").agg(F.max_by(value, F.struct("_k", *rank)).alias("_head")))
    ranges = heads.select(F.col("_r").alias("k"))
    around = _below(ranges, 64).crossJoin(F.broadcast(ranges.agg(F.max("k").alias("_first"))))  # one row
    ends = around.select(F.col("k").alias("_r"), F.coalesce("down", "_first").alias("_to")).join(heads.withColumnRenamed("_r", "_to"), "_to").select("_r", "_head")
    new = list(derived or {})
    if derived:  # the same order again, so nothing moves
        inner = inner.withColumns(derived).withColumn("_made", F.lead(F.struct(*new)).over(w))
        ends = ends.select("_r", "_head", "_head.*").withColumns(derived).select("_r", "_head", F.struct(*new).alias("_head_made"))
    # The rows are by range already, so they do not move again.
    joined = inner.join(ends, "_r", "left")
    following = [F.coalesce(F.col("_near"), F.col("_head"))[c].alias(f"next_{c}") for c in carried]
    return joined.select(*docs.columns, *new, *following, *(F.coalesce(F.col("_made"), F.col("_head_made"))[c].alias(f"next_{c}") for c in new))


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has the last third of the code points replaced by the first as many of the next document's, by
    falling doc_id (of the first after the last; of itself, if it is alone). Null texts are empty: no anchors, and like
    an empty text. Rows that repeat a doc_id stand by a hash of the text; null doc_ids come last.
    """
    marked = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(marked, "doc_id", ["text"], derived={"marks": anchors(F.col("text"))})
    n = F.char_length("text")
    cut_at = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut_at), F.substr("next_text", F.lit(1), cut_at))
    full = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "marks", "next_marks")
    full = full.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "marks", "next_marks", anchors(F.col("edited")).alias("edited_marks"))
    return full.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("marks")).alias("fingerprint"), shown(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )

"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame functions only.

Four base kinds are found by expression. They and strings of a few well-known credential shapes are the seeds: the words
around them are lexical patterns, the nodes on one side of a graph whose other side is all identifier-like strings of the
corpus. Scores go back and forth: a pattern's confidence is the mean score of the strings it stands around, a string's
score follows from its patterns. Patterns of high confidence around enough strings of high score mark further strings
that no expression knows. A credential shape alone marks nothing: only its context does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .beta import let
from .common import cut

KINDS = ("email", "ip", "card", "phone")
#: Fixed expressions of the base kinds, written without backtracking over long runs: a match begins where its run of
#: characters begins, or where the last match ended (\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A string of 6 or more letters, digits, hyphens and underscores with a digit is a candidate.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+(?![A-Za-z0-9_-])"
#: Candidates of these shapes are seeds (fixed values): long hexadecimal strings, and keys with a known beginning.
SEED_SHAPE = r"^(?:(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}|A[KS]IA[0-9A-Z]{16}|(?:gh[pousr]_|sk-|xox[abpr]-)[A-Za-z0-9_-]{16,})$"
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
#: A pattern needs so many distinct strings of a score of at least one half, and this confidence.
MIN_SEEDS, MIN_CONFIDENCE, ROUNDS = 5, 0.8, 3
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,first:int,last:int,patterns:array<string>,value:string>>"


def _luhn(digits: Column) -> Column:
    """Luhn's sum of a string of at most 19 digits is a multiple of ten."""
    back = F.reverse(digits)

    doubled = F.transform(F.sequence(F.lit(1), F.char_length(back)), lambda i: let(F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.char_length(digits).between(12, 19), let(digits, _luhn)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def running(values: Column, step=lambda a, b: a + b) -> Column:
    """Running totals of an array of ints (or of another associative step), in log2(size) passes over it."""
    widths = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(widths, values, lambda acc, d: F.transform(acc, lambda x, i: F.coalesce(step(F.get(acc, i - d), x), x)))


def patterns_of(before: Column, after: Column) -> Column:
    """Lexical patterns of a match between two stretches of text: "left | right", lower-cased, numbers as 0, with a letter.

    One, two and three words to the left with what touches the match (one word alone only if a mark is at its end or
    touches the match), and one word to the left with what touches the match and one word to the right. A stretch that
    begins with a former match holds "0" in its place; a stretch with fewer words has fewer patterns.
    """

    def plain(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9]+", "0"), r"\s+", " ")

    def left(n: int) -> Column:
        return plain(F.regexp_extract(before, rf"(?<!\S)((?:\S++\s++){{{n}}}\S*+)$", 1))

    right = plain(F.regexp_extract(after, r"^(\S*+\s++\S++)(?!\S)", 1))
    of = let(
        F.struct(left(1).alias("a"), left(2).alias("b"), left(3).alias("c"), right.alias("r")),
        lambda p: F.array(
            F.when(p["a"].rlike(r"[^\p{L}0 ] ?$"), F.concat(p["a"], F.lit("|"))), F.when(p["b"] != "", F.concat(p["b"], F.lit("|"))),
            F.when(p["c"] != "", F.concat(p["c"], F.lit("|"))), F.when((p["a"] != "") & (p["r"] != ""), F.concat(p["a"], F.lit("|"), p["r"])),
        ),
    )
    return F.filter(of, lambda x: x.rlike(r"\p{L}"))


def spans_of(text: Column, kind: str, pattern: str, rank: int) -> Column:
    """Array of the pattern's valid matches with their places, in code points and in bytes, and their lexical patterns.

    Places are running totals of the lengths of the matches and of the text between them.
    """
    both = F.struct(F.split(text, pattern).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(b: Column) -> Column:
        def ends(size) -> Column:
            return running(F.transform(b["m"], lambda m, i: size(b["g"][i]) + size(m)))

        def one(e: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                good = valid(kind, m)
                gap = F.when(i > 0, F.concat(F.lit("0 "), b["g"][i])).otherwise(b["g"][i])
                return F.struct(
                    (e["c"][i] - F.char_length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e["c"][i].alias("end"), (e["b"][i] - F.octet_length(m)).alias("first"), e["b"][i].alias("last"),
                    F.when(good, patterns_of(gap, b["g"][i + 1])).alias("patterns"), m.alias("value"),
                )

            return F.transform(b["m"], span)

        return F.when(F.size(b["m"]) > 0, let(F.struct(ends(F.char_length).alias("c"), ends(F.octet_length).alias("b")), one)).otherwise(F.array().cast(SPAN))

    return F.filter(let(both, placed), lambda s: s["patterns"].isNotNull())


def found(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, text_hash, ``base`` (spans of the base kinds) and ``other`` (candidates clear of them)."""
    none = F.array().cast(SPAN)
    marked = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t")).withColumn("_d", F.col("_t").rlike("[0-9]"))
    needs = {"email": F.contains("_t", F.lit("@")), "ip": F.col("_d"), "card": F.col("_d"), "phone": F.col("_d") & F.contains("_t", F.lit("+"))}
    parts = {k: F.when(needs[k], spans_of(F.col("_t"), k, BASE[k], r)).otherwise(none).alias(f"_{k}") for r, k in enumerate(KINDS)}
    wide = marked.select(*keep, F.xxhash64("_t").alias("text_hash"), *parts.values(), F.when(F.col("_d"), spans_of(F.col("_t"), "id", CANDIDATE, len(KINDS))).otherwise(none).alias("_id"))
    base = F.sort_array(F.concat(*(F.col(f"_{k}") for k in KINDS)))
    wide = wide.select(*keep, "text_hash", base.alias("base"), "_id")
    return wide.select(*keep, "text_hash", "base", F.filter("_id", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))).alias("other"))


def patterns(rows: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence): patterns that mark identifiers, by scoring the pattern-instance graph over all documents."""
    spans = rows.select(F.explode(F.concat("base", "other")).alias("s"))
    seed = (F.col("s")["rank"] < len(KINDS)) | F.col("s")["value"].rlike(SEED_SHAPE)
    one = spans.select(F.explode(F.col("s")["patterns"]).alias("pattern"), F.lower(F.col("s")["value"]).alias("instance"), seed.cast("int").alias("seed"))
    edges = cut(one.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    known = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    scores, out = known, None
    for r in range(rounds):
        rated = edges.join(scores, "instance").groupBy("pattern").agg(F.avg("score").alias("confidence"), F.sum((F.col("score") >= 0.5).cast("long")).alias("sure"))
        out = cut(rated.filter(F.col("sure") >= min_seeds))
        if r + 1 < rounds:
            missed = edges.join(out, "pattern").groupBy("instance").agg(F.sum(F.log(1 - 0.999 * F.col("confidence"))).alias("log_miss"))
            scores = known.join(missed, "instance", "left").select("instance", F.greatest("score", 1 - F.exp(F.coalesce("log_miss", F.lit(0.0)))).alias("score"))
    return out.filter(F.col("confidence") >= min_confidence).select("pattern", "confidence")


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, spans) of each row: the base spans, and all spans with the ones that patterns add.

    Null and empty texts have no spans; rows that repeat a doc_id are searched each for itself; without a pattern of
    enough confidence both columns agree.
    """
    rows = cut(found(docs))
    good = patterns(rows)
    more = rows.select("doc_id", "text_hash", F.explode("other").alias("s")).withColumn("pattern", F.explode(F.col("s")["patterns"]))
    extra = more.join(good, "pattern").groupBy(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).agg(F.collect_set("s").alias("extra"))
    joined = rows.join(extra, (F.col("text_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_i")), "left")
    return joined.select("doc_id", "text_hash", "base", F.sort_array(F.concat("base", F.coalesce("extra", F.array().cast(SPAN)))).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by its first span's kind in brackets."""

    def of(p: Column) -> Column:
        reach = running(F.transform(p["s"], lambda s: s["last"]), F.greatest)

        def stretches(q: Column) -> Column:
            begins = F.filter(F.sequence(F.lit(0), F.size(q["s"]) - 1), lambda i: (i == 0) | (q["s"][i]["first"] >= F.get(q["reach"], i - 1)))
            return F.struct(q["t"].alias("t"), q["s"].alias("s"), q["reach"].alias("reach"), begins.alias("b"))

        def joined(q: Column) -> Column:
            def piece(i: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(q["reach"], i - 1)).otherwise(0)
                return F.concat(F.substring(q["t"], before + 1, q["s"][i]["first"] - before).cast("string"), F.lit("["), F.upper(q["s"][i]["kind"]), F.lit("]"))

            end = F.element_at(q["reach"], -1)
            return F.concat(F.array_join(F.transform(q["b"], piece), ""), F.substring(q["t"], end + 1, F.octet_length(q["t"]) - end).cast("string"))

        return let(let(F.struct(p["t"].alias("t"), p["s"].alias("s"), reach.alias("reach")), stretches), joined)

    return F.when(F.size(spans) > 0, let(F.struct(F.encode(text, "UTF-8").alias("t"), spans.alias("s")), of)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of each text masked; null texts stay null, all other columns (none may begin with ``_pii_``) as they are."""
    spans = extract(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_pii_id"), F.col("text_hash").alias("_pii_hash"), F.col("spans").alias("_pii_spans")).dropDuplicates(["_pii_id", "_pii_hash"])
    text = F.col("text").cast("string")
    joined = docs.join(spans, (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_pii_hash")) & F.col("doc_id").eqNullSafe(F.col("_pii_id")), "left")
    return joined.select(*(masked(text, F.coalesce("_pii_spans", F.array().cast(SPAN))).alias("text") if c == "text" else F.col(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans, as strings."""
    rows = extract(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))

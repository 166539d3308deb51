"""Quality rules with host verdicts, in DataFrame functions only.

Rules on a document count failures; failures are gathered by host (the document's ``source``); each host's failure
rate is shrunk towards all hosts' with an empirical beta prior, and the host's verdict is joined back: what fails only a
soft rule is forgiven on hosts that are credibly cleaner than all together, and rejected elsewhere; a host of which
nearly all fails is rejected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .beta import let, quantile, strength
from .common import cut

# Fixed values of the base rules.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Soft rules: symbols, and words in repeated windows, by 100 words.
SOFT_SYMBOLS, SOFT_REPEATS = 10, 30
#: A host is trusted if this quantile of its failure rate lies below the rate of all hosts.
TRUST_QUANTILE = 0.95
#: A host is rejected whole if the opposite quantile lies above this share: only where nearly all it has is junk.
HOST_REJECT_RATE = 0.9


def _count_char(text: Column, chars: str) -> Column:
    """How many of these ASCII characters a text has."""
    total = F.octet_length(text)
    return sum((total - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars[1:]), total - F.octet_length(F.replace(text, F.lit(chars[0]), F.lit(""))))


def _covered(starts: Column) -> Column:
    """How many places the three-word windows at these sorted starts cover."""
    zero = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, zero, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n")), lambda a: a["n"])


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice, each once.

    Windows are sorted by 43 bits of hash with their place in the low bits, so equal windows are neighbours; those that
    share their bits with a neighbour are compared word by word. Null where different windows share their bits: then
    equal ones need not be neighbours, and the caller sorts the windows themselves.
    """
    place = F.lit((1 << 20) - 1)

    def tagged(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.shiftleft(F.xxhash64(h[i], h[i + 1], h[i + 2]), 20).bitwiseOR(i.cast("long")))

    def bits(x: Column) -> Column:
        return F.shiftright(x, 20)

    def near(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(bits(x) == bits(F.get(s, i - 1)), F.lit(False)) | F.coalesce(bits(x) == bits(F.get(s, i + 1)), F.lit(False)))

    def same(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(place).cast("int"), b.bitwiseAND(place).cast("int")
        return (words[i] == words[j]) & (words[i + 1] == words[j + 1]) & (words[i + 2] == words[j + 2])

    def counted(s: Column) -> Column:
        apart = F.exists(F.transform(s, lambda x, i: (i > 0) & (bits(x) == bits(F.get(s, i - 1))) & ~same(x, F.get(s, i - 1))), lambda x: F.coalesce(x, F.lit(False)))
        return F.when(~apart, _covered(F.sort_array(F.transform(s, lambda x: x.bitwiseAND(place)))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(let(let(hashes, lambda h: F.sort_array(tagged(h))), near), counted))


def _repeat_words_long(words: Column) -> Column:
    """The same count from the windows themselves, for texts whose places need more bits or whose hashes clash."""
    tagged = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.cast("long").alias("i")))

    def counted(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(x["w"] == F.get(s, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False)))
        return _covered(F.sort_array(F.transform(twice, lambda x: x["i"])))

    return let(F.sort_array(tagged), counted)


def word_array(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The base measures of each document; a null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*keep, text.alias("_t")).select(*keep, "_t", word_array(F.col("_t")).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda s: F.length(F.translate(s, SPACES, "")) > 0)
    repeats = F.coalesce(F.when(F.size("_w") < (1 << 20), _repeat_words(F.col("_w"))), _repeat_words_long(F.col("_w")))
    out = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        (F.char_length("_t") - _count_char(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        _count_char(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > SOFT_SYMBOLS * F.col("n_words")) | (100 * F.col("n_repeat_words") > SOFT_REPEATS * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "soft_failed": soft})


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, n_failed, rate, low, high, all_rate): failure rates shrunk by a beta prior fitted to all hosts.

    ``low`` and ``high`` are quantiles of the posterior, ``all_rate`` is the prior's mean. A null host is the host named
    by the empty string. With hosts that all agree the prior is as strong as it may be.
    """
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = measured.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed).alias("n_failed"))
    mean = hosts.agg(((F.sum("n_failed") + 0.5) / (F.sum("n_docs") + 1)).alias("all_rate"))
    with_mean = hosts.crossJoin(F.broadcast(mean))  # one row of totals
    prior = with_mean.agg(strength(F.col("n_docs"), F.col("n_failed"), F.col("all_rate")).alias("k"))
    a = F.col("n_failed") + F.col("k") * F.col("all_rate")
    b = F.col("n_docs") - F.col("n_failed") + F.col("k") * (1 - F.col("all_rate"))
    shrunk = with_mean.crossJoin(F.broadcast(prior))  # one row
    return shrunk.select("host", "n_docs", "n_failed", (a / (a + b)).alias("rate"), quantile(a, b, 1 - TRUST_QUANTILE).alias("low"), quantile(a, b, TRUST_QUANTILE).alias("high"), "all_rate")


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), reject_rate: float = HOST_REJECT_RATE) -> DataFrame:
    """Base measures and verdicts, a row for each row of ``docs``.

    ``kept`` is false if a base rule fails, if a soft rule fails on a host that is not trusted, or if the host is
    rejected. Null texts have no words, so they fail; repeated rows are each judged.
    """
    measured = cut(measures(docs, keep))
    # Cut, so that both sides of the join are shuffles of their own and a hot host's rows can be split.
    hosts = cut(host_rates(measured)).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), (F.col("high") < F.col("all_rate")).alias("host_trusted"), (F.col("low") > reject_rate).alias("_bad"))
    joined = measured.join(hosts, F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("_host"), "left")
    return joined.select(*measured.columns, "host_rate", "host_trusted", (~F.col("base_failed") & ~F.col("_bad") & (~F.col("soft_failed") | F.col("host_trusted"))).alias("kept"))

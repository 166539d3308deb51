"""URL filters: fixed rules, then host reputation by empirical Bayes; DataFrame functions only.

Labelled outcomes of pages are counted for each host. A beta-binomial prior, its strength fitted at each level, leads
from all pages to suffixes, whose posterior is the prior of their registered domains, whose posterior is the prior of
their hosts. A host is blocked where even a lower quantile of its posterior rate of bad pages is above the rate of all
pages: that is, where it is credibly worse than the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .beta import quantile, strength
from .common import cut

#: (verdict, host, path): fixed rules; a rule fits its host and all subdomains, for paths that start with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The quantile of a host's posterior that is its bound.
BOUND = 0.05

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels (there is no list of longer public suffixes here)."""
    return F.substring_index(host, ".", -2)


def _fitted(groups: DataFrame, n: str, bad: str, prior: str) -> DataFrame:
    """Adds ``k``, the strength of the prior (means in ``prior``) fitted to all groups: one row, joined to each."""
    return groups.crossJoin(F.broadcast(groups.agg(strength(F.col(n), F.col(bad), F.col(prior)).alias("k"))))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, low, all_rate): posterior rate of bad pages of each host with a labelled page, its lower
    bound, and the rate of all pages.

    ``outcomes``: (host string, bad int). Counts are aggregated before anything is joined, so the joins hold a row for
    each host, domain and suffix.
    """
    counted = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b"))
    hosts = cut(counted.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))  # read at each level
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("b").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    all_ = suffixes.agg(((F.sum("sb") + 0.5) / (F.sum("sn") + 1)).alias("all_rate"))
    s = _fitted(suffixes.crossJoin(F.broadcast(all_)), "sn", "sb", "all_rate")  # one row of totals
    s = s.select("suffix", "all_rate", ((F.col("sb") + F.col("k") * F.col("all_rate")) / (F.col("sn") + F.col("k"))).alias("sp"))
    d = _fitted(domains.join(s, "suffix"), "dn", "db", "sp")
    d = d.select("domain", "all_rate", ((F.col("db") + F.col("k") * F.col("sp")) / (F.col("dn") + F.col("k"))).alias("dp"))
    h = _fitted(hosts.join(d, "domain"), "n", "b", "dp")
    a, b = F.col("b") + F.col("k") * F.col("dp"), F.col("n") - F.col("b") + F.col("k") * (1 - F.col("dp"))
    return h.select("host", "n", F.col("b").alias("bad"), (a / (a + b)).alias("mean"), quantile(a, b, BOUND).alias("low"), "all_rate")


def judge(pages: DataFrame, labels: DataFrame, bad_rate: float | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages``.

    A host is blocked if its bound is above ``bad_rate``; None takes the rate of all labelled pages.

    A page's outcome is the label of the same id: bad if toxic or of quality 0; labels with nulls, and pages without a
    host, count for nothing. No rule and no reputation: allow. A null url has an empty host and path.
    """
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    bad = labels.filter(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    outcomes = parsed.filter(F.col("host") != "").join(bad, "page_id").select("host", "bad")
    limit = F.col("all_rate") if bad_rate is None else F.lit(bad_rate)
    bad_hosts = reputations(outcomes).select(F.col("host").alias("_host"), (F.col("low") > limit).alias("_bad"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    by_host = F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(bad_hosts, F.col("host") == F.col("_host"), "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"))

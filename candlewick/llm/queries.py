"""Registered queries of the text operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import beta, bpe, chat, fingerprints, manifest, minhash, nearest, packing, pii, quality, ranking, substrings, suffixes, urls
from .common import documents


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.expand(rows.unionByName(own)))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(documents(spark, sf_dir))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


def queries() -> dict:
    named = (op1_minhash, op2_byte_bpe, op3_pii, op4_suffixes, op5_chat, op6_substrings, op7_quality, op8_packing, op9_urls, op10_fingerprints, op11_ranking, op12_nearest, op13_manifest)
    return {f.__name__: f for f in named}


SQL: dict[str, str] = {}

SQL["op5_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 23 AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

SQL["op7_quality"] = rf"""
WITH d AS (
  SELECT rowid_ AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS l
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, range(1, len(w) - 1) AS x(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(3) AS y(k) GROUP BY r),
m AS (
  SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[ \x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words OR 100 * n_repeat_words > 30 * n_words AS soft_failed FROM m),
h AS (SELECT host, count(*) AS n, sum((base_failed OR soft_failed)::INT) AS b FROM f GROUP BY host),
p AS (SELECT (sum(b) + 0.5) / (sum(n) + 1) AS mean FROM h),
s AS (SELECT any_value(mean) AS mean, {beta.strength_sql('n', 'b', 'mean')} AS k FROM h, p),
v AS (SELECT host, b + k * mean AS x, n - b + k * (1 - mean) AS y, mean FROM h, s),
lo AS ({beta.quantile_sql('v', 'host', 'x', 'y', 0.05)}),
hi AS ({beta.quantile_sql('v', 'host', 'x', 'y', 0.95)}),
w AS (SELECT host, lo.q > 0.9 AS bad, hi.q < mean AS trusted FROM v JOIN lo USING (host) JOIN hi USING (host))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AND (NOT soft_failed OR trusted) AS kept
FROM f JOIN w USING (host)"""

SQL["op9_urls"] = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS k FROM pages),
p AS (
  SELECT page_id, CASE WHEN k > 0 THEN translate(regexp_extract(substr(url, k + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN k > 0 THEN regexp_extract(substr(url, k + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS r(v, h, x)),
fit AS (SELECT p.*, v, h || x AS rule FROM p LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, x)),
one AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM fit GROUP BY page_id, host, path),
lab AS (SELECT doc_id AS page_id, max((toxic = 1 OR quality = 0)::INT) AS bad FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, count(*) AS n, sum(bad) AS b
  FROM p JOIN lab USING (page_id) WHERE host <> '' GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(b) AS db FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(dn) AS sn, sum(db) AS sb FROM d GROUP BY ALL),
a AS (SELECT (sum(sb) + 0.5) / (sum(sn) + 1) AS base FROM s),
sk AS (SELECT {beta.strength_sql('sn', 'sb', 'base')} AS k FROM s, a),
sp AS (SELECT suffix, (sb + k * base) / (sn + k) AS sp FROM s, a, sk),
dj AS (SELECT * FROM d JOIN sp USING (suffix)),
dk AS (SELECT {beta.strength_sql('dn', 'db', 'sp')} AS k FROM dj),
dp AS (SELECT domain, (db + k * sp) / (dn + k) AS dp FROM dj, dk),
hj AS (SELECT * FROM h JOIN dp USING (domain)),
hk AS (SELECT {beta.strength_sql('n', 'b', 'dp')} AS k FROM hj),
hp AS (SELECT host, b + k * dp AS x, n - b + k * (1 - dp) AS y FROM hj, hk),
low AS ({beta.quantile_sql('hp', 'host', 'x', 'y', 0.05)})
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN q > (SELECT base FROM a) THEN 'block' ELSE 'allow' END) AS verdict
FROM one LEFT JOIN low USING (host)"""

SQL["op1_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, range(1, greatest(len(w) - 4, 1) + 1) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.v FROM reach JOIN e ON reach.b = e.u),
m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON d.doc_id = a"""

SQL["op6_substrings"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM d, range(1, len(w) - 33) AS x(i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT r, i + j AS p FROM dup, range(35) AS y(j)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""


SQL["op11_ranking"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(w) AS term FROM i) GROUP BY ALL),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT r, 25 + (75 * len(w) * n) // l AS m FROM d, s WHERE len(w) > 0),
f AS (SELECT term, floor(1000 * ln((2.0 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s WHERE term IN (SELECT term FROM q) GROUP BY term),
p AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part FROM t JOIN f USING (term) JOIN m USING (r)),
x AS (SELECT i, r, sum(times * part)::BIGINT AS score FROM p JOIN q USING (term) GROUP BY i, r),
o AS (SELECT item_id, i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM x JOIN i USING (i) JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10"""


def _manifest_sql(depth: int = 20, over: int = 6) -> str:
    """Levels are unrolled: a lang of up to 2^depth rows, 2^over langs. A folded hash meets its sibling at each level."""
    enc = lambda x: f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    half = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: {half})), 4294967295)"
    out = [f"""WITH d AS (SELECT documents.doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS tried FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
r0 AS (SELECT g, doc_id, leaf, tried AS h, '' AS proof, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
t0 AS (SELECT g, i, leaf AS x FROM r0)"""]

    def level(k: int, tree: str, rows: str) -> str:
        return f"""t{k + 1} AS (SELECT g, i // 2 AS i, CASE WHEN any_value(n) = 1 THEN any_value(x) ELSE sha256(string_agg(x, '' ORDER BY i)) END AS x FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {tree}) GROUP BY g, i // 2),
r{k + 1} AS (SELECT r.* EXCLUDE (h, proof, i), r.i // 2 AS i, r.proof || coalesce(s.x, '') AS proof,
  CASE WHEN n.n = 1 THEN r.h WHEN s.x IS NULL THEN sha256(r.h) WHEN r.i % 2 = 0 THEN sha256(r.h || s.x) ELSE sha256(s.x || r.h) END AS h
  FROM {rows} r JOIN (SELECT g, count(*) AS n FROM {tree} GROUP BY g) n USING (g) LEFT JOIN {tree} s ON s.g = r.g AND s.i = xor(r.i, 1))"""

    out += [level(k, f"t{k}", f"r{k}") for k in range(depth)]
    out.append(f"u AS (SELECT 0 AS g, g AS i, x FROM t{depth}), v AS (SELECT 0 AS g, doc_id, leaf, r.g AS i, x AS subroot, h, proof FROM r{depth} r JOIN t{depth} USING (g))")
    out += [level(k, "u" if k == depth else f"t{k}", "v" if k == depth else f"r{k}") for k in range(depth, depth + over)]
    end = depth + over
    return ",\n".join(out) + f" SELECT doc_id, leaf, subroot, x AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = x AS verified FROM r{end}, t{end}"


SQL["op13_manifest"] = _manifest_sql()

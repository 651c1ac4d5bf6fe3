"""The queries of the operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import divergence, exactdedup, fingerprint, licenses, linededup, merkle, mixing, neardup, packing, personal, toxicity, urlfilter, warc
from sievelake.llm.common import Scratch, new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


#: Whole weights by level; a name that isn't here weighs 1.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}


def mix_levels() -> dict:
    return {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, scratch=scratch)
    mixed = mixed.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("tokens"), F.col("mix_epoch").alias("epoch"))
    return scratch.keep(mixed, "mix")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


URL_RULES = [
    urlfilter.Rule.of("com/", "allow"),
    urlfilter.Rule.of("example.com/en/", "block"),
    urlfilter.Rule.of("www.example.com/en/", "allow"),
    urlfilter.Rule.of("net/es/", "block"),
    urlfilter.Rule.of("net/fr/", "block"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees learn from the rows that a rule decides."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def license_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/hundred/id.txt, of which every hundredth is its directory's licence file and every thousandth that of source/lang."""
    top = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")))
    own = F.concat_ws("/", top, F.expr("cast(doc_id div 100 as string)"))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(F.col("doc_id") % 100 == 0, F.concat(own, F.lit("/LICENSE"))).otherwise(F.concat(own, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(license_paths(table(spark, sf_dir, "documents")))


def op8_licenses_every_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(license_paths(table(spark, sf_dir, "documents")), every_term=True)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.when(marked, F.translate("text", merkle.UPPER, merkle.LOWER))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), tampered=lowered, scratch=scratch)
    return scratch.keep(rows.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified"), "merkle")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.keep(divergence.audit(table(spark, sf_dir, "documents"), scratch=scratch), "divergence")


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    found = personal.find_personal(table(spark, sf_dir, "documents"), scratch=scratch)
    counts = [personal.number("base", kind).alias(f"n_{kind}") for kind in personal.KINDS]
    base = F.sha2(personal.joined(F.col("base")).cast("binary"), 256)
    return scratch.keep(found.select("doc_id", *counts, base.alias("base_sha256"), personal.joined(F.concat("base", "added")).alias("spans")), "personal")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_fingerprint, op2_mixing, op3_warc, op4_toxicity, op5_packing, op6_line_dedup, op7_url_filter, op8_licenses, op8_licenses_every_term, op9_exact_dedup, op10_near_dedup, op11_merkle, op12_divergence, op13_personal]
    return {f.__name__: f for f in found}


def level_sql(out: str, source: str, parents: str, name: str, budget: str) -> str:
    """CTEs that fill siblings to a common level per weight."""
    part = f"PARTITION BY {parents}" if parents else ""
    return f"""
{out}_a AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY CASE WHEN w > 0 THEN cap / w END ASC NULLS LAST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
   (sum(w) OVER ({part}) - coalesce(sum(w) OVER ({part} ORDER BY CASE WHEN w > 0 THEN cap / w END ASC NULLS LAST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS ws FROM {source}),
{out}_b AS (SELECT *, w > 0 AND cap * ws <= ({budget} - caps) * w AS fu FROM {out}_a),
{out}_c AS (SELECT *, ({budget} - coalesce(sum(CASE WHEN fu THEN cap END) OVER ({part}), 0))::BIGINT AS lft,
   coalesce(sum(CASE WHEN NOT fu THEN w END) OVER ({part}), 0)::BIGINT AS op FROM {out}_b),
{out} AS (SELECT *, CASE WHEN fu THEN cap WHEN op = 0 THEN 0 ELSE (lft * w) // op END AS share FROM {out}_c)"""


def case_sql(column: str, weights: dict[str, int]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


OP2_SQL = f"""
WITH docs AS (
  SELECT doc_id, 'd' || coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4, 0) AS domain,
         coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         (length(coalesce(text, '')) + 3) // 4 AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS t, 2 * sum(tokens)::BIGINT AS cap FROM docs GROUP BY ALL),
l1 AS (SELECT domain, sum(cap)::BIGINT AS cap, {case_sql("domain", MIX_WEIGHTS["domain"])} AS w,
   (SELECT floor(sum(t) * 0.6::DOUBLE)::BIGINT FROM leaves) AS b FROM leaves GROUP BY domain),
{level_sql("s1", "l1", "", "domain", "b")},
l2 AS (SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, any_value({case_sql("l.lang", MIX_WEIGHTS["lang"])}) AS w, any_value(s1.share) AS b
   FROM leaves l JOIN s1 ON s1.domain = l.domain GROUP BY l.domain, l.lang),
{level_sql("s2", "l2", "domain", "lang", "b")},
l3 AS (SELECT l.*, {case_sql("l.source", MIX_WEIGHTS["source"])} AS w, s2.share AS b FROM leaves l JOIN s2 ON s2.domain = l.domain AND s2.lang = l.lang),
{level_sql("s3", "l3", "domain, lang", "source", "b")},
plan AS (SELECT domain, lang, source, CASE WHEN t > 0 THEN share // t ELSE 0 END AS passes,
   share - CASE WHEN t > 0 THEN share // t ELSE 0 END * t AS rest FROM s3),
placed AS (SELECT d.*, p.passes, p.rest, sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source
   ORDER BY md5('17:' || p.passes || ':' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
   FROM docs d JOIN plan p ON p.domain = d.domain AND p.lang = d.lang AND p.source = d.source),
times AS (SELECT *, passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS n FROM placed)
SELECT doc_id, domain, lang, source, tokens, unnest(range(n::BIGINT))::INT AS epoch FROM times WHERE n > 0
"""


def op3_sql(least_bytes: int = 100) -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= {least_bytes} THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
held AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE h.keeper < k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (WHERE h.keeper IS NULL OR h.keeper >= k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN held h ON h.key = k.key
GROUP BY k.doc_id
"""

OP9_SQL = r"""
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op8_sql(every_term: bool = False) -> str:
    """``every_term``: terms beyond the templates weigh by their documents too."""
    known = "" if every_term else "WHERE w IN (SELECT w FROM tw)"
    weight, count = ("ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1", "LEFT JOIN df USING (w)") if every_term else ("coalesce(idf, ln((n + 1)::DOUBLE) + 1)", "LEFT JOIN idfs USING (w)")
    templates = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    names = ", ".join(f"'{n}'" for n in licenses.FILE_NAMES)
    return rf"""
WITH top AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS top FROM documents),
files AS (SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN top || '/LICENSE' WHEN doc_id % 100 = 0 THEN top || '/' || (doc_id // 100) || '/LICENSE'
   ELSE top || '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path FROM top),
tpl(k, name, t) AS (VALUES {templates}),
tw AS (SELECT k, name, w, count(*) AS tf FROM (SELECT k, name, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM tpl) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM files),
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM files) {known} GROUP BY w),
model AS (SELECT tw.*, ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1 AS idf FROM tw LEFT JOIN df USING (w), n),
weights AS (SELECT *, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY k)) AS weight FROM model),
idfs AS (SELECT DISTINCT w, idf FROM model),
units AS (SELECT DISTINCT doc_id, u FROM (
   SELECT doc_id, unnest(string_split(text, chr(10))) AS u, path FROM files) WHERE regexp_matches(lower(u), '{licenses.WORDS}')
   UNION SELECT doc_id, text FROM files WHERE regexp_extract(path, '[^/]*$') IN ({names})),
uw AS (SELECT doc_id, u, w, count(*) AS c FROM (SELECT doc_id, u, unnest(regexp_extract_all(lower(u), '[a-z0-9]+')) AS w FROM units) GROUP BY ALL),
ux AS (SELECT doc_id, u, w, c * ({weight}) AS x FROM uw {count}, n),
lens AS (SELECT doc_id, u, sqrt(sum(x ** 2)) AS len FROM ux GROUP BY ALL),
dots AS (SELECT doc_id, u, k, name, sum(x * weight) AS dot FROM ux JOIN weights USING (w) GROUP BY ALL),
scores AS (SELECT doc_id, name, round(dot / len, 6) AS score FROM dots JOIN lens USING (doc_id, u)),
best AS (SELECT doc_id, score AS own_score, CASE WHEN score >= 0.6 THEN name END AS own_license FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) = 1),
found AS (SELECT f.doc_id, path, own_score, own_license, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files f LEFT JOIN best USING (doc_id)),
given AS (SELECT dir AS above, own_license AS lic FROM found WHERE own_license IS NOT NULL AND regexp_extract(path, '[^/]*$') IN ({names})
   QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) = 1),
anc AS (SELECT dir, up, array_to_string(string_split(dir, '/')[1:len(string_split(dir, '/')) - up], '/') AS above
   FROM (SELECT dir, unnest(range(len(string_split(dir, '/')) + 1)) AS up FROM (SELECT DISTINCT dir FROM found))),
near AS (SELECT dir, above, lic FROM anc JOIN given USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY up) = 1)
SELECT doc_id, path, own_license, coalesce(own_score, 0.0::DOUBLE) AS own_score, coalesce(own_license, lic) AS license,
       CASE WHEN own_license IS NULL THEN above END AS inherited_from
FROM found LEFT JOIN near USING (dir)
"""


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, coalesce('+' || lang, '') AS g,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS other
  FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
level AS (
  SELECT 0 AS k, g, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT k + 1, g, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM level WHERE n > 1 GROUP BY k, g, pos // 8),
tops AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM level WHERE n = 1),
upper AS (
  SELECT 0 AS k, pos, n, subroot AS h FROM tops
  UNION ALL
  SELECT k + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY k, pos // 8),
runs AS (SELECT k, g, pos // 8 AS up, list(h ORDER BY pos) AS hs FROM level WHERE n > 1 GROUP BY ALL),
uruns AS (SELECT k, pos // 8 AS up, list(h ORDER BY pos) AS hs FROM upper WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT doc_id, g, leaf, 0 AS phase, 0 AS k, pos, n, other AS f, '' AS proof FROM placed
  UNION ALL
  SELECT w.doc_id, w.g, w.leaf,
    CASE WHEN w.n > 1 THEN w.phase ELSE 1 END, CASE WHEN w.n > 1 THEN w.k + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.pos // 8 ELSE t.pos END, CASE WHEN w.n > 1 THEN (w.n + 7) // 8 ELSE t.n END,
    CASE WHEN w.n > 1 THEN sha256(array_to_string(coalesce(r.hs, u.hs)[:w.pos % 8], '') || w.f || array_to_string(coalesce(r.hs, u.hs)[w.pos % 8 + 2:], '')) ELSE w.f END,
    CASE WHEN w.n > 1 THEN w.proof || array_to_string(coalesce(r.hs, u.hs)[:w.pos % 8], '') || array_to_string(coalesce(r.hs, u.hs)[w.pos % 8 + 2:], '') ELSE w.proof END
  FROM walk w JOIN tops t USING (g)
  LEFT JOIN runs r ON w.phase = 0 AND w.n > 1 AND r.k = w.k AND r.g = w.g AND r.up = w.pos // 8
  LEFT JOIN uruns u ON w.phase = 1 AND w.n > 1 AND u.k = w.k AND u.up = w.pos // 8
  WHERE w.phase = 0 OR w.n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT h FROM upper WHERE n = 1) AS verified
FROM walk JOIN tops USING (g) WHERE phase = 1 AND walk.n = 1
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM cnt GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(cnt.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(cnt.c, 0) + 2)) // (coalesce(tot.n, 0) + 2 * v.v) AS p,
   1 + (1000000000::HUGEINT * (k.c + 2)) // (v.n + 2 * v.v) AS q
   FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source
   LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
   LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
own AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT FROM own
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle": OP11_SQL, "op12_divergence": OP12_SQL, "op2_mixing": OP2_SQL, "op3_warc": op3_sql(), "op6_line_dedup": OP6_SQL, "op8_licenses": op8_sql(), "op8_licenses_every_term": op8_sql(every_term=True), "op9_exact_dedup": OP9_SQL}

"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, decontaminate, lm_score, ngram_join, quality_resample, quality_rules, substring_dedup, suffix_dedup, toxicity, warc_bundles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(_table(spark, sf_dir, "documents"))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.digest(_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(_table(spark, sf_dir, "documents"))


def op4_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_resample.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.digest(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_warc_bundles, op3_quality_rules, op4_quality_resample, op5_toxicity, op6_lm_score, op7_substring_dedup, op8_suffix_dedup, op9_decontaminate, op10_bpe_codec)}
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
v AS (SELECT page_id, h, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(x, i + 1, 1)) - 1) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p),
b AS (SELECT page_id, h, top, list_transform(range(160), lambda j: (n[j // 4 + 1] >> (3 - j % 4)) & 1) AS bit FROM v)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('{_BASE32}', 1 + bit[5*k+1]*16 + bit[5*k+2]*8 + bit[5*k+3]*4 + bit[5*k+4]*2 + bit[5*k+5], 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM b
"""

_LEAKS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ITEM_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ITEM_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(list_slice(w, k + 1, k + 8), ' ') AS s
      FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 7, least(len(w), 1)))) AS k FROM i)),
z AS (SELECT DISTINCT n FROM q),
s AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k + 1, k + n), ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, z WHERE len(w) >= n)),
m AS (SELECT s.doc_id, s.k, s.n, q.item_id FROM s JOIN q ON s.s = q.s AND s.n = q.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(f.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON c.doc_id IS NOT DISTINCT FROM d.doc_id LEFT JOIN f ON f.doc_id IS NOT DISTINCT FROM d.doc_id
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LIMITS = ", ".join(f"quantile_disc({c}, {q}) AS {side}_{c}" for c in quality_rules.SIDES for side, q in (("lo", quality_rules.TAIL), ("hi", 1 - quality_rules.TAIL)))
_USED = ", ".join(f"CASE WHEN g.n >= {quality_rules.LEAST_ROWS} THEN g.{x} WHEN l.n >= {quality_rules.LEAST_ROWS} THEN l.{x} ELSE a.{x} END AS {x}" for c in quality_rules.SIDES for x in (f"lo_{c}", f"hi_{c}"))
_INSIDE = " AND ".join([f"m.{c} >= t.lo_{c}" for c, x in quality_rules.SIDES.items() if x[0]] + [f"m.{c} <= t.hi_{c}" for c, x in quality_rules.SIDES.items() if x[1]])

#: Quantiles of all values: a sketch has the same up to some SKETCH_K texts of a group.
_QUALITY = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_SPACE}) <> '') AS lines FROM d),
g3 AS (SELECT r, k, w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] AS g FROM (SELECT r, w, unnest(range(len(w) - 2)) AS k FROM w WHERE len(w) > 2)),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS c FROM g3) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY r),
b AS (SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(lines) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.r = w.r),
m AS (SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed,
  word_chars / n_words AS word_length, n_symbols / n_words AS symbol_rate, n_dup_lines / n_lines AS dup_line_share, n_repeat_words / n_words AS repeat_share FROM b),
ok AS (SELECT * FROM m WHERE NOT base_failed),
g AS (SELECT lang, source, count(*) AS n, {_LIMITS} FROM ok GROUP BY lang, source), l AS (SELECT lang, count(*) AS n, {_LIMITS} FROM ok GROUP BY lang), a AS (SELECT {_LIMITS} FROM ok),
t AS (SELECT g.lang, g.source, {_USED} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({_INSIDE}, true) AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""

#: Texts as hex digits, cut into pieces of 256 windows of 50 bytes; the least doc_id of each window.
_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, row_number() OVER () AS r FROM documents),
c AS (SELECT r, doc_id, c, substr(x, 2 * c + 1, 610) AS x FROM (SELECT r, doc_id, x, unnest(range(0, len(x) // 2 - 49, 256)) AS c FROM d WHERE len(x) >= 100)),
s AS (SELECT r, doc_id, c + j AS k, md5_number(substr(x, 2 * j + 1, 100)) AS h FROM (SELECT r, doc_id, c, x, unnest(range(least(256, len(x) // 2 - 49))) AS j FROM c)),
f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h HAVING count(*) > 1),
z AS (SELECT s.r, s.k FROM s JOIN f ON s.h = f.h WHERE s.doc_id > f.first),
e AS (SELECT r, k, k > coalesce(max(k) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -51) + 50 AS starts FROM z),
i AS (SELECT r, run, min(k) AS lo, max(k) + 50 AS hi FROM (SELECT r, k, sum(starts::INT) OVER (PARTITION BY r ORDER BY k) AS run FROM e) GROUP BY r, run),
o AS (SELECT r, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM i GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN los IS NULL THEN x ELSE array_to_string(list_transform(range(len(los) + 1), lambda j:
    substr(x, CASE WHEN j = 0 THEN 1 ELSE 2 * his[j] + 1 END, CASE WHEN j = len(los) THEN len(x) ELSE 2 * los[j + 1] - CASE WHEN j = 0 THEN 0 ELSE 2 * his[j] END END)), '') END)) AS kept_sha256
FROM d LEFT JOIN o ON o.r = d.r
"""

#: The other operators hash, learn or tokenise in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_warc_bundles": _WARC, "op3_quality_rules": _QUALITY, "op8_suffix_dedup": _REPEATS, "op9_decontaminate": _LEAKS}

"""Queries of the training-data operators with their production parameters, and DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import debruijn, decontaminate, licenses, packing, pii, quality, secrets, simhash, suffixes, tokens
from umbra.llm.common import documents

#: Whole windows are joined with a space, which no word holds; a window's text is then the same just where its words are.
_SUBSTRINGS = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM k),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
v AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM v ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_PERSONAL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id,
  regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails,
  regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
  list_transform(regexp_extract_all(text, '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS numbers,
  list_transform(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phones FROM t)
SELECT doc_id, len(emails)::BIGINT AS n_email,
  len(list_filter(ips, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: try_cast(y AS DOUBLE))) <= 255))::BIGINT AS n_ip,
  len(list_filter(numbers, lambda x: len(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(x) + 1), lambda i:
    CASE WHEN (len(x) - i) % 2 = 0 THEN x[i]::INT WHEN x[i]::INT < 5 THEN 2 * x[i]::INT ELSE 2 * x[i]::INT - 9 END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phones, lambda x: len(x) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM f
"""
_SECRETS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2),
    lambda x: len(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: len(x) >= 24))::BIGINT AS n_hex FROM t
"""
_LICENCES = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w,
  list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS mit,
  list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS apache,
  list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl FROM t)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(mit) + len(apache) + len(gpl))::BIGINT AS n_base,
  (coalesce(list_min(list_concat(mit, apache, gpl)), 0) - 1)::BIGINT AS first_word,
  (coalesce(list_max(list_concat(mit, apache, gpl)), 0) - 1)::BIGINT AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM p
"""
_QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\r\f\v]')) AS lines FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS h FROM k),
r AS (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM h) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM r GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN n USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
"""

ORACLES: dict[str, str] = {
    "op8_substring_dedup": _SUBSTRINGS,
    "base_personal_data": _PERSONAL,
    "base_secrets": _SECRETS,
    "base_licence_places": _LICENCES,
    "base_quality_counts": _QUALITY,
}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.attribute(documents(spark, sf_dir))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(documents(spark, sf_dir))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op3: the counts of base spans."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_licence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op6: words and the places of base phrases, -1 for none."""
    found = op6_license_scans(spark, sf_dir)
    return found.select("doc_id", "n_words", "n_base", *(F.coalesce(k, F.lit(-1)).alias(k) for k in ("first_word", "last_word")), "base_labels")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op9: the counts of base spans."""
    return op9_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op10: all that it measures for the base rules."""
    return op10_quality_rules(spark, sf_dir).drop("kept", "p_good")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_pii": op3_pii,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_license_scans": op6_license_scans,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scans": op9_secret_scans,
    "op10_quality_rules": op10_quality_rules,
    "base_personal_data": base_personal_data,
    "base_licence_places": base_licence_places,
    "base_secrets": base_secrets,
    "base_quality_counts": base_quality_counts,
}

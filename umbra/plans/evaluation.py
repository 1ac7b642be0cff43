"""Queries of evaluations of de-identified texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import fixed, text
from umbra.operators import evaluation
from umbra.plans.registry import dealt, query, table


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked inputs of customers, with predictions that leak, keep or change what was marked; some have none."""
    rows = table(spark, sf_dir, "customer")
    mail = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.org"))
    source = F.concat(F.lit("Dear [NAME]"), "c_name", F.lit("[/NAME], your address is [EMAIL]"), mail, F.lit("[/EMAIL]. Thanks"))
    k = F.col("c_custkey") % 5
    said = F.when(k == 0, F.concat(F.lit("Dear Someone, your address is "), mail, F.lit(". Thanks"))).when(k == 1, "Dear Ann, your address is a@b.org. Thanks").when(k == 2, "Step 1: Dear [/NAME] Thanks").when(k == 3, F.concat(F.lit("Dear "), "c_name", F.lit(", your address is gone.")))
    examples = rows.select(F.col("c_custkey").cast("string").alias("id"), source.alias("input"))
    predictions = rows.select(F.col("c_custkey").cast("string").alias("id"), said.alias("prediction"), F.col("c_custkey").alias("line"))
    return evaluation.with_blocks(evaluation.with_predictions(dealt(examples, "id"), dealt(predictions, "id")))


_EXAMPLES_SQL = """x AS (SELECT c_custkey::VARCHAR AS id, c_custkey % 5 AS k, c_name AS v1, 'c' || c_custkey || '@x.org' AS v2 FROM customer),
    p AS (SELECT *, CASE k WHEN 0 THEN 'Dear Someone, your address is ' || v2 || '. Thanks' WHEN 1 THEN 'Dear Ann, your address is a@b.org. Thanks' WHEN 2 THEN 'Step 1: Dear [/NAME] Thanks' WHEN 3 THEN 'Dear ' || v1 || ', your address is gone.' ELSE '' END AS said FROM x),
    m AS (SELECT id, 2 AS total, contains(said, v1)::INT + contains(said, v2)::INT AS leaks, CASE WHEN k IN (0, 1) THEN 1.0 ELSE 0.0 END AS tc, k IN (0, 1, 3) AS ok,
        [substring(said, i, 3) for i in range(1, length(said) - 1)] AS grams FROM p),
    r AS (SELECT *, CASE WHEN len(grams) = 0 THEN 0.0 ELSE list_sum(list_transform(map_values(list_histogram(grams)), lambda c: CASE WHEN c > 1 THEN c ELSE 0 END)) / len(grams) END AS rep FROM m)"""


@query(
    f"""WITH {_EXAMPLES_SQL} SELECT id, round((total - leaks) / total, 6) AS pii_removal_recall, total::INT AS pii_total, leaks::INT AS pii_leak_count, round(tc, 6)::DOUBLE AS type_consistency, round(rep, 6)::DOUBLE AS repetition_3gram_rate, ok AS format_compliant FROM r"""
)
def example_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.reports(_examples(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select("id", r("pii_removal_recall"), "pii_total", "pii_leak_count", r("type_consistency"), r("repetition_3gram_rate"), "format_compliant")


@query(
    f"""WITH {_EXAMPLES_SQL} SELECT count(*) AS "count", round(avg((total - leaks) / total), 6) AS pii_removal_recall, sum(total)::BIGINT AS pii_total, sum(leaks)::BIGINT AS pii_leak_count, round(sum(leaks) / sum(total), 6) AS pii_leak_rate,
    round(avg(tc), 6)::DOUBLE AS type_consistency, round(avg(rep), 6)::DOUBLE AS repetition_3gram_rate, round(avg(ok::INT), 6) AS format_compliance_rate FROM r"""
)
def evaluation_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.aggregated(evaluation.reports(_examples(spark, sf_dir))).drop("over_rewrite_rate")
    return rows.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


@query()
def evaluation_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures that need the standard library's matcher, and the composite score."""
    rows = evaluation.aggregated(evaluation.reports(_examples(spark, sf_dir)))
    return rows.select(F.round("over_rewrite_rate", 6).alias("over_rewrite_rate"), F.round(evaluation.composite_score(rows), 6).alias("score"))


@query(f"WITH {_EXAMPLES_SQL} SELECT id, leaks::INT AS pii_leak_count FROM r WHERE leaks > 0 OR NOT ok OR tc < 1 ORDER BY id LIMIT 50")
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.failures(evaluation.reports(_examples(spark, sf_dir))).select("id", "pii_leak_count")


def _format_oracle() -> str:
    needles = ", ".join(f"CASE WHEN contains(lower(text), {_quoted(n)}) THEN {_quoted(n)} END" for n in fixed.NEEDLES)
    left = f"CASE WHEN contains(lower(text), '<pii') OR contains(lower(text), '[/') THEN {_quoted(fixed.MARKUP_TRIGGER)} END"
    phrases = ", ".join(f"CASE WHEN contains(lower(text), {_quoted(b.lower())}) THEN {_quoted(b)} END" for b in fixed.BANNED)
    return rf"SELECT conv_id, turn, array_to_string(CASE WHEN trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) = '' THEN ['<EMPTY>'] ELSE list_filter([{needles}, {left}, {phrases}], lambda x: x IS NOT NULL) END, '|') AS triggers FROM (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' Step 2 Output: 分析' ELSE '' END AS text FROM conversations)"


@query(_format_oracle())
def format_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, " Step 2 Output: 分析").otherwise(""))
    return rows.select("conv_id", "turn", F.concat_ws("|", text.triggers(said)).alias("triggers"))


@query(
    """SELECT item_id, CASE WHEN length(text) < 3 THEN 0.0 ELSE round(list_sum(list_transform(map_values(list_histogram(g)), lambda c: CASE WHEN c > 1 THEN c ELSE 0 END)) / len(g), 6) END::DOUBLE AS rate
    FROM (SELECT item_id, text, [substring(text, i, 3) for i in range(1, length(text) - 1)] AS g FROM benchmark)"""
)
def repetition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(text.repetition(F.col("text")), 6).alias("rate"))


_ZH_ID = "'ID A' || lpad(c_custkey::VARCHAR, 9, '1') || ' tel 0912345' || lpad((c_custkey % 1000)::VARCHAR, 3, '0')"


def _pairs_of_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey").cast("string")
    ident, call = F.concat(F.lit("A"), F.lpad(key, 9, "1")), F.concat(F.lit("0912345"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    rows = table(spark, sf_dir, "customer")
    originals = rows.select(key.alias("name"), F.concat(F.lit("ID "), ident, F.lit(" tel "), call).alias("text"))
    processed = rows.select(key.alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ID "), ident, F.lit(" tel -"))).otherwise("ID - tel -").alias("text"))
    return originals, processed


@query("SELECT c_custkey::VARCHAR AS name, c_custkey % 2 = 1 AS pii_removed, CASE WHEN c_custkey % 2 = 0 THEN 'A' || lpad(c_custkey::VARCHAR, 9, '1') END AS leaked_id FROM customer")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.leak_check(*_pairs_of_files(spark, sf_dir))
    return rows.select("name", "pii_removed", F.element_at(F.element_at("leaked", F.lit("ID")), 1).alias("leaked_id"))


@query("SELECT round(avg((c_custkey % 2)::DOUBLE), 6) AS success_rate FROM customer")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.success_rate(evaluation.leak_check(*_pairs_of_files(spark, sf_dir))).select(F.round("success_rate", 6).alias("success_rate"))


@query(
    """SELECT event_type, round(median(value), 6) AS p50, round((list(value ORDER BY value))[(floor(0.95 * (count(*) - 1)) + 1)::INT], 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type"""
)
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from umbra.operators.corpus import summary

    rows = summary(table(spark, sf_dir, "events"), "value", "event_type")
    return rows.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")])


@query("SELECT o_orderkey AS best_round, o_totalprice AS best_score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def best_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("round"), F.col("o_totalprice").alias("score"))
    return evaluation.running_best(rows)


@query("SELECT round, score FROM (SELECT * FROM (SELECT o_orderkey AS round, o_totalprice AS score FROM orders ORDER BY score DESC, round LIMIT 10) UNION SELECT * FROM (SELECT o_orderkey AS round, o_totalprice AS score FROM orders ORDER BY round DESC LIMIT 5))")
def kept_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("round"), F.col("o_totalprice").alias("score"))
    return evaluation.kept_rounds(rows, 10, 5)


@query()
def sequence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.round(evaluation.similarity("text", F.upper("text")), 6).alias("similarity"))

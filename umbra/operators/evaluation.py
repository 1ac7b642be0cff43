"""Evaluation of de-identification: leaks, type consistency, similarity, repetition and format, and their aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.functions import fixed
from umbra.functions.text import canonical_type, cleaned, java, leaked, repetition, triggers
from umbra.operators.rewriting import markup_blocks, masked_markup, masked_spans


def with_predictions(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """examples (id, input, ...) with prediction, empty where there is none; the last of several (by line) counts."""
    last = predictions.groupBy("id").agg(F.max_by(F.coalesce("prediction", F.lit("")), "line").alias("prediction"))
    return examples.join(last, "id", "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def with_blocks(examples: DataFrame, weak: DataFrame | None = None) -> DataFrame:
    """examples (id, input) with blocks and marked: those of the input's markup, else its weak spans that are sane.

    weak: (id, start, end, type), a row for each span.
    """
    rows = examples.withColumn("blocks", markup_blocks(F.col("input")))
    if weak is None:
        return rows.withColumn("marked", F.size("blocks") > 0)
    listed = weak.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("weak"))
    sane = F.filter(F.coalesce("weak", F.array().cast("array<struct<start:int,end:int,type:string>>")), lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length("input")))
    own = F.transform(sane, lambda s: F.struct(s["type"].alias("type"), F.substring(F.col("input"), s["start"] + 1, s["end"] - s["start"]).alias("value"), s["start"].alias("start"), s["end"].alias("end"), s["start"].alias("block_start"), s["end"].alias("block_end")))
    joined = rows.join(listed, "id", "left").withColumn("marked", F.size("blocks") > 0)
    return joined.withColumn("blocks", F.when(F.col("marked"), F.col("blocks")).otherwise(own)).drop("weak")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of the standard sequence matcher, with its heuristic for frequent characters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def found_count(text: Column, kind: Column) -> Column:
    """How often the expression of a type finds something in text; null for types without one."""
    out = F.lit(None).cast("int")
    for name, pattern in fixed.TYPE_PATTERNS.items():
        out = F.when(kind == name, F.regexp_count(text, F.lit(java(pattern)))).otherwise(out)
    return out


def consistency(blocks: Column, prediction: Column, unknown: str = "PII") -> Column:
    """Mean over types of min(1, found / expected), for types with an expression; 1 if there are none."""
    kinds = F.transform(blocks, lambda b: F.coalesce(canonical_type(b["type"], unknown), F.lit(unknown)))
    known = F.filter(F.array_distinct(kinds), lambda k: k.isin(*fixed.TYPE_PATTERNS))
    scores = F.transform(known, lambda k: F.least(F.lit(1.0), found_count(prediction, k) / F.size(F.filter(kinds, lambda x: x == k))))
    return F.when(F.size(known) == 0, F.lit(1.0)).otherwise(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def reports(examples: DataFrame, banned: Sequence[str] = fixed.BANNED) -> DataFrame:
    """A row of measures for each example (id, input, prediction, blocks, marked)."""
    prediction = F.coalesce("prediction", F.lit(""))
    values = F.filter(F.transform("blocks", lambda b: b["value"]), lambda v: F.length(cleaned(v)) > 0)
    total, leaks = F.size(values), F.size(leaked(values, prediction))
    blocks = F.transform("blocks", lambda b: F.struct(b["block_start"].alias("start"), b["block_end"].alias("end")))
    masked = cleaned(F.when(F.col("marked"), masked_markup(F.col("input"))).otherwise(masked_spans(F.col("input"), blocks)))
    rows = examples.withColumn("_masked", masked).withColumn("_clean", cleaned(prediction))
    same = F.when(F.col("_masked") == "", F.lit(1.0)).otherwise(similarity("_masked", "_clean"))
    return rows.withColumn("_same", same).select(
        "id",
        F.when(total == 0, F.lit(1.0)).otherwise((total - leaks) / total).alias("pii_removal_recall"),
        total.alias("pii_total"),
        leaks.alias("pii_leak_count"),
        F.col("_same").alias("non_pii_similarity"),
        (1 - F.col("_same")).alias("over_rewrite_rate"),
        consistency(F.col("blocks"), prediction).alias("type_consistency"),
        repetition(prediction).alias("repetition_3gram_rate"),
        (F.size(triggers(prediction, banned)) == 0).alias("format_compliant"),
        triggers(prediction, banned).alias("format_triggers"),
    )


def failures(rows: DataFrame, n: int = 50) -> DataFrame:
    """The first n reports with a leak, a broken format or an inconsistent type."""
    return rows.where("pii_leak_count > 0 or not format_compliant or type_consistency < 1").orderBy("id").limit(n)


def aggregated(rows: DataFrame) -> DataFrame:
    """One row over all reports: leaks over all values, other measures as means; defined where there are no reports."""
    mean = lambda c, empty: F.coalesce(F.avg(c), F.lit(empty))
    leaks = F.coalesce(F.sum("pii_leak_count") / F.nullif(F.sum("pii_total"), F.lit(0)), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("count"),
        mean("pii_removal_recall", 1.0).alias("pii_removal_recall"),
        F.coalesce(F.sum("pii_total"), F.lit(0)).alias("pii_total"),
        F.coalesce(F.sum("pii_leak_count"), F.lit(0)).alias("pii_leak_count"),
        leaks.alias("pii_leak_rate"),
        mean("over_rewrite_rate", 0.0).alias("over_rewrite_rate"),
        mean("type_consistency", 1.0).alias("type_consistency"),
        mean("repetition_3gram_rate", 0.0).alias("repetition_3gram_rate"),
        mean(F.col("format_compliant").cast("double"), 1.0).alias("format_compliance_rate"),
    )


def write_evaluation(rows: DataFrame, folder: str, n: int = 50) -> dict:
    """Writes reports (detailed), the first n failures and the metrics, as JSON lines, in a folder of any file system.

    Only the one row of metrics comes to the driver, which returns it.
    """
    rows.write.json(f"{folder}/detailed")
    failures(rows, n).coalesce(1).write.json(f"{folder}/failures")
    metrics = aggregated(rows).withColumn("composite_score", composite_score(rows))
    metrics.coalesce(1).write.json(f"{folder}/metrics")
    return metrics.first().asDict()


def composite_score(m: DataFrame) -> Column:
    """The weighted score of aggregated measures, less up to 1 for leaks."""
    share = lambda c: 1 - F.least(F.lit(1.0), F.col(c))
    good = 0.45 * F.col("pii_removal_recall") + 0.25 * F.col("format_compliance_rate") + 0.20 * F.col("type_consistency")
    return good + 0.05 * share("over_rewrite_rate") + 0.05 * share("repetition_3gram_rate") - F.least(F.lit(1.0), F.col("pii_leak_rate") * 5)


def leak_check(originals: DataFrame, processed: DataFrame, key: str = "name") -> DataFrame:
    """(key, pii_removed, leaked): by type, the values of an original that its processed text still has."""
    p = processed.select(key, F.col("text").alias("_new"))
    rows = originals.select(key, "text").join(p, key)
    found = {kind: leaked(F.array_distinct(F.regexp_extract_all("text", F.lit(java(x)), F.lit(0))), F.col("_new")) for kind, x in fixed.LEAK_PATTERNS.items()}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.array_sort(v).alias("value")) for k, v in found.items()]), lambda x: F.size(x["value"]) > 0)
    return rows.select(key, pairs.alias("p")).select(key, (F.size("p") == 0).alias("pii_removed"), F.map_from_entries("p").alias("leaked"))


def success_rate(checks: DataFrame) -> DataFrame:
    return checks.agg(F.avg(F.col("pii_removed").cast("double")).alias("success_rate"))


def running_best(rounds: DataFrame, score: str = "score", order: str = "round") -> DataFrame:
    """The earliest round with the best score."""
    return rounds.agg(F.max_by(F.col(order), F.struct(F.col(score), -F.col(order))).alias("best_round"), F.max(score).alias("best_score"))


def kept_rounds(rounds: DataFrame, top: int, last: int, score: str = "score", order: str = "round") -> DataFrame:
    """The `top` best rounds and the `last` latest, each once."""
    best = rounds.orderBy(F.desc(score), order).limit(top)
    return best.unionByName(rounds.orderBy(F.desc(order)).limit(last)).distinct()

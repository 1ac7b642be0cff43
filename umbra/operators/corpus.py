"""Corpus and dataset construction: mixing, sampling, quality reports, and training texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.text import cleaned, has_cjk, paragraphs, prompt
from umbra.operators.spans import issues


def dataset_spec(spec: str) -> tuple[str, int]:
    """(name, cap) of name[:cap], by the last colon; 0 means no cap."""
    name, sep, cap = spec.rpartition(":")
    return (name.strip(), int(cap)) if sep and cap.strip().isdigit() else (spec.strip(), 0)


def slug(name: str) -> str:
    return name.strip().replace("/", "__").replace(":", "__").replace(" ", "_") or "unknown"


def _rank(seed: int, *key: str) -> Column:
    """A number for a row that looks random and depends on seed and key alone."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]), 256)


def mixed(sources: Sequence[tuple[str, DataFrame, int]], order: str, seed: int | None = None) -> DataFrame:
    """All sources (name, rows, cap) as one, each capped to its first rows by order; shuffled by hash if a seed is given.

    Columns source_idx and source keep where a row came from. A cap takes a source's top rows, not all rows to one task.
    """
    parts = []
    for i, (name, df, cap) in enumerate(sources):
        some = df.orderBy(order).limit(cap) if cap else df
        parts.append(some.withColumn("source_idx", F.lit(i)).withColumn("source", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("source_idx", order) if seed is None else out.orderBy(_rank(seed, "source", order))


def sampled(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, the same whenever seed and keys are, as a top-n by hash: partial in each task, nothing is sorted whole."""
    return df.orderBy(_rank(seed, key), key).limit(n)


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """min, max, mean, p50 and p95 (the value at index int(0.95 (n - 1))) of a number, by key; zeros without rows.

    Values are counted before they are ordered, so p95 comes from running counts over distinct values, not from a list.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("c").over(part.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(part))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    n = F.col("n")
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return ranked.groupBy(*by).agg(
        zero(F.min("v"), "min"), zero(F.max("v"), "max"), zero(F.sum(F.col("v") * F.col("c")) / F.sum("c"), "mean"), zero(middle, "p50"), zero(at(F.floor(F.lit(0.95) * (n - 1))), "p95")
    )


def quality_report(examples: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Tables of a span dataset's quality: totals, issue_counts, type_counts (most frequent first), and three summaries."""
    found = issues(examples, key)
    each = examples.select(key, "text", F.explode("entities").alias("e"))
    bad = F.col("e.start").isNull() | F.col("e.end").isNull() | (F.col("e.start") < 0) | (F.col("e.end") > F.length("text")) | (F.col("e.start") >= F.col("e.end"))
    one = lambda df, name, n: df.agg(F.lit(name).alias("measure"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    totals = one(examples, "examples", F.count("*")).unionByName(one(examples, "entities", F.sum(F.size("entities"))))
    totals = totals.unionByName(one(found, "invalid_examples", F.countDistinct(key))).unionByName(one(each, "invalid_entities", F.count(F.when(bad, 1))))
    counted = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c)
    return {
        "totals": totals,
        "issue_counts": counted(found, "kind"),
        "type_counts": counted(each.where("e.type is not null and e.type <> ''").select(F.col("e.type").alias("type")), "type"),
        "text_length": summary(examples.select(F.length("text").alias("v")), "v"),
        "entities_per_example": summary(examples.select(F.size("entities").alias("v")), "v"),
        "entity_span_length": summary(each.where(~bad).select((F.col("e.end") - F.col("e.start")).alias("v")), "v"),
    }


def first_issues(examples: DataFrame, n: int = 200, key: str = "doc_id") -> DataFrame:
    return issues(examples, key).orderBy(key, "entity_index", "kind").limit(n)


def lm_corpus(df: DataFrame, min_chars: int = 0, cjk: bool | None = None) -> DataFrame:
    """text of df made clean, of at least min_chars; with cjk given only texts that have, or lack, such characters."""
    out = df.withColumn("text", cleaned(F.col("text"))).where((F.length("text") >= min_chars) & (F.length("text") > 0))
    return out if cjk is None else out.where(has_cjk(F.col("text")) == F.lit(cjk))


def pairs_corpus(df: DataFrame, template: str, split: bool = True, min_chars: int = 0) -> DataFrame:
    """(id, text) of pairs (id, input, output): the prompt of an input and its output, by paragraph where they have as many.

    Later parts of a pair have their number after its id.
    """
    a, b = paragraphs(F.coalesce("input", F.lit(""))), paragraphs(F.coalesce("output", F.lit("")))
    whole = F.array(F.struct(F.coalesce("input", F.lit("")).alias("0"), F.coalesce("output", F.lit("")).alias("1")))
    zipped = F.when((F.size(a) == F.size(b)) & (F.size(a) > 1), F.zip_with(a, b, lambda x, y: F.struct(x.alias("0"), y.alias("1")))).otherwise(whole) if split else whole
    each = df.select("id", F.posexplode(zipped).alias("i", "p"))
    text = F.trim(F.concat(prompt(template, F.col("p")["0"]), F.col("p")["1"]))
    name = F.when(F.col("i") > 0, F.concat("id", F.lit(":"), "i")).otherwise(F.col("id"))
    return each.select(name.alias("id"), text.alias("text")).where(F.length("text") >= min_chars)


def rewriter_corpus(df: DataFrame, language: str = "en", min_chars: int = 0) -> DataFrame:
    """Prompts of rows (noisy, text) that ask for the clean text of a noisy one."""
    from umbra.functions.text import rewrite_prompt

    return df.where(F.length("text") >= min_chars).withColumn("text", rewrite_prompt(F.col("noisy"), F.col("text"), language))


def per_format(df: DataFrame, value: str, path: str = "path") -> DataFrame:
    """count, avg, min and max of a measure by file extension."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return df.groupBy(ext.alias("ext")).agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))


def append_log(rows: DataFrame, folder: str) -> None:
    """Appends rows to a log of CSV files; each has its header."""
    rows.write.mode("append").option("header", True).csv(folder)

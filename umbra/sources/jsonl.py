"""JSON lines of span examples, pairs, predictions and texts, and their sinks."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPANS = "text string, entities array<struct<type:string,span:array<int>,text:string,confidence:double,score:double,source:string,language:string>>"
_PAIRS = "id string, _id string, example_id string, uuid string, pk string, index string, input string, output string"


def first_of(*names: str) -> Column:
    """The first of columns that isn't null or empty; empty if none is."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def span_examples(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the line), text and entities with start and end; blank lines are skipped."""
    rows = spark.read.schema(_SPANS).json(path).where("text is not null")
    flat = F.transform("entities", lambda e: F.struct(e["span"][0].alias("start"), e["span"][1].alias("end"), e["type"].alias("type"), e["text"].alias("text")))
    return rows.select(F.xxhash64(F.to_json(F.struct("text", "entities"))).alias("doc_id"), "text", F.coalesce(flat, F.array().cast("array<struct<start:int,end:int,type:string,text:string>>")).alias("entities"))


def write_span_examples(examples: DataFrame, path: str) -> None:
    out = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), F.array(e["start"], e["end"]).alias("span"), e["text"].alias("text")))
    examples.select("text", out.alias("entities")).write.json(path)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, input, output), the id from the first of its usual names."""
    rows = spark.read.schema(_PAIRS).json(path)
    return rows.select(first_of("id", "_id", "example_id", "uuid", "pk", "index").alias("id"), F.coalesce("input", F.lit("")).alias("input"), F.coalesce("output", F.lit("")).alias("output"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, prediction, line), the id from id, example_id or _id, the text from prediction or output.

    line orders lines by file and place: the last one of an id, by file name and byte offset, has the greatest.
    """
    rows = spark.read.schema("id string, example_id string, _id string, prediction string, output string").json(path)
    line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return rows.select(first_of("id", "example_id", "_id").alias("id"), first_of("prediction", "output").alias("prediction"), line.alias("line"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string").json(path).where("length(text) > 0")


def token_examples(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(tokens, tags) of a dataset with ner_tags or tags, as names or as numbers of labels; rows without tags are skipped."""
    column = next((c for c in ("ner_tags", "tags") if c in df.columns), None)
    if "tokens" not in df.columns or column is None:
        raise ValueError("no columns for tokens and tags")
    tags = F.col(column)
    if labels:
        names = F.array(*map(F.lit, labels))
        tags = F.transform(tags, lambda i: F.element_at(names, i.cast("int") + 1))
    return df.withColumn("tags", tags).where(F.size("tags") > 0)


def pair_columns(df: DataFrame, originals: list[str], masked: list[str]) -> DataFrame:
    """(original, masked) of the first candidate column that df has of each."""
    a, b = (next((c for c in names if c in df.columns), None) for names in (originals, masked))
    if a is None or b is None:
        raise ValueError("no candidate column is there")
    return df.select(F.col(a).alias("original"), F.col(b).alias("masked"))


def write_manifest(path: str, **fields: object) -> None:
    """A small JSON file beside a dataset, written by the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(fields, f, ensure_ascii=False, indent=2, default=str)


def write_dataset(examples: DataFrame, folder: str, **about: object) -> dict:
    """dataset (JSON lines), quality and manifest (one JSON text each) in a folder of any file system.

    The report is over all rows; only its few rows (kinds, types and summaries) come to the driver.
    """
    from umbra.operators.corpus import quality_report

    spark = examples.sparkSession
    write_span_examples(examples, f"{folder}/dataset")
    report = {name: [r.asDict() for r in df.collect()] for name, df in quality_report(examples).items()}
    for name, what in (("quality", report), ("manifest", {"dataset": f"{folder}/dataset", **about})):
        spark.createDataFrame([(json.dumps(what, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    return report

"""A command line over files: detect, replace or mask, with results as text or JSON.

    python -m umbra.cli --input FOLDER_OR_FILE --mode detect|replace|blackbox [--lang en] [--json] [--output-dir FOLDER]
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators import detection, documents, rewriting
from umbra.sources import files, rebuilds, settings

SCHEMA_VERSION = "1.0"


def texts(segments: DataFrame) -> DataFrame:
    """(doc_id, ext, text): the document of each file's segments, doc_id its path."""
    rows = segments.select(F.col("path").alias("doc_id"), "ext", "segment_id", "text")
    parts = []
    for separator in sorted({"\n", *files.SEPARATORS.values()}):
        mine = [e for e, s in files.SEPARATORS.items() if s == separator]
        some = rows.where(F.col("ext").isin(*mine)) if separator != "\n" else rows.where(~F.col("ext").isin(*files.SEPARATORS))
        parts.append(documents.built(some, separator).select("doc_id", "text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def processed(docs: DataFrame, language: str, mode: str) -> DataFrame:
    found_by = [detection.regex_detector(settings.rules(language))]
    return rewriting.deidentified(docs, found_by, "replace" if mode == "detect" else mode)


def as_json(results: DataFrame) -> DataFrame:
    """(doc_id, json): text, entities, events, replacement map and schema version of each result."""
    fields = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("output").alias("text"), "entities", "events", "replacement_map")
    return results.select("doc_id", F.to_json(fields).alias("json"))


def entity_counts(results: DataFrame) -> DataFrame:
    """(doc_id, pii_count) for each file, 0 for one without any."""
    return results.select("doc_id", F.size("entities").alias("pii_count"))


def changes(results: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, output, changes) of results: each entity's value, with the page, box and cell of the segment that holds it."""
    placed = documents.segmented(segments.withColumnRenamed("path", "doc_id"))
    spans = results.select("doc_id", "text", "replacement_map", F.explode("entities").alias("e")).select(
        "doc_id", F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.type").alias("type"),
        F.substring(F.col("text"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("original"), "replacement_map",
    )
    anchored = documents.anchored(spans, placed, "page_index", "bbox", "cell")
    value = F.element_at("replacement_map", F.concat("type", F.lit(":"), "original"))
    one = F.struct("start", F.struct("original", value.alias("value"), "page_index", "bbox", "cell").alias("c"))
    listed = anchored.where(value.isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    none = F.array().cast(rebuilds.CHANGES)
    rows = results.select("doc_id", "output").join(listed, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("path"), "output", F.coalesce(F.transform("c", lambda x: x["c"]), none).alias("changes"))


def lines(results: DataFrame, mode: str, as_objects: bool) -> Iterator[str]:
    """What is printed for each file; results come to the driver one partition at a time."""
    if as_objects:
        yield from (f'{{"path": {json.dumps(r.doc_id)}, "result": {r.json}}}' for r in as_json(results).orderBy("doc_id").toLocalIterator())
        return
    for r in results.orderBy("doc_id").toLocalIterator():
        yield f"== {r.doc_id}"
        if mode == "detect":
            yield from (f"{e['type']:16} | {r.text[e['start'] : e['end']]} | {e['score']:.2f}" for e in r.entities)
        else:
            yield r.output


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="umbra")
    p.add_argument("--input", required=True)
    p.add_argument("--mode", default="replace", choices=["detect", *sorted(rewriting.MODES)])
    p.add_argument("--lang", default="en", choices=sorted(settings.RULE_FILES))
    p.add_argument("--output-dir")
    p.add_argument("--json", action="store_true")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("umbra").getOrCreate()
    segments = files.scan(spark, args.input)
    results = processed(texts(segments), args.lang, args.mode)
    for line in lines(results, args.mode, args.json):
        print(line)
    if args.output_dir and args.mode != "detect" and rewriting.mode_of(args.mode) == "replace":
        made = rebuilds.rebuild_files(spark, changes(results, segments), args.output_dir, args.input)
        for r in made.where("artifact is not null").orderBy("path").toLocalIterator():
            print(f"{r.path} -> {r.artifact}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

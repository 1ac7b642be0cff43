"""Detection of personal data by ordered rules, union of detectors, and resolution of conflicts between their spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions import fixed

#: type, Python expression, flags by name joined with |
Rule = tuple[str, str, str]
#: A detector of one text: (start, end, type, score, source) in the order in which it finds them.
Detector = Callable[[str], list[tuple[int, int, str, float, str]]]
MATCHES = "doc_id long, start int, end int, type string, score double, source string, det_idx int, seq int"
SPAN = "struct<start:int,end:int,type:string,score:double,source:string>"
THRESHOLD = 0.5


def compiled(rules: Sequence[Rule]) -> list[tuple[str, re.Pattern]]:
    """Rules with their expressions; a bad one raises, so that nothing is let through because a rule was lost."""
    flag = {"IGNORECASE": re.IGNORECASE, "MULTILINE": re.MULTILINE, "DOTALL": re.DOTALL, "": 0}
    return [(kind, re.compile(p, sum(flag[f.strip()] for f in flags.split("|")))) for kind, p, flags in rules]


def load_rules(path: str) -> list[Rule]:
    """Rules from YAML: type -> expression, list of expressions, or list of {pattern, flags}. Read again for each plan."""
    import yaml

    out: list[Rule] = []
    for kind, entries in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).items():
        for e in [entries] if isinstance(entries, str | dict) else entries or []:
            out.append((kind, e, "") if isinstance(e, str) else (kind, e["pattern"], e.get("flags") or ""))
    compiled(out)
    return out


def regex_detector(rules: Sequence[Rule], source: str = "regex") -> Detector:
    patterns = compiled(rules)
    return lambda text: [(*m.span(), kind, 1.0, source) for kind, p in patterns for m in p.finditer(text) if m.end() > m.start()]


def detectors(language: str = "en", models: Sequence[Detector] = (), stub: bool = False) -> list[Detector]:
    """Models that are given, else the stub if asked for; rules always come last."""
    first = list(models) or ([regex_detector(fixed.STUB_RULES, "regex_stub")] if stub else [])
    return [*first, regex_detector(fixed.RULES[language])]


def winner(a: tuple, b: tuple, priority: dict[str, int]) -> tuple:
    """Of two conflicting spans: the higher priority, the better score, the shorter source, else the first."""
    rank = lambda x: (priority.get(x[2], 50), x[3], -len(x[4]))
    return b if rank(b) > rank(a) else a


def resolved(spans: list[tuple], priority: dict[str, int] = fixed.PRIORITY, threshold: float = THRESHOLD) -> list[tuple]:
    """Spans by start (equal ones in the order given) without conflicts with the last that was kept."""
    kept: list[tuple] = []
    for x in sorted(spans, key=lambda s: s[0]):
        if kept and x[0] < kept[-1][1]:
            last = kept[-1]
            share = (min(last[1], x[1]) - x[0]) / min(max(1, last[1] - last[0]), max(1, x[1] - x[0]))
            if share > threshold:
                kept[-1] = winner(last, x, priority)
                continue
        kept.append(x)
    return kept


SPAN_KIND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("score", pa.float64()), ("source", pa.string())])


def nested(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """An array of lists of structs from lists of tuples, column by column."""
    flat = [x for row in rows for x in row]
    columns = list(zip(*flat, strict=True)) if flat else [()] * kind.num_fields
    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), items)


#: Bytes and rows of texts that a Python worker holds the spans of at once: a text may have a span for every other word.
PORTION_BYTES, PORTION_ROWS = 1 << 18, 256


def portions(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows whose sizes sum to PORTION_BYTES at most, or of one larger row; none is left out."""
    first = end = held = 0
    for size in sizes:
        if end > first and (held + size > PORTION_BYTES or end - first == PORTION_ROWS):
            yield first, end
            first, held = end, 0
        end, held = end + 1, held + size
    if end > first:
        yield first, end


def portioned(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded texts, since Spark's batches have as many rows as a task gives, up to 10,000."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        for first, end in portions(sizes):
            yield batch.slice(first, end - first)


def widened(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + more


def spans_in(text: str, found_by: Sequence[Detector], resolve: bool = True) -> list[tuple]:
    spans = [s for d in found_by for s in d(text)]
    return resolved(spans) if resolve else spans


def detect(docs: DataFrame, found_by: Sequence[Detector], resolve: bool = True) -> DataFrame:
    """docs (doc_id, text and any other columns) with `entities`, an array of spans for each document.

    One pass over the texts in Arrow batches, without a shuffle: rules, union and resolution need one text at a time.
    Only expressions with Unicode classes as Python has them give the right spans, hence Python. Streams work alike.
    """
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portioned(batches, "text"):
            out = [spans_in(t or "", found_by, resolve) for t in batch.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, nested(out, SPAN_KIND)], [*names, "entities"])

    return docs.mapInArrow(each, widened(docs, f"entities array<{SPAN}>"))


def matches(docs: DataFrame, found_by: Sequence[Detector]) -> DataFrame:
    """Unresolved spans, a row each, with the detector's number and the order in which it found them (see MATCHES)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, end in portions(len(t or "") for t in frame["text"]):
                part = frame.iloc[first:end]
                rows = [(d, *s, k, i) for d, text in zip(part["doc_id"], part["text"], strict=True) for k, f in enumerate(found_by) for i, s in enumerate(f(text or ""))]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "type", "score", "source", "det_idx", "seq"])

    return docs.select("doc_id", "text").mapInPandas(each, MATCHES)


def resolve(spans: DataFrame, order: Sequence[str] = ("det_idx", "seq"), threshold: float = THRESHOLD) -> DataFrame:
    """Resolution of a table of spans (doc_id, start, end, type, score, source and the columns of order).

    A span that starts at or after the largest end before it is kept whatever came earlier, so a document falls into
    islands that are resolved on their own: a window finds them, and a fold over each island's few spans does the rest.
    """
    by = Window.partitionBy("doc_id").orderBy("start", *order)
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    names = F.create_map(*[F.lit(x) for pair in fixed.PRIORITY.items() for x in pair])
    priority = F.coalesce(F.element_at(names, F.col("type")), F.lit(50))
    item = F.struct("start", *order, "end", "type", "score", "source", priority.alias("priority"))
    grouped = marked.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(kept, x):
        last = F.element_at(kept, -1)
        size = lambda s: F.greatest(F.lit(1), s["end"] - s["start"])
        share = (F.least(last["end"], x["end"]) - x["start"]) / F.least(size(last), size(x))
        rank = lambda s: F.struct(s["priority"], s["score"], -F.length(s["source"]))
        replaced = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))
        conflict = (x["start"] < last["end"]) & (share > threshold)
        return F.when(~conflict, F.concat(kept, F.array(x))).when(rank(x) > rank(last), replaced).otherwise(kept)

    kept = F.aggregate(F.slice(F.col("items"), 2, F.size("items")), F.slice(F.col("items"), 1, 1), step)
    return grouped.select("doc_id", F.explode(kept).alias("s")).select("doc_id", *[F.col("s")[c].alias(c) for c in ("start", "end", "type", "score", "source")])


def normalized(spans: DataFrame, docs: DataFrame, language: str | None = None, source: str = "unknown") -> DataFrame:
    """Spans with every field: text from the document unless it is there, confidence and score from each other, else 0."""
    have = set(spans.columns)
    some = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(0.0))
    text = F.substring(docs.text, F.col("start") + 1, F.col("end") - F.col("start"))
    own = F.coalesce(*([spans["text"]] if "text" in have else []), text)
    joined = spans.join(docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else [])), "doc_id").where("type is not null")
    return joined.select(
        "doc_id", "type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), own.alias("text"), some("confidence", "score").alias("confidence"), some("confidence", "score").alias("score"),
        (F.coalesce("source", F.lit(source)) if "source" in have else F.lit(source)).alias("source"), (F.coalesce("language", F.lit(language)) if "language" in have else F.lit(language)).alias("language"),
    )


def deduped(spans: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first span, by order, of each (doc_id, start, end, type)."""
    w = Window.partitionBy("doc_id", "start", "end", "type").orderBy(*order)
    return spans.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def merged_overlaps(spans: DataFrame) -> DataFrame:
    """Spans of a type that overlap by more than half of the shorter, as chunked detectors give them, made one.

    A chain is folded by start; the score is the best.
    """
    by = Window.partitionBy("doc_id", "type").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = marked.groupBy("doc_id", "type", "island").agg(F.array_sort(F.collect_list(F.struct("start", "end", "score"))).alias("items"))

    def step(kept, x):
        last = F.element_at(kept, -1)
        short = F.least(last["end"] - last["start"], x["end"] - x["start"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.greatest(last["score"], x["score"]).alias("score"))
        join = F.least(last["end"], x["end"]) - x["start"] > short / 2
        return F.when(join, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(grown))).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.slice(F.col("items"), 2, F.size("items")), F.slice(F.col("items"), 1, 1), step)
    return grouped.select("doc_id", "type", F.explode(kept).alias("s")).select("doc_id", "s.start", "s.end", "type", "s.score")

"""Span datasets: BIO tags, alignment of tokens and of masked pairs, validation, windows and packing of tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions import fixed
from umbra.functions.text import java
from umbra.operators.detection import nested

SPANS = "array<struct<start:int,end:int,type:string,text:string>>"


def bio_tag(tag: Column) -> Column:
    """A BIO tag with its type made canonical; blank tags are O."""
    raw = F.trim(F.coalesce(tag, F.lit("O")))
    prefix = F.regexp_extract(raw, "^(B-|I-)", 1)
    base = F.regexp_replace(raw, "^(B-|I-)", "")
    names = F.create_map(*[F.lit(x) for pair in fixed.BIO_TYPES.items() for x in pair])
    return F.when(raw == "", "").when(raw == "O", "O").otherwise(F.concat(prefix, F.coalesce(F.element_at(names, base), base)))


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("text", pa.string())])


def tagged_spans(tokens: list[str], tags: list[str], separator: str) -> list[tuple[int, int, str, str]]:
    """Spans (start, end, type, text) of tokens joined by a separator; B or another type begins one, and I after O does."""
    whole, found, kind, at = separator.join(tokens), [], None, 0
    for token, tag in zip(tokens, tags, strict=False):
        end, prefix, own = at + len(token), tag[:2], None if tag == "O" else tag.partition("-")[2] or tag
        if own is not None:
            if prefix == "B-" or own != kind:
                found.append([at, end, own])
            else:
                found[-1][1] = end
        kind, at = own, end + len(separator)
    return [(s, e, k, whole[s:e]) for s, e, k in found]


def bio_spans(examples: DataFrame, separator: str = " ", key: str = "doc_id") -> DataFrame:
    """key, text, entities of token examples (key, tokens, tags): tokens joined, and spans of consecutive tags of a type.

    One pass of Arrow batches, linear in the tokens of a row, without a shuffle.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("tokens").to_pylist(), batch.column("tags").to_pylist(), strict=True))
            entities = nested([tagged_spans(t or [], g or [], separator) for t, g in rows], _SPAN)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([separator.join(t or []) for t, _ in rows], pa.string()), entities], [key, "text", "entities"])

    return examples.select(key, "tokens", "tags").mapInArrow(each, f"{key} {examples.schema[key].dataType.simpleString()}, text string, entities {SPANS}")


def decoded(tokens: list[tuple[str, int, int, float]]) -> list[tuple[int, int, str, float]]:
    """Spans of a model's (tag, start, end, score): an I without a span of its type before it is dropped; the best score."""
    out: list[tuple[int, int, str, float]] = []
    open_ = False
    for tag, start, end, score in tokens:
        prefix, _, raw = tag.partition("-")
        kind = fixed.MODEL_TYPES.get(raw)
        if prefix == "B" and kind:
            out.append((start, end, kind, score))
            open_ = True
        elif prefix == "I" and open_ and kind == out[-1][2]:
            out[-1] = (out[-1][0], end, kind, max(score, out[-1][3]))
        else:
            open_ = False
    return out


def token_labels(tokens: DataFrame, spans: DataFrame, order: str = "span_id") -> DataFrame:
    """tokens (doc_id, start, end, ...) with the BIO label of the first span, by order, that holds each whole.

    A token at (0, 0) stands for nothing and has the label IGNORE.
    """
    s = spans.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("type").alias("_type"), F.col(order).alias("_order"))
    on = (tokens.doc_id == s["_doc"]) & (tokens.start >= s["_start"]) & (tokens.end <= s["_end"])
    first = F.min_by(F.struct("_start", "_type"), "_order")
    out = tokens.join(s, on, "left").groupBy(*tokens.columns).agg(first.alias("hit"))
    label = F.when((F.col("start") == 0) & (F.col("end") == 0), "IGNORE").when(F.col("hit").isNull(), "O")
    return out.withColumn("label", label.otherwise(F.concat(F.when(F.col("hit._start") == F.col("start"), "B-").otherwise("I-"), F.col("hit._type")))).drop("hit")


def label_list(spans: DataFrame) -> DataFrame:
    """(id, label): O, and B and I of each type in order."""
    types = F.array_sort(F.collect_set("type"))
    labels = F.concat(F.array(F.lit("O")), F.flatten(F.transform(types, lambda t: F.array(F.concat(F.lit("B-"), t), F.concat(F.lit("I-"), t)))))
    return spans.where("type is not null and type <> ''").agg(labels.alias("labels")).select(F.posexplode("labels").alias("id", "label"))


def whitespace_tokens(df: DataFrame, key: str = "doc_id") -> DataFrame:
    from umbra.functions.text import finds

    return finds(df, [key], "text", java(r"\S+")).withColumnRenamed("found", "token")


_PAIR = re.compile(r"[<\[{]([A-Za-z_]+?)(?:_?\d+)?[>\]}]")


def pair_spans(original: str, masked: str) -> list[dict]:
    """Spans of what placeholders in masked stand for in original, by aligning their words."""
    a, b = list(re.finditer(r"\S+", original)), [m.group() for m in re.finditer(r"\S+", masked)]
    found: dict[tuple[int, int, str], None] = {}
    for op, i, j, k, n in SequenceMatcher(None, [m.group() for m in a], b, autojunk=False).get_opcodes():
        marks = [m for m in map(_PAIR.search, b[k:n]) if m] if op == "replace" else []
        kinds = [fixed.PAIR_TYPES.get(raw, raw) for raw in (m.group(1).strip().upper() for m in marks)]
        if len(kinds) == j - i:
            found |= dict.fromkeys((*m.span(), kind) for m, kind in zip(a[i:j], kinds, strict=True))
        elif kinds:
            found[a[i].start(), a[j - 1].end(), kinds[0] if len(set(kinds)) == 1 else "PII"] = None
    return [{"start": s, "end": e, "type": t, "text": original[s:e]} for s, e, t in found]


def masked_pairs(df: DataFrame, original: str = "original", masked: str = "masked") -> DataFrame:
    """df with text and entities; rows without either side or without entities are dropped."""

    @F.pandas_udf(SPANS)
    def align(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([pair_spans(a, b) for a, b in zip(x, y, strict=True)])

    some = df.where(f"length({original}) > 0 and length({masked}) > 0")
    return some.withColumn("text", F.col(original)).withColumn("entities", align(original, masked)).where("size(entities) > 0")


def issues(examples: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, entity_index, kind) for what is wrong with the entities of examples (key, text, entities).

    Kinds: missing_type, invalid_span, span_out_of_bounds, empty_span, text_mismatch, and overlap with the next valid span.
    """
    each = examples.select(key, "text", F.posexplode("entities").alias("entity_index", "e"))
    n, start, end = F.length("text"), F.col("e.start"), F.col("e.end")
    bad = F.when(start.isNull() | end.isNull(), "invalid_span").when((start < 0) | (end < 0) | (start > n) | (end > n), "span_out_of_bounds").when(start >= end, "empty_span")
    own = F.substring(F.col("text"), start + 1, end - start)
    marked = each.withColumn("bad", bad).withColumn("mismatch", F.col("bad").isNull() & F.col("e.text").isNotNull() & (F.col("e.text") != own))
    kinds = F.array_compact(F.array(F.when(F.coalesce(F.col("e.type"), F.lit("")) == "", "missing_type"), F.col("bad"), F.when(F.col("mismatch"), "text_mismatch")))
    alone = marked.select(key, "entity_index", F.explode(kinds).alias("kind"))
    order = Window.partitionBy(key).orderBy("e.start", "e.end", "entity_index")
    after = marked.where("bad is null").withColumn("next", F.lead("e.start").over(order)).where("next < e.end")
    return alone.unionByName(after.select(key, "entity_index", F.lit("overlap").alias("kind")))


def windows(df: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """(key, start, text): windows of `size` characters, half of it apart; the last ones may be short."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size // 2))
    some = df.where("length(text) > 0").select(key, "text", F.explode(starts).alias("start"))
    return some.select(key, "start", F.substring(F.col("text"), F.col("start") + 1, F.lit(size)).alias("text"))


def packed_blocks(examples: DataFrame, size: int, batch: int = 1000, order: str = "doc_id") -> DataFrame:
    """Blocks of `size` tokens (block, tokens) of the token lists of each run of `batch` rows, joined; tails are dropped.

    A run is rows whose order column has the same quotient by batch, so that runs don't depend on partitions.
    """

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        flat = [t for row in frame.sort_values(order)["tokens"] for t in row]
        rows = [(int(frame[order].iloc[0]) // batch, i, flat[i * size : (i + 1) * size]) for i in range(len(flat) // size)]
        return pd.DataFrame(rows, columns=["run", "block", "tokens"])

    kind = examples.schema["tokens"].dataType.simpleString()
    return examples.groupBy((F.col(order) / batch).cast("long").alias("r")).applyInPandas(each, f"run long, block long, tokens {kind}")


def greedy_chunks(df: DataFrame, cap: int, size: Callable[[str], int] | None = None, key: str = "doc_id", cut: int = 2000) -> DataFrame:
    """(key, chunk, text): lines gathered while their size (words, unless given) stays within cap; a long line is cut."""
    measure = size or (lambda t: len(t.split()))

    def chunks(text: str) -> list[str]:
        lines = (text or "").split("\n")
        if len(lines) == 1:
            return [text or ""]
        out, now = [], []
        for line in lines:
            if measure("\n".join([*now, line])) <= cap:
                now.append(line)
            elif now:
                out.append("\n".join(now))
                now = [line]
            else:
                out.append(line[:cut])
        return [c for c in [*out, "\n".join(now)] if c.strip()]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, c) for k, t in zip(frame[key], frame["text"], strict=True) for i, c in enumerate(chunks(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "text"])

    return df.select(key, "text").mapInPandas(each, f"{key} {df.schema[key].dataType.simpleString()}, chunk int, text string")

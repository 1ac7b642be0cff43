"""Documents as tables of segments with offsets and anchors, and joins of spans with segments and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a text are joined within buckets of so many characters, so that a long document isn't one key.
BUCKET = 4096


def _bucket(at: Column) -> Column:
    return F.floor(at / BUCKET)


def _buckets(start: Column, end: Column) -> Column:
    """All buckets that a stretch is in; an empty one is in that of its start."""
    return F.explode(F.sequence(_bucket(start), _bucket(F.greatest(start, end - 1))))


def segmented(segments: DataFrame, separator: str = "\n", order: str = "segment_id") -> DataFrame:
    """Segments (doc_id, segment_id, text, ...) with start and end in their document's text, the separator between them."""
    upto = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text") + len(separator)).over(upto) - len(separator)
    return segments.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("text")).cast("int"))


def built(segments: DataFrame, separator: str = "\n", order: str = "segment_id") -> DataFrame:
    """doc_id, text, context_hash: the document of each doc_id's segments in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    text = F.concat_ws(separator, F.transform(parts, lambda p: p["text"]))
    return segments.groupBy("doc_id").agg(text.alias("text")).withColumn("context_hash", F.sha2("text", 256))


def anchored(spans: DataFrame, segments: DataFrame, *carry: str) -> DataFrame:
    """Spans with the segment that holds them whole, and its columns in carry; null where a span crosses segments.

    Segments don't overlap, so that containment is an equi-join on doc_id and the bucket of the span's start, with a
    residual: at most one segment fits.
    """
    start, end = F.col("start"), F.col("end")
    s = segments.select(
        F.col("doc_id").alias("_doc"), start.alias("_start"), end.alias("_end"), "segment_id", *carry, _buckets(start, end).alias("_at")
    )
    on = (spans.doc_id == s["_doc"]) & (_bucket(spans.start) == s["_at"])
    on = on & (spans.start >= s["_start"]) & (spans.start < s["_end"]) & (spans.end <= s["_end"])
    return spans.join(s, on, "left").drop("_doc", "_start", "_end", "_at")


def overlapped(spans: DataFrame, segments: DataFrame, order: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """(doc_id, segment_id, bbox, and the span's columns): segments that a span overlaps, each box once, by the first span.

    Pages must be equal where both are known.
    """
    start, end = F.col("start"), F.col("end")
    own = (F.col("doc_id").alias("_doc"), start.alias("_start"), end.alias("_end"), "segment_id", "bbox")
    s = segments.select(*own, F.col("page_index").alias("_page"), _buckets(start, end).alias("_at"))
    spans = spans.withColumn("_bucket", _buckets(start, end))
    # What two stretches share begins at the later start: of the buckets that both are in, they meet in that one alone.
    on = (spans.doc_id == s["_doc"]) & (spans["_bucket"] == s["_at"])
    on = on & (_bucket(F.greatest(spans.start, s["_start"])) == s["_at"]) & (s["_end"] > spans.start) & (s["_start"] < spans.end)
    if "page_index" in spans.columns:
        on = on & F.coalesce(spans.page_index == s["_page"], F.lit(True))
    hit = spans.join(s, on).where("bbox is not null").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "_page", "bbox").orderBy(*order, "segment_id")))
    return hit.where("nth = 1").drop("nth", "_doc", "_start", "_end", "_at", "_bucket").withColumnRenamed("_page", "page")


def rects_in_blocks(spans: DataFrame, rects: DataFrame) -> DataFrame:
    """For each span (doc_id, span_id, block) the rects (doc_id, span_id, rect) that intersect its block; else the block."""
    r = rects.select(F.col("doc_id").alias("_doc"), F.col("span_id").alias("_span"), "rect")
    hit = (F.col("rect.left") < F.col("block.right")) & (F.col("rect.right") > F.col("block.left")) & (F.col("rect.top") < F.col("block.bottom")) & (F.col("rect.bottom") > F.col("block.top"))
    joined = spans.join(r, (spans.doc_id == r["_doc"]) & (spans.span_id == r["_span"]) & hit, "left")
    return joined.select(*spans.columns, F.coalesce("rect", "block").alias("redact"))


def united(boxes: DataFrame, *key: str) -> DataFrame:
    """The smallest box around all boxes (column bbox) of a key."""
    edge = lambda f, side: f(F.col(f"bbox.{side}")).alias(side)
    return boxes.groupBy(*key).agg(F.struct(edge(F.min, "left"), edge(F.min, "top"), edge(F.max, "right"), edge(F.max, "bottom")).alias("bbox"))


def boxes_of(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """The box around each span (doc_id, start, end), from blocks of characters (doc_id, start, end, bbox) that it meets."""
    start, end = F.col("start"), F.col("end")
    own = (F.col("doc_id").alias("_doc"), start.alias("_start"), end.alias("_end"), "bbox")
    b, spans = blocks.select(*own, _buckets(start, end).alias("_at")), spans.withColumn("_bucket", _buckets(start, end))
    on = (spans.doc_id == b["_doc"]) & (spans["_bucket"] == b["_at"]) & (b["_start"] < spans.end) & (b["_end"] > spans.start)
    met = spans.join(b, on)
    return united(met, "doc_id", "start", "end")


def cells(df: DataFrame, *key: str, sheet: str = "csv") -> DataFrame:
    """A row for each cell of a typed table: key columns, sheet, row, col (both from 1), address and text.

    key must give each row its number in column `row`.
    """
    others = [c for c in df.columns if c not in key]
    each = df.select(*key, F.posexplode(F.array(*[F.col(c).cast("string") for c in others])).alias("at", "text"))
    col = (F.col("at") + 1).cast("int")
    return each.select(*key, F.lit(sheet).alias("sheet"), col.alias("col"), F.concat(F.lit("R"), F.col("row"), F.lit("C"), col).alias("address"), F.coalesce("text", F.lit("")).alias("text"))

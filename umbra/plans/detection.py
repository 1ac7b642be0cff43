"""Queries of detection, resolution, rewriting and anchoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import fixed, text
from umbra.operators import detection, documents, rewriting
from umbra.plans.registry import dealt, query, spread, table
from umbra.sources import files, synthetic
from umbra.streaming import deid

_EMAIL = fixed.TYPE_PATTERNS["EMAIL"]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query()
def entity_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: all English rules, conflicts resolved, spans masked; how many spans and characters of each type."""
    masked = deid.deidentified(spread(spark, sf_dir, "documents").select("doc_id", "text"), mode="blackbox")
    each = masked.select(F.explode("events").alias("e"))
    return each.groupBy(F.col("e.entity_type").alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("e.replacement")).cast("long").alias("masked_chars"))


@query()
def deid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole de-identification of each document: entities, replaced text, events and replacement map."""
    out = deid.deidentified(spread(spark, sf_dir, "documents").select("doc_id", "text"), mode="replace")
    return out.select("doc_id", F.length("output").alias("chars"), F.size("entities").alias("n_entities"), F.sha2("output", 256).alias("output_sha256"), F.size("replacement_map").alias("n_replacements"), F.lit("1.0").alias("schema_version"))


def _type_counts_oracle() -> str:
    each = ", ".join(f"len(regexp_extract_all(text, {_quoted(p)}))::BIGINT AS n_{k.lower()}" for k, p in fixed.TYPE_PATTERNS.items())
    return f"SELECT doc_id, {each} FROM documents"


@query(_type_counts_oracle())
def type_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents")
    return docs.select("doc_id", *[F.regexp_count("text", F.lit(text.java(p))).cast("long").alias(f"n_{k.lower()}") for k, p in fixed.TYPE_PATTERNS.items()])


def _en_oracle() -> str:
    each = [f"len(regexp_extract_all(text, {_quoted(p)}))::BIGINT AS n_{k.lower()}" for k, p, _ in fixed.EN_RULES if k not in ("MEDICAL_ID", "EMAIL")]
    words = r"len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+'), lambda x: regexp_full_match(x, '[A-Za-z0-9]{6,12}')))::BIGINT AS n_medical_id"
    email = r"len(regexp_extract_all(text, '[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}'))::BIGINT AS n_email"
    return f"SELECT doc_id, {', '.join([*each, email, words])} FROM documents"


@query(_en_oracle())
def en_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents")
    return docs.select("doc_id", *[F.regexp_count("text", F.lit(text.java(p, f))).cast("long").alias(f"n_{k.lower()}") for k, p, f in fixed.EN_RULES])


_ZH_TEXT = (
    "'身分證A', lpad(CAST(c_custkey AS VARCHAR), 9, '1'), '，電話09', lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0'), '-345-678，信箱u', CAST(c_custkey AS VARCHAR), '@mail.example.tw，台北市信義區松仁路', "
    "CAST(c_custkey % 90 + 1 AS VARCHAR), '號 ', CAST(c_custkey % 20 + 1 AS VARCHAR), '樓，幸福里 12鄰', CAST(c_custkey % 7 + 1 AS VARCHAR), '號；統編', lpad(CAST(c_custkey AS VARCHAR), 8, '2')"
)


@query(
    f"WITH t AS (SELECT c_custkey, concat({_ZH_TEXT}) AS text FROM customer) SELECT c_custkey, "
    + ", ".join(
        f"len(regexp_extract_all(text, {_quoted(('(?i)' if 'IGNORECASE' in f else '') + p.replace(chr(92) + 'w', '[__]').replace('[[__]', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_'))}))::BIGINT AS n{i}_{k.lower()}"
        for i, (k, p, f) in enumerate(fixed.ZH_RULES)
    )
    + " FROM t"
)
def zh_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey")).selectExpr("c_custkey", f"concat({_ZH_TEXT.replace('VARCHAR', 'STRING')}) AS text")
    return rows.select("c_custkey", *[text.counted(F.col("text"), p, f).alias(f"n{i}_{k.lower()}") for i, (k, p, f) in enumerate(fixed.ZH_RULES)])


@query(
    f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, {_quoted(_EMAIL)}) AS m, regexp_split_to_array(text, {_quoted(_EMAIL)}) AS s FROM documents),
    e AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, s FROM p)
    SELECT doc_id, (i - 1)::INT AS idx, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INT AS start,
    (list_sum(list_transform(s[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::INT AS "end", m[i] AS found FROM e"""
)
def match_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.finds(spread(spark, sf_dir, "documents"), ["doc_id"], "text", text.java(_EMAIL))


def _masked_oracle(value: str) -> str:
    return f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, {_quoted(_EMAIL)}) AS m, regexp_split_to_array(text, {_quoted(_EMAIL)}) AS s FROM documents)
    SELECT doc_id, CASE WHEN len(m) = 0 THEN s[1] ELSE array_to_string(list_transform(m, lambda x, i: s[i] || {value}), '') || s[len(s)] END AS output FROM p"""


def _emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their e-mail addresses as entities, found in the JVM."""
    docs = spread(spark, sf_dir, "documents").select("doc_id", "text")
    found = text.finds(docs, ["doc_id"], "text", text.java(_EMAIL))
    entity = F.struct("start", "end", F.lit("EMAIL").alias("type"), F.lit(1.0).alias("score"), F.lit("regex").alias("source"))
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    return docs.join(listed, "doc_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(f"array<{detection.SPAN}>")))


@query(_masked_oracle("repeat('█', length(x)::BIGINT)"))
def blackbox_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewriting.rewritten_documents(_emails(spark, sf_dir), "blackbox").select("doc_id", "output")


_HEX = "('0x' || substring(sha256('EMAIL:' || x || ':' || c), 1, 12))::BIGINT"


@query(
    f"""WITH p AS (SELECT doc_id, sha256(text) AS c, regexp_extract_all(text, {_quoted(_EMAIL)}) AS m, regexp_split_to_array(text, {_quoted(_EMAIL)}) AS s FROM documents)
    SELECT doc_id, CASE WHEN len(m) = 0 THEN s[1] ELSE array_to_string(list_transform(m, lambda x, i: s[i] || 'user' || lpad(({_HEX} % 1000000)::VARCHAR, 6, '0') || '@example.com'), '') || s[len(s)] END AS output FROM p"""
)
def replace_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewriting.rewritten_documents(_emails(spark, sf_dir), "replace").select("doc_id", "output")


@query(
    f"""WITH e AS (SELECT DISTINCT doc_id, sha256(text) AS c, unnest(regexp_extract_all(text, {_quoted(_EMAIL)})) AS x FROM documents)
    SELECT doc_id, 'EMAIL:' || x AS "key", 'user' || lpad(({_HEX} % 1000000)::VARCHAR, 6, '0') || '@example.com' AS value FROM e"""
)
def replacement_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewriting.replacement_map(rewriting.events(rewriting.rewritten_documents(_emails(spark, sf_dir), "replace")))


@query("SELECT doc_id, sha256(text) AS context_hash, substring(sha256(text), 1, 16) AS short_hash, '<NAME:' || substring(sha256('NAME:' || lang || ':' || source), 1, 8) || '>' AS placeholder FROM documents")
def context_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents")
    return docs.select("doc_id", text.context_hash(F.col("text")).alias("context_hash"), text.short_hash(F.col("text")).alias("short_hash"), text.placeholder(F.lit("NAME"), F.col("lang"), F.col("source")).alias("placeholder"))


_SPANS_SQL = """SELECT l_orderkey AS doc_id, (l_partkey % 60)::INT AS start, (l_partkey % 60 + 1 + l_suppkey % 17)::INT AS "end", ['ID', 'EMAIL', 'NAME', 'OTHER'][(l_partkey % 4 + 1)::INT] AS type,
    (1 + l_suppkey % 3) / 4.0 AS score, repeat('s', 1 + (l_partkey % 3)::INT) AS source, l_linenumber AS seq FROM lineitem"""


def _order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spans, made of the lines of orders, as several detectors would give them."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    kinds = F.array(*map(F.lit, ("ID", "EMAIL", "NAME", "OTHER")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (part % 60).cast("int").alias("start"), (part % 60 + 1 + supp % 17).cast("int").alias("end"), F.element_at(kinds, (part % 4 + 1).cast("int")).alias("type"),
        ((1 + supp % 3) / 4.0).alias("score"), F.repeat(F.lit("s"), (1 + part % 3).cast("int")).alias("source"), F.lit(0).alias("det_idx"), F.col("l_linenumber").alias("seq"),
    )


_RANK = "(x).p > (l).p OR ((x).p = (l).p AND ((x).score > (l).score OR ((x).score = (l).score AND length((x).source) < length((l).source))))"


@query(
    f"""WITH s AS ({_SPANS_SQL}), g AS (SELECT doc_id, list([struct_pack(s := start, q := seq, e := "end", type := type, score := score, source := source,
        p := CASE type WHEN 'ID' THEN 100 WHEN 'EMAIL' THEN 80 WHEN 'NAME' THEN 75 ELSE 50 END)] ORDER BY start, seq, "end", type, score, source) AS items FROM s GROUP BY doc_id),
    f AS (SELECT doc_id, list_reduce(items, lambda a, b: CASE
        WHEN b[1].s >= a[len(a)].e OR (least(a[len(a)].e, b[1].e) - b[1].s) / least(a[len(a)].e - a[len(a)].s, b[1].e - b[1].s)::DOUBLE <= 0.5 THEN list_concat(a, b)
        WHEN b[1].p > a[len(a)].p OR (b[1].p = a[len(a)].p AND (b[1].score > a[len(a)].score OR (b[1].score = a[len(a)].score AND length(b[1].source) < length(a[len(a)].source)))) THEN list_concat(a[1:len(a) - 1], b)
        ELSE a END) AS kept FROM g), u AS (SELECT doc_id, unnest(kept) AS k FROM f)
    SELECT doc_id, k.s AS start, k.e AS "end", k.type AS type, k.score::DOUBLE AS score, k.source AS source FROM u"""
)
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.resolve(_order_spans(spark, sf_dir))


@query(
    f"""WITH s AS ({_SPANS_SQL}) SELECT doc_id, start, "end", type, score::DOUBLE AS score, source, seq FROM s
    QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end", type ORDER BY seq, score, source) = 1"""
)
def first_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first span of each place and type."""
    return detection.deduped(_order_spans(spark, sf_dir), ("seq", "score", "source")).drop("det_idx")


@query()
def merged_chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.merged_overlaps(_order_spans(spark, sf_dir))


@query(
    """WITH s AS (SELECT conv_id AS doc_id, turn AS segment_id, text, length(text) AS n FROM conversations)
    SELECT doc_id, segment_id, (sum(n + 1) OVER (PARTITION BY doc_id ORDER BY segment_id) - 1 - n)::INT AS start, (sum(n + 1) OVER (PARTITION BY doc_id ORDER BY segment_id) - 1)::INT AS "end" FROM s"""
)
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.segmented(_turns(spark, sf_dir)).select("doc_id", "segment_id", "start", "end")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("segment_id"), "text")


@query("SELECT conv_id AS doc_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS context_hash, length(string_agg(text, chr(10) ORDER BY turn))::INT AS n_chars FROM conversations GROUP BY conv_id")
def built_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.built(_turns(spark, sf_dir)).select("doc_id", "context_hash", F.length("text").alias("n_chars"))


_SEGMENTS_SQL = """s AS (SELECT conv_id AS doc_id, turn AS segment_id, length(text) AS n FROM conversations),
    g AS (SELECT doc_id, segment_id, (sum(n + 1) OVER (PARTITION BY doc_id ORDER BY segment_id) - 1 - n)::INT AS b, (sum(n + 1) OVER (PARTITION BY doc_id ORDER BY segment_id) - 1)::INT AS e FROM s),
    m AS (SELECT doc_id, max(e) AS total FROM g GROUP BY doc_id), i AS (SELECT doc_id, unnest(range(0, total, 97))::INT AS start FROM m)"""


def _probe_spans(segments: DataFrame) -> DataFrame:
    """A span of 23 characters every 97 characters of each document."""
    total = segments.groupBy("doc_id").agg(F.max("end").alias("total")).where("total > 0")
    starts = F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(97))).alias("start")
    return total.select("doc_id", starts).withColumn("end", F.col("start") + 23)


@query(f'WITH {_SEGMENTS_SQL} SELECT i.doc_id, i.start, i.start + 23 AS "end", coalesce(g.segment_id, -1) AS segment_id FROM i LEFT JOIN g ON i.doc_id = g.doc_id AND i.start >= g.b AND i.start < g.e AND i.start + 23 <= g.e')
def anchored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = documents.segmented(_turns(spark, sf_dir))
    return documents.anchored(_probe_spans(segments), segments).withColumn("segment_id", F.coalesce("segment_id", F.lit(-1).cast("long")))


@query(
    f"""WITH {_SEGMENTS_SQL}, h AS (SELECT i.doc_id, i.start, i.start + 23 AS "end", g.segment_id, (g.segment_id % 3)::INT AS page,
        row_number() OVER (PARTITION BY i.doc_id, g.segment_id % 3, g.segment_id ORDER BY i.start, i.start + 23, g.segment_id) AS nth FROM i JOIN g ON i.doc_id = g.doc_id AND g.e > i.start AND g.b < i.start + 23)
    SELECT doc_id, start, "end", segment_id, page, (10 * segment_id)::INT AS "top" FROM h WHERE nth = 1"""
)
def overlapped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = documents.segmented(_turns(spark, sf_dir))
    top = (F.col("segment_id") * 10).cast("int")
    boxes = segments.withColumn("page_index", (F.col("segment_id") % 3).cast("int")).withColumn("bbox", F.struct(F.lit(0).alias("left"), top.alias("top"), F.lit(100).alias("right"), (top + 8).alias("bottom")))
    return documents.overlapped(_probe_spans(segments), boxes).select("doc_id", "start", "end", "segment_id", "page", F.col("bbox.top").alias("top"))


_BOX = "(l_partkey % 50)::INT AS l, (l_suppkey % 50)::INT AS t, (l_partkey % 50 + 10)::INT AS r, (l_suppkey % 50 + 5)::INT AS b"


def _line_boxes(spark: SparkSession, sf_dir: str, *key: str) -> DataFrame:
    left, top = (F.col("l_partkey") % 50).cast("int"), (F.col("l_suppkey") % 50).cast("int")
    box = F.struct(left.alias("left"), top.alias("top"), (left + 10).alias("right"), (top + 5).alias("bottom"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("span_id"), box.alias("bbox"))


@query(f"WITH x AS (SELECT l_orderkey AS doc_id, {_BOX} FROM lineitem) SELECT doc_id, min(l) AS \"left\", min(t) AS top, max(r) AS \"right\", max(b) AS bottom FROM x GROUP BY doc_id")
def united_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.united(_line_boxes(spark, sf_dir), "doc_id").select("doc_id", "bbox.*")


@query(
    f"""WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS span_id, {_BOX} FROM lineitem), s AS (SELECT DISTINCT doc_id FROM x)
    SELECT s.doc_id, coalesce(x.l, 20) AS "left", coalesce(x.t, 20) AS top, coalesce(x.r, 40) AS "right", coalesce(x.b, 40) AS bottom FROM s LEFT JOIN x ON s.doc_id = x.doc_id AND l < 40 AND r > 20 AND t < 40 AND b > 20"""
)
def rects_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _line_boxes(spark, sf_dir).withColumn("span_id", F.lit(0)).withColumnRenamed("bbox", "rect")
    block = F.struct(F.lit(20).alias("left"), F.lit(20).alias("top"), F.lit(40).alias("right"), F.lit(40).alias("bottom"))
    spans = boxes.select("doc_id", "span_id").distinct().withColumn("block", block)
    return documents.rects_in_blocks(spans, boxes).select("doc_id", "redact.*")


@query(
    """WITH x AS (SELECT n_nationkey, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS text, unnest([1, 2, 3]) AS col FROM nation)
    SELECT n_nationkey + 1 AS "row", 'csv' AS sheet, col::INT AS col, 'R' || (n_nationkey + 1) || 'C' || col AS address, text FROM x"""
)
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumn("row", (F.col("n_nationkey") + 1).cast("int")).select("row", "n_nationkey", "n_name", "n_regionkey")
    return documents.cells(nations, "row")


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.html_texts(spread(spark, sf_dir, "pages")).select("page_id", "url", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query()
def html_text_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.html_texts(spread(spark, sf_dir, "pages"), collapse=True).select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query()
def seeded_fake_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", synthetic.pick(F.col("c_custkey"), "kind", ["ID", "PHONE", "EMAIL", "NAME", "ADDRESS", "PASSPORT", "MEDICAL_ID", "OTHER"]).alias("type"), F.col("c_name").alias("original"), F.sha2("c_mktsegment", 256).alias("context_hash"))
    return rewriting.fake_values(rows).select("c_custkey", "type", "value")


@query("SELECT 'nation' AS path, (n_nationkey + 1)::INT AS \"row\", n_nationkey || ',##' || substring(n_name, 3) || ',\"' || n_regionkey || ',x\"' AS line FROM nation")
def rebuilt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines with the first two letters of each name replaced in its cell."""
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("row"), "n_nationkey", "n_name", F.concat("n_regionkey", F.lit(",x")).alias("n_regionkey"))
    cells = documents.cells(nations, "row").select(F.lit("nation").alias("path"), (F.col("row") * 3 + F.col("col")).alias("segment_id"), F.struct("sheet", "address", "row", "col").alias("cell"), "text")
    names = cells.where("cell.col = 2").select("path", "segment_id", F.lit(0).alias("seq"), F.substring("text", 1, 2).alias("original"), F.lit("##").alias("value"))
    return files.csv_lines(files.rebuilt_cells(cells, names))

"""Queries of span datasets, corpora, sampling and synthetic data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import fixed, text
from umbra.operators import corpus, rewriting, spans
from umbra.plans.registry import dealt, query, spread, table
from umbra.sources import synthetic

#: Raw type names that exercise exact names, hints, order and unknown ones.
_RAW = (
    "PER", " lastname ", "PATIENT_LAST_NAME_1", "PHONE_2", "UNKNOWN_CUSTOM_FIELD", "e-mail address", "user name", "medical record id", "patient-id", "ssn", "tel_home", "birth day", "WEB SITE", "Card No", "iban2", "plate",
    "ages", "zip code", "hospital", "123", "", "shipping", "account_number_12", "time_zone", "license no", "mobile", "handle-7", "postal", "passport number", "credit limit",
)


def _canonical_sql(raw: str) -> str:
    key = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim({raw})), '[- ]', '_', 'g'), '(?:[_-]?[0-9]+)+$', ''), '[^A-Z_]+', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"""
    exact = " ".join(f"WHEN k IN ({', '.join(repr(n) for n in names.split())}) THEN '{kind}'" for kind, names in fixed.TYPE_NAMES.items())
    hints = " ".join(f"WHEN regexp_matches(k, '{hint}'){' AND NOT contains(k, ' + repr('USER') + ')' if kind == 'NAME' else ''} THEN '{kind}'" for kind, hint in fixed.TYPE_HINTS)
    return f"(SELECT CASE WHEN k IS NULL OR k = '' THEN NULL {exact} {hints} ELSE 'PII' END FROM (SELECT {key} AS k))"


_NAMES_SQL = f"(SELECT unnest([{', '.join(repr(x) for x in _RAW)}]) AS raw UNION ALL SELECT DISTINCT event_type || '_' || (user_id % 9) FROM events)"


@query(f"SELECT raw, {_canonical_sql('raw')} AS type, count(*) AS n FROM {_NAMES_SQL} GROUP BY raw")
def canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("_"), (F.col("user_id") % 9)).alias("raw")).distinct()
    every = spark.createDataFrame([(x,) for x in _RAW], "raw string").unionByName(names)
    return every.groupBy("raw").agg(F.count("*").alias("n")).withColumn("type", text.canonical_type(F.col("raw")))


def _placeholder_text(key: Column) -> Column:
    kinds = F.array(*map(F.lit, ("LASTNAME_1", "email", "PHONE_2", "custom_field", "USER_NAME")))
    one = lambda salt: F.element_at(kinds, (key + salt) .cast("int") % 5 + 1)
    return F.concat(F.lit("Dear <"), one(0), F.lit(">, write to ["), one(1), F.lit("] or {"), one(2), F.lit("]. "), key.cast("string"))


_KINDS_SQL = "['LASTNAME_1', 'email', 'PHONE_2', 'custom_field', 'USER_NAME']"
_MAPPED_SQL = "['NAME', 'EMAIL', 'PHONE', 'PII', 'USERNAME']"


def _letter(kinds: str) -> str:
    one = lambda salt: f"{kinds}[((c_custkey + {salt}) % 5 + 1)::INT]"
    return f"'Dear <' || {one(0)} || '>, write to [' || {one(1)} || '] or {{' || {one(2)} || ']. ' || c_custkey"


@query(f"SELECT c_custkey, {_letter(_MAPPED_SQL)} AS text FROM customer")
def canonical_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey"))
    return rows.select("c_custkey", text.canonical_placeholders(_placeholder_text(F.col("c_custkey"))).alias("text"))


@query()
def filled_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    return rows.select("c_custkey", rewriting.filled_placeholders(_placeholder_text(F.col("c_custkey")), F.sha2("c_name", 256)).alias("text"))


def _marked(key: Column, value: Column, bracket: Column) -> Column:
    xml = F.concat(F.lit('To <PII type="EMAIL">u'), key, F.lit("@x.org</PII> from <PII type='NAME'>"), value, F.lit("</PII>."))
    return F.when(bracket, F.concat(F.lit("To [EMAIL]u"), key, F.lit("@x.org[/EMAIL] from [NAME]"), value, F.lit("[/NAME]."))).otherwise(xml)


@query(
    """SELECT c_custkey, 'To ~ from ~.' AS masked, 2::INT AS n_blocks,
    (CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 21 END)::INT AS "start", (CASE WHEN c_custkey % 2 = 0 THEN 'bracket' ELSE 'xml' END) AS fmt, 'u' || c_custkey || '@x.org' AS first_value, c_name AS second_value FROM customer"""
)
def markup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("text", _marked(F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_custkey") % 2 == 0))
    out = rows.withColumn("b", rewriting.markup_blocks(F.col("text")))
    return out.select("c_custkey", rewriting.masked_markup(F.col("text"), "~").alias("masked"), F.size("b").alias("n_blocks"), F.col("b")[0]["start"].alias("start"), rewriting.markup_format(F.col("text")).alias("fmt"), F.col("b")[0]["value"].alias("first_value"), F.col("b")[1]["value"].alias("second_value"))


_TAGS = ("O", "B-NAME", "I-NAME", "I-LOC", "B-LOC", "O", "O")
_WORDS = "list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')"


def _tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of conversations, tagged by their lengths."""
    words = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")
    tags = F.array(*map(F.lit, _TAGS))
    rows = spread(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), words.alias("tokens"))
    return rows.withColumn("tags", F.transform("tokens", lambda w: F.element_at(tags, F.length(w) % 7 + 1)))


@query(
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, {_WORDS} AS w FROM conversations), x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
    y AS (SELECT *, {list(_TAGS)}[(length(word) % 7 + 1)::INT] AS tag, (sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS e FROM x),
    z AS (SELECT *, CASE WHEN tag = 'O' THEN NULL ELSE split_part(tag, '-', 2) END AS kind FROM y),
    b AS (SELECT *, CASE WHEN kind IS NOT NULL AND (tag[1:2] = 'B-' OR lag(kind) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM kind) THEN 1 ELSE 0 END AS new FROM z),
    c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM b WHERE TRUE)
    SELECT doc_id, min(e - length(word))::INT AS start, max(e)::INT AS "end", any_value(kind) AS type FROM c WHERE kind IS NOT NULL GROUP BY doc_id, island"""
)
def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = spans.bio_spans(_tagged_words(spark, sf_dir))
    return examples.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.start", "e.end", "e.type")


@query("SELECT unnest(range(0, 5))::INT AS id, unnest(['O', 'B-LOC', 'I-LOC', 'B-NAME', 'I-NAME']) AS label")
def label_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = spans.bio_spans(_tagged_words(spark, sf_dir)).select(F.explode("entities").alias("e")).select("e.type")
    return spans.label_list(each)


@query("SELECT raw AS tag, CASE raw WHEN '' THEN '' WHEN 'O' THEN 'O' WHEN 'B-PER' THEN 'B-NAME' WHEN 'I-LOC' THEN 'I-ADDRESS' WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'B-X' THEN 'B-X' END AS canonical FROM (SELECT unnest(['', 'O', 'B-PER', 'I-LOC', 'ORG', 'B-X']) AS raw)")
def bio_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ("", "O", "B-PER", "I-LOC", "ORG", "B-X")], "tag string").withColumn("canonical", spans.bio_tag(F.col("tag")))


@query(
    r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS m, regexp_split_to_array(text, '[^ \t\n\r\f\v]+') AS s FROM documents), x AS (SELECT doc_id, unnest(m) AS w, unnest(s[1:len(m)]) AS b, generate_subscripts(m, 1) AS i FROM p),
    t AS (SELECT doc_id, (sum(length(w) + length(b)) OVER (PARTITION BY doc_id ORDER BY i))::INT AS e, length(w) AS n FROM x)
    SELECT label, count(*) AS n FROM (SELECT CASE WHEN e - n = 0 AND e = 0 THEN 'IGNORE' WHEN floor((e - n) / 40) = floor((e - 1) / 40) AND (e - n) % 40 >= 5 AND (e - 1) % 40 < 30 THEN CASE WHEN (e - n) % 40 = 5 THEN 'B-NAME' ELSE 'I-NAME' END ELSE 'O' END AS label FROM t) GROUP BY label"""
)
def token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the words of documents against spans of 25 characters every 40."""
    docs = spread(spark, sf_dir, "documents")
    tokens = spans.whitespace_tokens(docs).select("doc_id", "start", "end", (F.col("start") / 40).cast("long").alias("span_id"))
    some = docs.where("length(text) > 5").select("doc_id", F.explode(F.sequence(F.lit(5), F.length("text"), F.lit(40))).alias("start"))
    every = some.select("doc_id", "start", (F.col("start") + 25).alias("end"), F.lit("NAME").alias("type"), (F.col("start") / 40).cast("long").alias("place"))
    # Spans are one for each 40 characters, so that the containment join needs one bucket of them, not all of a text's.
    s = every.select(F.col("doc_id").alias("d"), "place", F.col("start").alias("b"), F.col("end").alias("e"), "type")
    hit = tokens.join(s, (tokens.doc_id == s.d) & (tokens.span_id == s.place) & (tokens.start >= s.b) & (tokens.end <= s.e), "left")
    label = F.when(F.col("b").isNull(), "O").otherwise(F.concat(F.when(F.col("b") == F.col("start"), "B-").otherwise("I-"), F.col("type")))
    return hit.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as entities of the texts of customers' names, some of them wrong in every way."""
    lines = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    start = F.when(part % 11 == 0, F.lit(None).cast("int")).otherwise((part % 30 - 2).cast("int"))
    end = start + (F.col("l_suppkey") % 9 - 1).cast("int")
    kind = F.when(part % 13 == 0, "").otherwise(F.element_at(F.array(*map(F.lit, ("ID", "NAME", "EMAIL"))), (part % 3 + 1).cast("int")))
    own = F.when(part % 5 == 0, "wrong")
    each = lines.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.struct(start.alias("start"), end.alias("end"), kind.alias("type"), own.alias("text")).alias("e"))
    grouped = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "e"))).alias("x"))
    return grouped.select("doc_id", F.concat(F.lit("The quick brown fox "), F.col("doc_id").cast("string")).alias("text"), F.transform("x", lambda y: y["e"]).alias("entities"))


_EXAMPLES_SQL = """x AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, length('The quick brown fox ' || l_orderkey) AS n, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 30 - 2 END AS s,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 30 - 2 + l_suppkey % 9 - 1 END AS e, CASE WHEN l_partkey % 13 = 0 THEN '' ELSE ['ID', 'NAME', 'EMAIL'][(l_partkey % 3 + 1)::INT] END AS type, CASE WHEN l_partkey % 5 = 0 THEN 'wrong' END AS own FROM lineitem),
    k AS (SELECT *, CASE WHEN s IS NULL THEN 'invalid_span' WHEN s < 0 OR e < 0 OR s > n OR e > n THEN 'span_out_of_bounds' WHEN s >= e THEN 'empty_span' END AS bad FROM x),
    o AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s, e, i) AS nx FROM k WHERE bad IS NULL)"""


@query(
    f"""WITH {_EXAMPLES_SQL} SELECT kind, count(*) AS n FROM (SELECT 'missing_type' AS kind FROM k WHERE type = '' UNION ALL SELECT bad FROM k WHERE bad IS NOT NULL
    UNION ALL SELECT 'text_mismatch' FROM k WHERE bad IS NULL AND own IS NOT NULL UNION ALL SELECT 'overlap' FROM o WHERE nx < e) GROUP BY kind"""
)
def span_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quality_report(_examples(spark, sf_dir))["issue_counts"]


@query(f"WITH {_EXAMPLES_SQL} SELECT type, count(*) AS n FROM k WHERE type <> '' GROUP BY type")
def span_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quality_report(_examples(spark, sf_dir))["type_counts"]


@query(
    f"""WITH {_EXAMPLES_SQL}, i AS (SELECT doc_id FROM k WHERE type = '' OR bad IS NOT NULL OR own IS NOT NULL UNION SELECT doc_id FROM o WHERE nx < e)
    SELECT 'examples' AS measure, count(DISTINCT doc_id)::BIGINT AS n FROM k UNION ALL SELECT 'entities', count(*) FROM k UNION ALL SELECT 'invalid_examples', count(*) FROM i UNION ALL SELECT 'invalid_entities', count(*) FROM k WHERE bad IS NOT NULL"""
)
def span_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quality_report(_examples(spark, sf_dir))["totals"]


@query(
    """SELECT lang, min(length(text))::DOUBLE AS "min", max(length(text))::DOUBLE AS "max", round(avg(length(text)), 6) AS mean, median(length(text))::DOUBLE AS p50,
    (list(length(text) ORDER BY length(text)))[(floor(0.95 * (count(*) - 1)) + 1)::INT]::DOUBLE AS p95 FROM documents GROUP BY lang"""
)
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents").select("lang", F.length("text").alias("v"))
    return corpus.summary(docs, "v", "lang").withColumn("mean", F.round("mean", 6))


@query("SELECT source, count(*) AS n, round(avg(n_chars), 6) AS \"avg\", min(n_chars) AS \"min\", max(n_chars) AS \"max\" FROM documents GROUP BY source")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("f."), F.col("source")))
    out = corpus.per_format(docs, "n_chars")
    return out.select(F.expr("substring(ext, 2)").alias("source"), "n", F.round("avg", 6).alias("avg"), "min", "max")


_MIX_SQL = """(SELECT item_id AS id, text, 'benchmark' AS source, 0 AS source_idx FROM benchmark ORDER BY item_id LIMIT 25) UNION ALL SELECT doc_id, text, 'documents', 1 FROM documents"""


@query(f"SELECT id, source, source_idx, sha256(text) AS text_sha256 FROM ({_MIX_SQL})")
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 benchmark items (the cap is the feature) and all documents, shuffled by hash."""
    a, b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), spread(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return corpus.mixed([("benchmark", a, 25), ("documents", b, 0)], "id", seed=7).select("id", "source", "source_idx", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id, lang FROM documents ORDER BY sha256('3:' || doc_id), doc_id LIMIT 200")
def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sampled(spread(spark, sf_dir, "documents").select("doc_id", "lang"), 200, "doc_id", seed=3)


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS text_sha256 FROM documents WHERE length(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) >= 200")
def lm_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lm_corpus(spread(spark, sf_dir, "documents"), 200, cjk=False).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query(
    r"""WITH x AS (SELECT conv_id || ':' || turn AS id, text AS a, lower(text) AS b FROM conversations), p AS (SELECT id, a, b, list_filter(string_split(a, chr(10)), lambda t: regexp_matches(t, '[^ \t\n\r\f\v]')) AS pa, list_filter(string_split(b, chr(10)), lambda t: regexp_matches(t, '[^ \t\n\r\f\v]')) AS pb FROM x),
    q AS (SELECT id, CASE WHEN contains(a, chr(10)) AND len(pa) = len(pb) AND len(pa) > 1 THEN pa ELSE [a] END AS pa, CASE WHEN contains(a, chr(10)) AND len(pa) = len(pb) AND len(pa) > 1 THEN pb ELSE [b] END AS pb FROM p),
    r AS (SELECT id, unnest(pa) AS a, unnest(pb) AS b, generate_subscripts(pa, 1) AS i FROM q)
    SELECT CASE WHEN i > 1 THEN id || ':' || (i - 1) ELSE id END AS id, trim('Mask: ' || a || ' => ' || b) AS text FROM r"""
)
def pairs_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spread(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit(":"), "turn").alias("id"), F.col("text").alias("input"), F.lower("text").alias("output"))
    return corpus.pairs_corpus(pairs, "Mask: {RAW_TEXT} => ")


@query()
def rewriter_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rewriting.noisy(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), seed=5)
    return corpus.rewriter_corpus(rows, "en", 20).select("doc_id", "text")


@query()
def masked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from conversations and the same texts with every sixth letter's words masked."""
    rows = spread(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("text").alias("original"))
    rows = rows.withColumn("masked", F.regexp_replace("original", r"\b[A-Z]\w+", "<NAME_1>"))
    return spans.masked_pairs(rows).select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")


@query("SELECT doc_id, start, substring(text, start + 1, 512) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 256))::INT AS start FROM documents)")
def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.windows(spread(spark, sf_dir, "documents"), 512)


@query(
    r"""WITH t AS (SELECT doc_id, doc_id // 1000 AS run, string_split_regex(text, '\s+') AS w FROM documents),
    k AS (SELECT doc_id, run, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM t),
    n AS (SELECT run, token, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) - 1 AS i FROM k)
    SELECT run, i // 128 AS block, sha256(string_agg(token, ' ' ORDER BY i)) AS tokens_sha256 FROM n GROUP BY run, i // 128 HAVING count(*) = 128"""
)
def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark, sf_dir, "documents").select("doc_id", F.split("text", r"\s+").alias("tokens"))
    return spans.packed_blocks(rows, 128).select("run", "block", F.sha2(F.concat_ws(" ", "tokens"), 256).alias("tokens_sha256"))


@query()
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.greedy_chunks(spread(spark, sf_dir, "documents"), 64).select("doc_id", "chunk", F.length("text").alias("n_chars"))


def _digits_sql(key: str, salt: str, size: int) -> str:
    return f"lpad((('0x' || substring(sha256({key} || ':{salt}'), 1, 12))::BIGINT % {10**size})::VARCHAR, {size}, '0')"


def _pick_sql(key: str, salt: str, values: tuple[str, ...]) -> str:
    return f"{list(values)}[(('0x' || substring(sha256({key} || ':{salt}'), 1, 12))::BIGINT % {len(values)} + 1)::INT]"


@query(
    f"""WITH v AS (SELECT c_custkey AS doc_id, {_pick_sql('c_custkey', 'name', fixed.NAMES['zh'])} AS a, '09' || {_digits_sql('c_custkey', 'phone', 8)} AS p, 'user' || c_custkey || {_digits_sql('c_custkey', 'user', 4)} || '@example.com' AS m,
    {_pick_sql('c_custkey', 'address', fixed.ADDRESSES['zh'])} AS d, {_pick_sql('c_custkey', 'letter', tuple(fixed.ID_LETTERS))} || {_digits_sql('c_custkey', 'id', 9)} AS i FROM customer)
    SELECT doc_id, '病患姓名：' || a || '。' || chr(10) || '聯絡方式：' || p || ', ' || m || '。' || chr(10) || '地址：' || d || '.' || chr(10) || '身分證：' || i || '。' || chr(10) AS text, a AS name, m AS email, i AS id FROM v"""
)
def synthetic_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic.span_examples(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), "zh")
    own = lambda i: F.substring(F.col("text"), F.col("entities")[i]["start"] + 1, F.col("entities")[i]["end"] - F.col("entities")[i]["start"])
    return rows.select("doc_id", "text", own(0).alias("name"), own(2).alias("email"), own(4).alias("id"))


@query()
def synthetic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.values(dealt(table(spark, sf_dir, "customer").select("c_custkey")), "c_custkey")


@query()
def synthetic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.documents(dealt(table(spark, sf_dir, "customer").select("c_custkey")), "c_custkey")


@query("SELECT c_custkey, 'Contact <NAME>, <EMAIL>.' AS text FROM customer")
def span_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of customers' names and addresses replaced by canonical placeholders."""
    mail = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.org"))
    n, m = F.length("c_name"), F.length(mail)
    one = lambda start, size, kind: F.struct(start.alias("start"), (start + size).alias("end"), F.lit(kind).alias("type"))
    entities = F.array(one(F.lit(8), n, "PATIENT_LAST_NAME_1"), one(F.lit(10) + n, m, "email address"), one(F.lit(-1), n, "ID"), one(F.lit(5), F.lit(0), "ID"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Contact "), "c_name", F.lit(", "), mail, F.lit(".")).alias("text"), entities.alias("entities"))
    return rows.select("c_custkey", rewriting.with_placeholders(F.col("text"), F.col("entities")).alias("text"))

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from umbra.functions import fixed, text
from umbra.operators import detection, documents, rewriting
from umbra.streaming import deid


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_zh_rules_and_their_worked_conflict(spark):
    found = detection.detect(docs_of(spark, "ID A123456789 and phone 0912345678."), detection.detectors("zh")).first().entities
    assert [(e.start, e.end, e.type) for e in found] == [(3, 13, "ID"), (24, 34, "PHONE")]
    raw = detection.matches(docs_of(spark, "A123456789"), detection.detectors("zh")).collect()
    assert sorted((r.type, r.start, r.end) for r in raw) == [("ID", 0, 10), ("MEDICAL_ID", 0, 9), ("PASSPORT", 0, 9), ("UNIFIED_BUSINESS_NO", 1, 9)]


def test_en_rules(spark):
    found = detection.detect(docs_of(spark, "SSN 123-45-6789, mail a.b@c.org, 12 Main Street"), detection.detectors("en")).first().entities
    assert {"ID", "EMAIL", "ADDRESS"} <= {e.type for e in found}


def test_offsets_are_those_of_python_in_any_script(spark):
    import re

    texts = ["電話0912-345-678，信箱u@例.tw 😀 a@b.org", "é@é.com ünï@x.org", "", "no match", None, "a@b.org" * 3]
    got = {}
    for r in text.finds(docs_of(spark, *texts), ["doc_id"], "text", text.java(fixed.EN_RULES[2][1])).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.found))
    for d, t in enumerate(texts):
        assert sorted(got.get(d, [])) == [(*m.span(), m.group()) for m in re.finditer(fixed.EN_RULES[2][1], t or "")]


def random_spans(rng, n):
    out = []
    for i in range(n):
        s = rng.randint(0, 40)
        out.append((s, s + rng.randint(1, 14), rng.choice(["ID", "EMAIL", "NAME", "X", "Y"]), rng.choice([0.5, 1.0]), "s" * rng.randint(1, 3), 0, i))
    return out


def test_resolution_of_tables_is_that_of_single_texts(spark):
    rng = random.Random(1)
    rows = [(d, *s) for d in range(150) for s in random_spans(rng, rng.randint(0, 14))]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, type string, score double, source string, det_idx int, seq int")
    got = sorted(tuple(r) for r in detection.resolve(df).collect())
    want = sorted((d, *s[:5]) for d in range(150) for s in detection.resolved([r[1:] for r in rows if r[0] == d]))
    assert got == want


def test_winners():
    pick = lambda *spans: detection.resolved(list(spans))
    assert pick((0, 10, "NAME", 1.0, "a"), (0, 10, "ID", 0.1, "a"))[0][2] == "ID"
    assert pick((0, 10, "X", 0.4, "a"), (0, 10, "Y", 0.5, "aaa"))[0][2] == "Y"
    assert pick((0, 10, "X", 0.5, "aaa"), (0, 10, "Y", 0.5, "a"))[0][2] == "Y"
    assert pick((0, 10, "X", 0.5, "a"), (0, 10, "Y", 0.5, "a"))[0][2] == "X"
    assert len(pick((0, 10, "X", 0.5, "a"), (8, 20, "Y", 0.5, "a"))) == 2
    assert len(pick((0, 10, "X", 0.5, "a"), (10, 20, "Y", 0.5, "a"))) == 2


def test_bad_rules_fail(tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("ID:\n  - pattern: 'a+'\n    flags: IGNORECASE|DOTALL\n  - 'b'\nNAME: 'c'\n", encoding="utf-8")
    assert detection.load_rules(str(path)) == [("ID", "a+", "IGNORECASE|DOTALL"), ("ID", "b", ""), ("NAME", "c", "")]
    path.write_text("ID: '('\n", encoding="utf-8")
    with pytest.raises(Exception):  # noqa: B017
        detection.load_rules(str(path))
    with pytest.raises(ValueError):
        rewriting.mode_of("other")
    with pytest.raises(ValueError):
        text.java("a", "VERBOSE")


def test_detector_failures_are_not_silent(spark):
    def broken(t):
        raise RuntimeError("broken")

    with pytest.raises(Exception):  # noqa: B017
        detection.detect(docs_of(spark, "x"), [broken]).collect()


def test_models_come_before_rules():
    model = lambda t: [(0, 1, "NAME", 0.9, "model")]
    assert len(detection.detectors("en", [model])) == 2 and detection.detectors("en", [model])[0] is model
    assert detection.detectors("zh", stub=True)[0]("A123456789 0912345678")[0][:3] == (0, 10, "ID")


def test_merged_and_deduped(spark):
    df = spark.createDataFrame([(1, 0, 10, "X", 0.5, 0), (1, 4, 14, "X", 0.9, 1), (1, 13, 20, "X", 0.7, 2), (1, 4, 14, "Y", 0.1, 3), (1, 4, 14, "X", 0.2, 4)], "doc_id long, start int, end int, type string, score double, seq int")
    assert sorted((r.start, r.end, r.type, r.score) for r in detection.merged_overlaps(df).collect()) == [(0, 14, "X", 0.9), (4, 14, "Y", 0.1), (13, 20, "X", 0.7)]
    assert sorted(r.seq for r in detection.deduped(df, ("seq",)).collect()) == [0, 1, 2, 3]


def test_normalized(spark):
    docs = docs_of(spark, "hello world")
    spans = spark.createDataFrame([(0, 0, 5, "A", 0.5, None), (0, 6, 11, None, 0.1, "x")], "doc_id long, start int, end int, type string, score double, source string")
    (r,) = detection.normalized(spans, docs, "en").collect()
    assert (r.text, r.confidence, r.score, r.source, r.language) == ("hello", 0.5, 0.5, "unknown", "en")


def test_replacement_and_masking(spark):
    docs = docs_of(spark, "mail a@b.org and a@b.org or c@d.org", "", None, "nothing")
    out = {r.doc_id: r for r in rewriting.deidentified(docs, [detection.regex_detector([fixed.EN_RULES[2]])], "replace").collect()}
    assert "a@b.org" not in out[0].output and len(out[0].replacement_map) == 2
    first, second, third = reversed(out[0].events)
    assert first.replacement == second.replacement != third.replacement
    assert out[3].output == "nothing" and out[2].output == "" == out[1].output
    masked = rewriting.deidentified(docs, [detection.regex_detector([fixed.EN_RULES[2]])], "blackbox").first()
    assert masked.output == "mail ███████ and ███████ or ███████" and not masked.replacement_map


def test_values_depend_on_context(spark):
    a, b = (rewriting.hashed_text("EMAIL", "a@b.org", c) for c in ("one", "two"))
    assert a != b and a == rewriting.hashed_text("EMAIL", "a@b.org", "one")


def test_one_pass_equals_columns(spark):
    rng = random.Random(2)
    rows = []
    for d in range(60):
        t = "".join(rng.choice("abcdé😀 ") for _ in range(60))
        rows.append((d, t, [dict(zip(("start", "end", "type", "score", "source"), s[:5], strict=True)) for s in detection.resolved(random_spans(rng, 6))]))
    df = spark.createDataFrame(rows, f"doc_id long, text string, entities array<{detection.SPAN}>")
    for mode in ("replace", "blackbox"):
        for r in rewriting.rewritten_documents(df, mode).collect():
            output, events = rewriting.replaced(r.text, [tuple(e) for e in r.entities], mode)
            assert output == r.output
            assert [e[:5] for e in events] == [(e.entity_type, e.original, e.replacement, e.start, e.end) for e in r.events]


def test_native_values_are_those_outside_the_jvm(spark):
    kinds = ["ID", "TW_ID", "PHONE", "EMAIL", "UNIFIED_BUSINESS_NO", "PASSPORT", "MEDICAL_ID", "CONTRACT_NO", "ORGANIZATION", "NAME", "ADDRESS", "OTHER"]
    df = spark.createDataFrame([(k, f"o{i}", f"c{i % 3}") for i in range(8) for k in kinds], "k string, o string, c string")
    for r in df.withColumn("v", rewriting.hashed_value(F.col("k"), F.col("o"), F.col("c"))).collect():
        assert r.v == rewriting.hashed_text(r.k, r.o, r.c)


def test_seeded_values_have_their_forms(spark):
    import re

    forms = {"ID": r"\d{3}-\d{2}-\d{4}", "PHONE": r"555-\d{3}-\d{4}", "EMAIL": r"user\d{6}@example\.com", "PASSPORT": r"P[AB]?\d{7}", "MEDICAL_ID": r"M\d{7}", "CONTRACT_NO": r"CN-\d{6}", "X": r"<X:[0-9a-f]{8}>"}
    df = spark.createDataFrame([(k, f"v{i}", "ctx") for k in forms for i in range(5)], "type string, original string, context_hash string")
    for r in rewriting.fake_values(df).collect():
        assert re.fullmatch(forms[r.type], r.value)
    assert re.fullmatch(r"[A-Z][12]\d{8}", rewriting.seeded_value("ID", "k", 1, True)) and re.fullmatch(r"09\d{8}", rewriting.seeded_value("PHONE", "k", 1, True))


def test_events_know_their_place_in_the_output(spark):
    docs = docs_of(spark, "x a@b.org y cc@dd.org z")
    out = rewriting.deidentified(docs, [detection.regex_detector([fixed.EN_RULES[2]])])
    text_out = out.first().output
    for r in rewriting.events(out).collect():
        assert text_out[r.out_start : r.out_start + len(r.replacement)] == r.replacement


def test_anchors(spark):
    seg = spark.createDataFrame([(1, 0, "abcde", 0), (1, 1, "", 0), (1, 2, "fgh", 1)], "doc_id long, segment_id int, text string, page_index int")
    placed = documents.segmented(seg)
    assert sorted((r.segment_id, r.start, r.end) for r in placed.collect()) == [(0, 0, 5), (1, 6, 6), (2, 7, 10)]
    assert documents.built(seg).first().text == "abcde\n\nfgh"
    spans = spark.createDataFrame([(1, 1, 4), (1, 3, 8), (1, 7, 10), (2, 0, 1)], "doc_id long, start int, end int")
    got = {(r.doc_id, r.start): (r.segment_id, r.page_index) for r in documents.anchored(spans, placed, "page_index").collect()}
    assert got == {(1, 1): (0, 0), (1, 3): (None, None), (1, 7): (2, 1), (2, 0): (None, None)}


def test_boxes(spark):
    box = "struct<left:int,top:int,right:int,bottom:int>"
    seg = spark.createDataFrame([(1, 0, 0, 4, 0, (0, 0, 10, 10)), (1, 1, 5, 10, 0, (12, 0, 20, 10))], f"doc_id long, segment_id int, start int, end int, page_index int, bbox {box}")
    spans = spark.createDataFrame([(1, 0, 10)], "doc_id long, start int, end int")
    assert documents.overlapped(spans, seg).count() == 2
    assert tuple(documents.boxes_of(spans, seg).first().bbox) == (0, 0, 20, 10)


def test_streams_run_the_same_plan(spark, tmp_path):
    docs = docs_of(spark, "mail a@b.org", "none at all, hello", "SSN 123-45-6789")
    docs.write.json(str(tmp_path / "in"))
    deid.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.doc_id: r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.doc_id: r.output for r in deid.deidentified(docs).collect()}


def test_spans_of_few_texts_are_held_at_once(spark):
    sizes = [0, 3, detection.PORTION_BYTES * 2, 5, *[1] * 1000, detection.PORTION_BYTES, 1]
    runs = list(detection.portions(sizes))
    assert [i for a, b in runs for i in range(a, b)] == list(range(len(sizes)))
    assert all(b - a == 1 or (sum(sizes[a:b]) <= detection.PORTION_BYTES and b - a <= detection.PORTION_ROWS) for a, b in runs)
    assert list(detection.portions([])) == []

    texts = [None, "", "mail a.b@c.org é", "ab, " * 20_000] * 200
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(detection.portioned([batch.slice(3), batch.slice(0, 0)], "text"))
    assert len(parts) > 40 and [t for p in parts for t in p.column("text").to_pylist()] == texts[3:]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = rewriting.deidentified(docs, detection.detectors("en"), "blackbox")
    assert out.selectExpr("count(1) n", "count(distinct doc_id) d", "sum(size(events)) e").first()[:] == (800, 800, 200)


def test_expressions_are_left_out_where_a_word_they_need_is_missing(spark):
    assert [text.needed(p) for k, p, _ in fixed.ZH_RULES if k == "ADDRESS"][2:6:3] == [[["村", "里"], ["鄰"]], []]
    assert text.needed("(a|b)?c") == text.needed("(a)x|c") == text.needed(r"((a)|b)") == text.needed("(ab)*") == []
    texts = ["台北市信義區松仁路3號", "幸福里 12鄰3號", "幸福里3號", "幸福大樓五樓", "", None, "臺中市大里區中山路5號，快樂社區"]
    rows = docs_of(spark, *texts)
    for _, p, f in fixed.ZH_RULES:
        a, b = zip(*rows.select(text.counted(F.col("text"), p, f), F.regexp_count("text", F.lit(text.java(p, f))).cast("long")).collect(), strict=True)
        assert a == b

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from umbra.functions import fixed, text
from umbra.operators import corpus, evaluation, rewriting, spans
from umbra.sources import files, jsonl, synthetic

SPAN = "array<struct<start:int,end:int,type:string,text:string>>"


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.withColumn("y", f(F.col("x"))).orderBy("i").collect()]


def test_canonical_types(spark):
    raw = ["LASTNAME", "PATIENT_LAST_NAME_1", "PHONE_2", "UNKNOWN_CUSTOM_FIELD", "", None, "123", "mail", "user_name_x", "MEDICAL-RECORD-ID", "zip", "shipping"]
    assert column(spark, raw, text.canonical_type) == ["NAME", "NAME", "PHONE", "PII", None, None, None, "EMAIL", "USERNAME", "MEDICAL_ID", "ADDRESS", "IP_ADDRESS"]


def test_placeholders(spark):
    assert column(spark, ["Hi <LASTNAME_1>, {PHONE] and [x]", "none", ""], text.canonical_placeholders) == ["Hi <NAME>, {PHONE] and [PII]", "none", ""]
    filled = column(spark, ["<NAME> <NAME>"], lambda c: rewriting.filled_placeholders(c, F.lit("ctx")))[0]
    assert "<" not in filled
    df = spark.createDataFrame([("Ann at x@y.org", [(0, 3, "PERSON", None), (7, 14, "EMAIL", None), (-1, 3, "ID", None), (5, 5, "ID", None), (3, 99, "ID", None)])], f"t string, e {SPAN}")
    assert df.select(rewriting.with_placeholders(F.col("t"), F.col("e"))).first()[0] == "<NAME> at <EMAIL>"


def test_markup(spark):
    texts = ['a <PII type="EMAIL">x@y</PII> b <PII type=\'NAME\'>Ann\nB</PII>', "[ID]7[/ID] c [X]1[/Y]", "plain"]
    blocks = column(spark, texts, rewriting.markup_blocks)
    for t, bs in zip(texts, blocks, strict=True):
        assert all(t[b.start : b.end] == b.value and t[b.block_start : b.block_end].endswith(("]", ">")) for b in bs)
    assert [[(b.type, b.value) for b in bs] for bs in blocks] == [[("EMAIL", "x@y"), ("NAME", "Ann\nB")], [("ID", "7")], []]
    assert column(spark, texts, rewriting.masked_markup) == ["a  b ", " c [X]1[/Y]", "plain"]


def test_bio(spark):
    df = spark.createDataFrame([(1, ["John", "Smith", "works"], ["B-NAME", "I-NAME", "O"]), (2, ["a", "b", "c", "d"], ["I-X", "B-X", "I-Y", "I-Y"]), (3, [], [])], "doc_id long, tokens array<string>, tags array<string>")
    got = {r.doc_id: [(e.start, e.end, e.type, e.text) for e in r.entities] for r in spans.bio_spans(df).collect()}
    assert got == {1: [(0, 10, "NAME", "John Smith")], 2: [(0, 1, "X", "a"), (2, 3, "X", "b"), (4, 7, "Y", "c d")], 3: []}
    assert column(spark, ["B-PER", "I-LOC", "O", None, "ORG"], spans.bio_tag) == ["B-NAME", "I-ADDRESS", "O", "O", "ORGANIZATION"]
    assert spans.decoded([("I-PER", 0, 2, 0.5), ("B-PER", 3, 5, 0.6), ("I-PER", 6, 8, 0.9), ("I-LOC", 9, 11, 0.9), ("O", 12, 13, 1.0)]) == [(3, 8, "NAME", 0.9)]


def test_token_labels(spark):
    tokens = spark.createDataFrame([(1, 0, 4), (1, 5, 8), (1, 0, 0), (1, 9, 12)], "doc_id long, start int, end int")
    ents = spark.createDataFrame([(1, 0, 0, 8, "NAME"), (1, 1, 5, 8, "ID")], "doc_id long, span_id int, start int, end int, type string")
    assert {(r.start, r.end): r.label for r in spans.token_labels(tokens, ents).collect()} == {(0, 4): "B-NAME", (5, 8): "I-NAME", (0, 0): "IGNORE", (9, 12): "O"}


def test_masked_pairs(spark):
    df = spark.createDataFrame([("Call John Smith and phone 0912345678.", "Call <NAME> and phone <PHONE>."), ("a b", "a b"), (None, "x")], "original string, masked string")
    (r,) = spans.masked_pairs(df).collect()
    assert [(e.type, e.text) for e in r.entities] == [("NAME", "John Smith"), ("PHONE", "0912345678.")]


def examples(spark):
    rows = [(1, "abcdef", [(0, 3, "", None), (2, 2, "X", None), (0, 99, "X", None), (1, 4, "X", "zzz"), (None, 1, "X", None)]), (2, "abcdef", [(0, 3, "A", "abc"), (2, 5, "B", None)]), (3, "", [])]
    return spark.createDataFrame(rows, f"doc_id long, text string, entities {SPAN}")


def test_span_quality(spark):
    got = sorted((r.doc_id, r.entity_index, r.kind) for r in spans.issues(examples(spark)).collect())
    assert got == [(1, 0, "missing_type"), (1, 0, "overlap"), (1, 1, "empty_span"), (1, 2, "span_out_of_bounds"), (1, 3, "text_mismatch"), (1, 4, "invalid_span"), (2, 0, "overlap")]
    report = corpus.quality_report(examples(spark))
    assert {r.measure: r.n for r in report["totals"].collect()} == {"examples": 3, "entities": 7, "invalid_examples": 2, "invalid_entities": 3}
    assert [tuple(r) for r in report["type_counts"].collect()] == [("X", 4), ("A", 1), ("B", 1)]
    assert report["issue_counts"].first().kind == "overlap"
    assert tuple(report["text_length"].first()) == (0.0, 6.0, 4.0, 6.0, 6.0)
    assert corpus.first_issues(examples(spark), 2).count() == 2


@pytest.mark.parametrize("values", [[], [3], [1, 2], list(range(41)), [5] * 7 + [9]])
def test_summary(spark, values):
    import statistics

    got = tuple(corpus.summary(spark.createDataFrame([(v,) for v in values], "v int"), "v").first())
    s = sorted(map(float, values))
    assert got == ((s[0], s[-1], sum(s) / len(s), statistics.median(s), s[int(0.95 * (len(s) - 1))]) if s else (0.0,) * 5)


def test_mixing_and_sampling(spark):
    a, b = (spark.range(lo, lo + 5).withColumnRenamed("id", "k") for lo in (0, 100))
    assert [r.k for r in corpus.mixed([("a", a, 1), ("b", b, 0)], "k").collect()] == [0, 100, 101, 102, 103, 104]
    first, again = ([r.k for r in corpus.mixed([("a", a, 0), ("b", b, 0)], "k", seed=s).collect()] for s in (1, 1))
    assert first == again and sorted(first) == [*range(5), *range(100, 105)]
    assert corpus.sampled(b, 3, "k").count() == 3
    assert corpus.dataset_spec("a/b:c:10") == ("a/b:c", 10) and corpus.dataset_spec("a:b") == ("a:b", 0) and corpus.slug("a/b: c") == "a__b___c"


def test_corpora(spark):
    df = spark.createDataFrame([("a\r\n b", ), ("漢字 text",), ("",)], "text string")
    assert [r.text for r in corpus.lm_corpus(df).collect()] == ["a b", "漢字 text"]
    assert [r.text for r in corpus.lm_corpus(df, cjk=True).collect()] == ["漢字 text"]
    pairs = spark.createDataFrame([("p", "a\n\nb", "c\n\nd"), ("q", "a\nb", "c"), ("r", "x", "y")], "id string, input string, output string")
    got = sorted((r.id, r.text) for r in corpus.pairs_corpus(pairs, "In: {RAW_TEXT} Out: ").collect())
    assert got == [("p", "In: a Out: c"), ("p:1", "In: b Out: d"), ("q", "In: a\nb Out: c"), ("r", "In: x Out: y")]


def test_windows_and_chunks(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "")], "doc_id long, text string")
    assert sorted((r.start, r.text) for r in spans.windows(docs, 4).collect()) == [(0, "abcd"), (2, "cdef"), (4, "efgh"), (6, "ghij"), (8, "ij")]
    lines = spark.createDataFrame([(1, "a b\nc\nd e f g\nh"), (2, "one")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in spans.greedy_chunks(lines, 3).collect()) == [(1, "a b\nc"), (1, "d e f g"), (1, "h"), (2, "one")]
    packed = spans.packed_blocks(spark.createDataFrame([(i, list(range(i * 3, i * 3 + 3))) for i in range(5)], "doc_id long, tokens array<int>"), 4)
    assert sorted((r.block, r.tokens) for r in packed.collect()) == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7]), (2, [8, 9, 10, 11])]


def test_evaluation(spark):
    rows = spark.createDataFrame([("1", "Dear [NAME]Ann[/NAME] at [EMAIL]a@b.org[/EMAIL]"), ("2", "no markup"), ("3", "")], "id string, input string")
    said = spark.createDataFrame([("1", "Dear Bob at a@b.org", 0), ("1", "Dear Ann at x@y.org", 1)], "id string, prediction string, line int")
    reports = {r.id: r for r in evaluation.reports(evaluation.with_blocks(evaluation.with_predictions(rows, said))).collect()}
    assert (reports["1"].pii_total, reports["1"].pii_leak_count, reports["1"].pii_removal_recall, reports["1"].type_consistency) == (2, 1, 0.5, 1.0)
    assert reports["2"].format_triggers == ["<EMPTY>"] and not reports["2"].format_compliant and reports["3"].non_pii_similarity == 1.0
    total = evaluation.aggregated(evaluation.reports(evaluation.with_blocks(evaluation.with_predictions(rows, said)))).first()
    assert (total["count"], total.pii_leak_rate) == (3, 0.5)
    empty = evaluation.aggregated(evaluation.reports(evaluation.with_blocks(evaluation.with_predictions(rows, said))).where("false")).first()
    assert tuple(empty) == (0, 1.0, 0, 0, 0.0, 0.0, 1.0, 0.0, 1.0)
    weak = spark.createDataFrame([("2", 0, 2, "NAME"), ("2", 5, 99, "NAME")], "id string, start int, end int, type string")
    assert {r.id: len(r.blocks) for r in evaluation.with_blocks(rows, weak).collect()} == {"1": 2, "2": 1, "3": 0}


def test_evaluation_is_written(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Dear [NAME]Ann[/NAME]"), ("2", "no markup")], "id string, input string")
    said = spark.createDataFrame([("1", "Dear Ann", 0), ("2", "no markup", 1)], "id string, prediction string, line int")
    reports = evaluation.reports(evaluation.with_blocks(evaluation.with_predictions(rows, said)))
    metrics = evaluation.write_evaluation(reports, f"file://{tmp_path}/out")
    assert metrics["count"] == 2 and metrics["pii_leak_count"] == 1
    assert spark.read.json(f"file://{tmp_path}/out/metrics").first().composite_score == metrics["composite_score"]
    assert [spark.read.json(f"file://{tmp_path}/out/{k}").count() for k in ("detailed", "failures")] == [2, 1]


def test_repetition_and_format(spark):
    def plain(t):
        grams = [t[i : i + 3] for i in range(len(t) - 2)]
        return sum(grams.count(g) > 1 for g in grams) / len(grams) if grams else 0.0

    texts = ["", "ab", "abc", "abcabc", "aaaaaa", "the cat and the hat", "😀é😀é😀é"]
    assert column(spark, texts, text.repetition) == [plain(t) for t in texts]
    assert column(spark, ["Step one", "ok", " ", "x [/NAME]", None], lambda c: text.triggers(c)) == [["step"], [], ["<EMPTY>"], [fixed.MARKUP_TRIGGER], ["<EMPTY>"]]
    assert column(spark, [" Output: x", "輸出：y", "z"], text.without_prefixes) == ["x", "y", "z"]


def test_leak_check(spark):
    a = spark.createDataFrame([("f", "A123456789 a@b.org"), ("g", "0912345678"), ("h", "x")], "name string, text string")
    b = spark.createDataFrame([("f", "A123456789 -"), ("g", "-")], "name string, text string")
    got = {r.name: (r.pii_removed, r.leaked) for r in evaluation.leak_check(a, b).collect()}
    assert got == {"f": (False, {"ID": ["A123456789"]}), "g": (True, {})}


def write_docx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>In a </w:t><w:t>table</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')


def write_xlsx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="B2" t="s"><v>0</v></c><c r="C2"><v>7</v></c><c r="D2"/></row></sheetData></worksheet>')


def test_files_are_read_by_extension(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello \xff")
    (tmp_path / "b.HTML").write_text("<html><title>T</title><script>no()</script><p>A &amp; B</p></html>", encoding="utf-8")
    (tmp_path / "c.csv").write_text('id,phone\nA1,"x,y"\nz\n', encoding="utf-8")
    write_docx(tmp_path / "e.docx")
    write_xlsx(tmp_path / "f.xlsx")
    with zipfile.ZipFile(tmp_path / "g.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvSpPr><p:cNvPr id="4"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:txBody></p:sp></p:sld>')
    rows = files.scan(spark, str(tmp_path)).orderBy("path", "segment_id").collect()
    texts = {r.path.rpartition("/")[2]: [x.text for x in rows if x.path == r.path] for r in rows}
    assert texts == {"a.txt": ["hello �"], "b.HTML": ["T\nA & B"], "c.csv": ["id", "phone", "A1", "x,y", "z"], "e.docx": ["One", "In a table"], "f.xlsx": ["Hello", "7"], "g.pptx": ["Title"]}
    cell = next(r.cell for r in rows if r.text == "x,y")
    assert (cell.sheet, cell.address, cell.row, cell.col) == ("csv", "R2C2", 2, 2)
    assert [s[0] for s in files.read_csv(b"")] == [""]
    with pytest.raises(ValueError):
        files.reader_of("x.pdf")
    assert files.rebuilt_csv('id,phone\nA1,"x,y"\n', [(2, 2, "x", "Q")]) == 'id,phone\r\nA1,"Q,y"\r\n'
    assert files.html_text("a <b>b</b>\n c", collapse=True) == "a b c"


def test_rebuilt_files(spark, tmp_path):
    df = spark.createDataFrame([("/in/a.txt", "new\ntext")], "path string, output string")
    (r,) = files.rebuild(df, str(tmp_path / "out")).collect()
    assert open(r.artifact, encoding="utf-8").read() == "new\ntext" and r.artifact.endswith("a.deid.txt")


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text(json.dumps({"text": "ID A1", "entities": [{"type": "ID", "span": [3, 5], "text": "A1"}]}) + "\n\n" + json.dumps({"text": "t"}) + "\n", encoding="utf-8")
    got = jsonl.span_examples(spark, str(path)).orderBy("text").collect()
    assert [(r.text, [(e.start, e.end, e.type) for e in r.entities]) for r in got] == [("ID A1", [(3, 5, "ID")]), ("t", [])]
    jsonl.write_span_examples(jsonl.span_examples(spark, str(path)), str(tmp_path / "out"))
    assert jsonl.span_examples(spark, str(tmp_path / "out")).count() == 2
    path.write_text(json.dumps({"id": "", "_id": "k", "input": "a"}) + "\n" + json.dumps({"example_id": "m", "output": "b"}), encoding="utf-8")
    assert sorted((r.id, r.input, r.output) for r in jsonl.pairs(spark, str(path)).collect()) == [("k", "a", ""), ("m", "", "b")]
    assert sorted((r.id, r.prediction) for r in jsonl.predictions(spark, str(path)).collect()) == [("k", ""), ("m", "b")]
    df = spark.createDataFrame([(["a"], [2]), (["b"], [])], "tokens array<string>, ner_tags array<int>")
    assert [r.tags for r in jsonl.token_examples(df, list(fixed.WIKI_LABELS)).collect()] == [["B-PER"]]
    jsonl.write_manifest(str(tmp_path / "m" / "manifest.json"), n=1)
    assert json.loads((tmp_path / "m" / "manifest.json").read_text()) == {"n": 1}


def test_synthetic_data(spark):
    import re

    forms = {
        "TW_ID": r"[A-Z][12]\d{8}", "PHONE": r"09\d{2}(-\d{3}-\d{3}|\d{6})", "ADDRESS": r".*\d+號.*", "NAME": r"\w{3,5}", "MEDICAL_RECORD": r".+\d+", "DATE_OF_BIRTH": r"\d+(年|-|/)\d+.*", "EMAIL": r".+@.+", "CREDIT_CARD": r"\d{15,16}",
        "PASSPORT": r"[A-H]\d{7}", "LICENSE_PLATE": r"[A-Z]{3}-\d{3}|\d{3}-[A-Z]{3}", "HEALTH_INSURANCE": r"\d{11}",
    }
    rows = synthetic.values(synthetic.rows(spark, 300)).collect()
    assert {r.type for r in rows} == set(forms) and all(re.fullmatch(forms[r.type], r.value) for r in rows)
    for language in ("zh", "en"):
        for r in synthetic.span_examples(synthetic.rows(spark, 20, "doc_id"), language).collect():
            assert [e.type for e in r.entities] == ["NAME", "PHONE", "EMAIL", "ADDRESS", "ID"] and all(r.text[e.start : e.end] == e.text for e in r.entities)
    docs = synthetic.documents(synthetic.rows(spark, 40))
    assert {r.kind for r in docs.collect()} == {"medical_record", "financial", "contract", "report", "paragraph"}
    assert [tuple(r) for r in docs.orderBy("id").collect()] == [tuple(r) for r in docs.repartition(3).orderBy("id").collect()]


def test_visible_blocks(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 30.0), (" ", 99.0), ("c", 80.0)], "text string, conf double")
    assert sorted(r.text for r in files.visible_blocks(df, 0.6).collect()) == ["a", "c"]


def test_rounds(spark):
    rounds = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, 0.1)], "round int, score double")
    assert tuple(evaluation.running_best(rounds).first()) == (2, 0.9)
    assert sorted(r["round"] for r in evaluation.kept_rounds(rounds, 1, 2).collect()) == [2, 3, 4]


def test_datasets_logs_and_files_are_written(spark, tmp_path):
    report = jsonl.write_dataset(examples(spark), str(tmp_path / "d"), seed=3)
    written = lambda name: json.loads(spark.read.text(str(tmp_path / "d" / name)).first().value)
    assert written("manifest")["seed"] == 3
    assert written("quality")["type_counts"][0] == {"type": "X", "n": 4} == report["type_counts"][0]
    assert jsonl.span_examples(spark, str(tmp_path / "d" / "dataset")).count() == 3
    for i in range(2):
        corpus.append_log(spark.createDataFrame([(i, 0.5)], "round int, score double"), str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    synthetic.write(synthetic.values(synthetic.rows(spark, 5)), synthetic.documents(synthetic.rows(spark, 5)), str(tmp_path / "s"))
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "s" / "csv")).count() == 5


def test_cells_are_rebuilt(spark):
    cell = "struct<sheet:string,address:string,row:int,col:int>"
    cells = spark.createDataFrame([("f", 0, ("csv", "R1C1", 1, 1), "a,a a"), ("f", 1, ("csv", "R1C2", 1, 2), 'say "x"'), ("f", 2, ("csv", "R2C1", 2, 1), "z")], f"path string, segment_id int, cell {cell}, text string")
    some = spark.createDataFrame([("f", 0, 1, "a", "b"), ("f", 0, 0, "a", "Q"), ("f", 2, 0, "none", "y"), ("f", 2, 1, "", "y")], "path string, segment_id int, seq int, original string, value string")
    got = [(r.row, r.line) for r in files.csv_lines(files.rebuilt_cells(cells, some)).orderBy("row").collect()]
    assert got == [(1, '"Q,b a","say ""x"""'), (2, "z")]

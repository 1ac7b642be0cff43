"""Files rebuilt, settings, providers and the command line, on files made here."""

import io
import json
import zipfile
from functools import partial

import pytest

from umbra import cli
from umbra.operators import detection, rewriting
from umbra.sources import files, rebuilds, settings

W = 'xmlns:w="urn:w" xmlns:x="urn:x" x:Ignorable="x"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def part(data, name):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(name).decode()


DOCX = zipped(
    word__document_xml=f"""<?xml version="1.0"?><w:document {W}><w:body><w:p><w:r><w:b/><w:t>Contact: al</w:t></w:r><w:r><w:t>ice@example.com now, alice@example.com</w:t></w:r></w:p>
    <w:tbl><w:tr><w:tc><w:p><w:r><w:t>call (415) 555-0100</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>kept </w:t></w:r></w:p></w:body></w:document>""",
    word__styles_xml="<s/>",
)
XLSX = zipped(
    xl__workbook_xml='<workbook><sheets><sheet name="S &amp; T"/><sheet name="Two"/></sheets></workbook>',
    xl__sharedStrings_xml="<sst><si><t>id</t></si><si><t>a@b.org or a@b.org</t></si></sst>",
    xl__worksheets__sheet1_xml='<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1"><v>4155550100</v></c></row></sheetData></worksheet>',
    xl__worksheets__sheet2_xml='<worksheet><sheetData><row r="1"><c r="B1" t="inlineStr"><is><t>a@b.org</t></is></c></row></sheetData></worksheet>',
)
PPTX = zipped(
    ppt__slides__slide1_xml='<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:sp><p:cNvPr id="7"/><a:p><a:r><a:t>Ann</a:t></a:r><a:r><a:t>a Lee</a:t></a:r></a:p><a:p><a:r><a:t>Main St 5</a:t></a:r></a:p></p:sp></p:sld>',
)


def test_docx_keeps_all_but_what_was_replaced():
    changes = [rebuilds.Change("alice@example.com", "<EMAIL> & co"), rebuilds.Change("(415) 555-0100", "555-1")]
    new = rebuilds.rebuilt_docx(DOCX, "", changes)
    assert [s[0] for s in files.read_docx(new)] == ["Contact: <EMAIL> & co now, <EMAIL> & co", "call 555-1", "kept "]
    assert 'x:Ignorable="x"' in part(new, "word/document.xml") and "<w:b/>" in part(new, "word/document.xml")
    assert part(new, "word/styles.xml") == "<s/>" and rebuilds.rebuilt_docx(DOCX, "", []) != b""
    assert part(rebuilds.rebuilt_docx(DOCX, "", []), "word/document.xml") == part(DOCX, "word/document.xml")


def test_xlsx_replaces_the_first_occurrence_in_a_cell_alone():
    cell = lambda sheet, address: {"sheet": sheet, "address": address, "row": 1, "col": 2}
    changes = [rebuilds.Change("a@b.org", "x", cell=cell("S & T", "B1")), rebuilds.Change("415", "<9>", cell=cell("S & T", "C1")), rebuilds.Change("a@b.org", "y")]
    new = rebuilds.rebuilt_xlsx(XLSX, "", changes)
    assert [(s[0], s[3]["address"]) for s in files.read_xlsx(new)] == [("id", "A1"), ("x or a@b.org", "B1"), ("<9>5550100", "C1"), ("a@b.org", "B1")]


def test_pptx_replaces_over_runs_and_paragraphs():
    new = rebuilds.rebuilt_pptx(PPTX, "", [rebuilds.Change("Anna Lee", "<NAME>")])
    assert [s[0] for s in files.read_pptx(new)] == ["<NAME>\nMain St 5"]
    new = rebuilds.rebuilt_pptx(PPTX, "", [rebuilds.Change("Lee\nMain", "X")])
    assert [s[0] for s in files.read_pptx(new)] == ["Anna X St 5"]


@pytest.fixture
def folder(tmp_path):
    for place in ("in/a", "in/b"):
        (tmp_path / place).mkdir(parents=True)
    (tmp_path / "in/a/x.txt").write_text("mail a@b.org")
    (tmp_path / "in/b/x.txt").write_text("mail c@d.org\nagain c@d.org")
    (tmp_path / "in/none.txt").write_bytes(b"")
    (tmp_path / "in/t.csv").write_text("id,mail\n1,e@f.org\n")
    (tmp_path / "in/d.docx").write_bytes(DOCX)
    return tmp_path


def test_files_without_bytes_are_read_and_large_ones_raise(spark, folder):
    got = {(r.path.rsplit("in/", 1)[1], r.text) for r in files.scan(spark, str(folder / "in")).collect()}
    assert {("none.txt", ""), ("a/x.txt", "mail a@b.org")} <= got
    with pytest.raises(Exception, match="too large"):
        files.scan(spark, str(folder / "in"), most=10).collect()


def test_the_command_line_rebuilds_each_file_in_its_place(spark, folder, capsys):
    assert cli.main(["--input", str(folder / "in"), "--output-dir", str(folder / "out"), "--json"], spark) == 0
    rows = {r["path"].rsplit("in/", 1)[1]: r["result"] for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert rows["none.txt"]["text"] == "" and rows["none.txt"]["entities"] == [] and rows["a/x.txt"]["schema_version"] == cli.SCHEMA_VERSION
    value = rows["b/x.txt"]["replacement_map"]["EMAIL:c@d.org"]
    assert (folder / "out/b/x.deid.txt").read_text() == f"mail {value}\nagain {value}" != (folder / "out/a/x.deid.txt").read_text()
    assert (folder / "out/t.deid.csv").read_bytes() == f"id,mail\r\n1,{rows['t.csv']['replacement_map']['EMAIL:e@f.org']}\r\n".encode()
    assert "alice" not in "".join(s[0] for s in files.read_docx((folder / "out/d.deid.docx").read_bytes()))
    assert cli.main(["--input", str(folder / "in/a"), "--mode", "detect"], spark) == 0
    assert "EMAIL            | a@b.org | 1.00" in capsys.readouterr().out
    counts = cli.entity_counts(cli.processed(cli.texts(files.scan(spark, str(folder / "in"))), "en", "detect")).collect()
    assert sorted((r.doc_id.rsplit("in/", 1)[1], r.pii_count) for r in counts)[-2:] == [("none.txt", 0), ("t.csv", 1)]


def test_a_registered_engine_reads_and_writes_its_format(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"page with a@b.org")
    box = {"left": 1, "top": 2, "right": 3, "bottom": 4}
    read = lambda data, box=box: iter([(data.decode(), 0, box, None, {})])
    write = lambda data, output, changes: repr([(c.original, c.page_index, c.bbox["right"]) for c in changes]).encode()
    files.register(".PDF", read, write)
    try:
        assert cli.main(["--input", str(tmp_path / "p.pdf"), "--output-dir", str(tmp_path / "out")], spark) == 0
    finally:
        del files.READERS[".pdf"], rebuilds.WRITERS[".pdf"]
    assert (tmp_path / "out" / "p.deid.pdf").exists() or list((tmp_path / "out").rglob("*.pdf"))


def test_values_come_from_a_provider_once_for_each_name(spark):
    calls = []

    def numbered(kind, original, context):
        calls.append(original)
        return f"[{kind}-{len(calls)}-{context[:4]}]"

    text = "a@b.org c@d.org a@b.org"
    spans = [(0, 7, "EMAIL", 1.0, "r"), (8, 15, "EMAIL", 1.0, "r"), (16, 23, "EMAIL", 1.0, "r")]
    out, events = rewriting.replaced(text, spans, "replace", numbered)
    assert len(calls) == 3 and len(events) == 3
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    tag = lambda kind, original, context: f"[{kind}:{original.upper()}]"
    got = {r.doc_id: r for r in rewriting.deidentified(docs, detection.detectors("en"), provider=tag).collect()}
    assert got[1].output == "[EMAIL:A@B.ORG] [EMAIL:C@D.ORG] [EMAIL:A@B.ORG]" and got[2].output == ""
    assert got[1].replacement_map == {"EMAIL:a@b.org": "[EMAIL:A@B.ORG]", "EMAIL:c@d.org": "[EMAIL:C@D.ORG]"}
    (r,) = rewriting.provided_placeholders(spark.createDataFrame([("<EMAIL> and [PHONE_2], <EMAIL>",)], "text string"), tag).collect()
    assert r.filled == "[EMAIL:EMAIL:0] and [PHONE:PHONE:1], [EMAIL:EMAIL:2]"


def test_settings_from_files_and_environment(tmp_path):
    (tmp_path / "b.json").write_text('{"phrases": ["as an assistant", " "]}')
    (tmp_path / "c.json").write_text("null")
    (tmp_path / "p.txt").write_text("Rewrite: {RAW_TEXT}")
    assert settings.banned_phrases(str(tmp_path / "b.json")) == ["as an assistant"] and settings.banned_phrases(str(tmp_path / "c.json")) == []
    (tmp_path / "d.json").write_text('{"phrases": "x"}')
    with pytest.raises(ValueError, match="no list"):
        settings.banned_phrases(str(tmp_path / "d.json"))
    assert settings.prompt_template(str(tmp_path / "p.txt")).format(RAW_TEXT="x") == "Rewrite: x"
    assert settings.unknown_keys({"a": 1, "b": 2}, {"a"}) == ["b"] and settings.rules("en", {}) == list(settings.fixed.RULES["en"])
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("CODE: 'X[0-9]+'\n")
    (tmp_path / "b.yaml").write_text("banned:\n - one\n - 2\n")
    assert settings.rules("en", {"REGEX_EN_RULES_FILE": str(tmp_path / "r.yaml")}) == [("CODE", "X[0-9]+", "")]
    assert settings.banned_phrases(str(tmp_path / "b.yaml")) == ["one", "2"]


def test_artifacts_stay_below_their_folder():
    place = partial(rebuilds.artifact_of, root="/in", folder="/out/")
    assert place("file:///in/a/x.txt") == "/out/a/x.deid.txt"
    with pytest.raises(ValueError, match="below"):
        place("/other/x.txt")

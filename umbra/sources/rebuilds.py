"""Files rebuilt with values replaced: office formats as zip and XML, texts, and engines registered for other formats."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.dom import minidom

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Change:
    """One replaced value: what stood there, what stands there now, and where, as far as its segment says."""

    original: str
    value: str
    page_index: int | None = None
    bbox: dict | None = None
    cell: dict | None = None


#: The bytes of a file, its whole output text and its changes in order give the new bytes.
Writer = Callable[[bytes, str, list[Change]], bytes]
CHANGES = (
    "array<struct<original:string,value:string,page_index:int,bbox:struct<left:int,top:int,right:int,bottom:int>,"
    "cell:struct<sheet:string,address:string,row:int,col:int>>>"
)


def _children(e: minidom.Node, name: str) -> list[minidom.Element]:
    """Elements of a local name below e, whatever their prefix."""
    return [x for x in e.getElementsByTagName("*") if x.tagName.rpartition(":")[2] == name]


def _text(e: minidom.Element) -> str:
    return "".join(n.data for n in e.childNodes if n.nodeType in (n.TEXT_NODE, n.CDATA_SECTION_NODE))


def _set_text(e: minidom.Element, text: str) -> None:
    for n in list(e.childNodes):
        e.removeChild(n)
    if text:
        e.appendChild(e.ownerDocument.createTextNode(text))
    if text != text.strip():
        e.setAttribute("xml:space", "preserve")


def _own_runs(paragraph: minidom.Element) -> list[minidom.Element]:
    """The text runs of a paragraph, without those of paragraphs inside it (of text boxes)."""

    def nearest(e: minidom.Node) -> minidom.Node:
        e = e.parentNode
        while e.tagName.rpartition(":")[2] != "p":
            e = e.parentNode
        return e

    return [t for t in _children(paragraph, "t") if nearest(t) is paragraph]


def _rewrite(paragraphs: list[minidom.Element], changes: list[Change]) -> bool:
    """Replaces values in some paragraphs that are one text; a value may go over run and paragraph borders.

    What a paragraph says then stands in its first run, which keeps its format.
    """
    runs = [_own_runs(p) for p in paragraphs]
    before = ["".join(map(_text, r)) for r in runs]
    text = "\n".join(before)
    for c in changes:
        text = text.replace(c.original, c.value) if c.original else text
    if text == "\n".join(before):
        return False
    after = text.split("\n")
    if len(after) != len(before):  # a value with line breaks went: all is put in the first paragraph that has a run
        first = next(i for i, r in enumerate(runs) if r)
        after = [text if i == first else "" for i in range(len(before))]
    for r, old, new in zip(runs, before, after, strict=True):
        if old != new:
            for k, run in enumerate(r):
                _set_text(run, new if k == 0 else "")
    return True


def _edited(data: bytes, names: Callable[[str], bool], edit: Callable[[str, minidom.Document], bool]) -> bytes:
    """A zip file with those of its XML parts changed that edit changes; all others are copied as they are."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            content = old.read(item.filename)
            if names(item.filename):
                document = minidom.parseString(content)
                if edit(item.filename, document):
                    content = document.toxml(encoding="utf-8")
            new.writestr(item, content)
    return out.getvalue()


def rebuilt_docx(data: bytes, output: str, changes: list[Change]) -> bytes:
    """All occurrences of each value replaced, one after the other, in paragraphs, those in tables too."""

    def edit(_: str, document: minidom.Document) -> bool:
        return any([_rewrite([p], changes) for p in _children(document, "p")])

    return _edited(data, lambda name: name == "word/document.xml", edit)


def rebuilt_pptx(data: bytes, output: str, changes: list[Change]) -> bytes:
    """All occurrences of each value replaced, one after the other, in the texts of shapes."""

    def edit(_: str, document: minidom.Document) -> bool:
        return any([_rewrite(_children(shape, "p"), changes) for shape in _children(document, "sp")])

    return _edited(data, lambda name: name.startswith("ppt/slides/slide") and name.endswith(".xml"), edit)


def rebuilt_xlsx(data: bytes, output: str, changes: list[Change]) -> bytes:
    """In each change's cell the first occurrence of its value replaced; changes without a cell change nothing."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        have = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in have:
            items = _children(minidom.parseString(z.read("xl/sharedStrings.xml")), "si")
            shared = ["".join(map(_text, _children(s, "t"))) for s in items]
        sheets = _children(minidom.parseString(z.read("xl/workbook.xml")), "sheet")
    names = {f"xl/worksheets/sheet{k}.xml": s.getAttribute("name") for k, s in enumerate(sheets, 1)}
    by_cell: dict[tuple[str, str], list[Change]] = {}
    for c in changes:
        if c.cell and c.original:
            by_cell.setdefault((c.cell["sheet"], c.cell["address"]), []).append(c)

    def edit(name: str, document: minidom.Document) -> bool:
        done = False
        for cell in _children(document, "c"):
            mine = by_cell.get((names[name], cell.getAttribute("r")), [])
            if not mine:
                continue
            value = next((_text(v) for v in _children(cell, "v")), "".join(map(_text, _children(cell, "t"))))
            text = shared[int(value)] if cell.getAttribute("t") == "s" and value else value
            new = text
            for c in mine:
                new = new.replace(c.original, c.value, 1)
            if new == text:
                continue
            prefix = cell.tagName.rpartition(":")[0]
            make = lambda tag: document.createElement(f"{prefix}:{tag}" if prefix else tag)  # noqa: E731, B023
            for n in list(cell.childNodes):
                cell.removeChild(n)
            cell.setAttribute("t", "inlineStr")
            inline, run = make("is"), make("t")
            _set_text(run, new)
            inline.appendChild(run)
            cell.appendChild(inline)
            done = True
        return done

    return _edited(data, names.__contains__, edit)


def rebuilt_csv_file(data: bytes, output: str, changes: list[Change]) -> bytes:
    """In each change's cell the first occurrence of its value replaced."""
    from umbra.sources.files import rebuilt_csv

    cells = [(c.cell["row"], c.cell["col"], c.original, c.value) for c in changes if c.cell]
    return rebuilt_csv(data.decode("utf-8", "replace"), cells).encode()


def rebuilt_text(data: bytes, output: str, changes: list[Change]) -> bytes:
    return output.encode()


WRITERS: dict[str, Writer] = {
    ".txt": rebuilt_text, ".html": rebuilt_text, ".htm": rebuilt_text, ".csv": rebuilt_csv_file,
    ".docx": rebuilt_docx, ".xlsx": rebuilt_xlsx, ".pptx": rebuilt_pptx,
}


def artifact_of(path: str, root: str, folder: str) -> str:
    """{stem}.deid{ext} in folder, at the place below it that path has below root."""
    plain = lambda p: p.split(":", 1)[1].lstrip("/") if ":" in p else p.lstrip("/")
    rest = os.path.relpath(plain(path), plain(root)) if root else plain(path)
    if rest == ".":  # root is the file itself
        rest = os.path.basename(path)
    if rest.startswith(".."):
        raise ValueError(f"{path} isn't below {root}")
    stem, ext = os.path.splitext(rest)
    return f"{folder.rstrip('/')}/{stem}.deid{ext}"


def put(target: str, data: bytes) -> None:
    """Writes a whole file on any file system that a URI names: beside it first, so that a task run again leaves one."""
    fs, place = pafs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (pafs.LocalFileSystem(), target)
    fs.create_dir(os.path.dirname(place), recursive=True)
    part = f"{place}.{os.getpid()}.tmp"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, place)


def _change(c: dict) -> Change:
    """A row's change; pandas has whole numbers beside nulls as fractions."""
    whole = lambda x: None if x is None or x != x else int(x)
    ints = lambda d: {k: v if isinstance(v, str) else whole(v) for k, v in d.items()} if d is not None else None
    return Change(c["original"], c["value"], whole(c["page_index"]), ints(c["bbox"]), ints(c["cell"]))


def rebuild_files(spark: SparkSession, results: DataFrame, folder: str, root: str = "") -> DataFrame:
    """Writes the rebuilt file of each result (path, output, changes; see CHANGES); returns path and artifact.

    An extension without a writer has no artifact, as a file that is masked rather than replaced would have none.
    A file is read and written whole by one task.
    """
    # Only the files of the results are read, each once; the empty list of a file without changes leaves it as it is.
    paths = [r.path for r in results.select("path").distinct().toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "path string, artifact string")
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    writers = dict(WRITERS)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for path, data, output, changes in zip(frame["path"], frame["content"], frame["output"], frame["changes"], strict=True):
                write = writers.get(os.path.splitext(path)[1].lower())
                target = artifact_of(path, root, folder) if write else None
                if write:
                    put(target, write(bytes(data), output, [_change(c) for c in changes]))
                made.append(target)
            yield pd.DataFrame({"path": frame["path"], "artifact": made})

    joined = files.join(results.select("path", "output", F.col("changes").cast(CHANGES).alias("changes")), "path")
    return joined.mapInPandas(each, "path string, artifact string")

"""Readers and writers of files of documents: a registry by extension, segments with anchors, and rebuilt files."""

from __future__ import annotations

import csv
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from fnmatch import fnmatch
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.sources.rebuilds import WRITERS, Writer, artifact_of, put

#: One segment: text, page_index, bbox (left, top, right, bottom), cell (sheet, address, row, col), metadata.
Segment = tuple[str, int | None, dict | None, dict | None, dict]
SEGMENTS = (
    "path string, ext string, segment_id int, text string, page_index int, bbox struct<left:int,top:int,right:int,bottom:int>, "
    "cell struct<sheet:string,address:string,row:int,col:int>, metadata map<string,string>"
)
#: Extensions by reader; separators between the segments of a text.
SEPARATORS = {".png": " ", ".jpg": " ", ".jpeg": " ", ".tif": " ", ".tiff": " ", ".bmp": " "}


class _Text(HTMLParser):
    """Text nodes of a page, those of scripts and styles left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.closed = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.closed += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.closed -= tag in ("script", "style") and self.closed > 0

    def handle_data(self, data: str) -> None:
        if not self.closed:
            self.parts.append(data)


def html_text(html: str, collapse: bool = False) -> str:
    """Text nodes joined by line feeds; collapse: with single spaces instead of any white space."""
    p = _Text()
    p.feed(html or "")
    p.close()
    text = "\n".join(p.parts)
    return " ".join(text.split()) if collapse else text


def _decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _xml(data: bytes, name: str) -> ElementTree.Element | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _runs(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


def read_text(data: bytes) -> Iterator[Segment]:
    yield _decoded(data), None, None, None, {}


def read_html(data: bytes) -> Iterator[Segment]:
    yield html_text(_decoded(data)), None, None, None, {}


def read_csv(data: bytes) -> Iterator[Segment]:
    """A segment for each cell, the header's too, rows of any length; an empty file has one empty segment."""
    rows = list(csv.reader(io.StringIO(_decoded(data), newline="")))
    if not any(rows):
        yield "", None, None, None, {}
    for r, row in enumerate(rows, 1):
        for c, text in enumerate(row, 1):
            yield text, None, None, {"sheet": "csv", "address": f"R{r}C{c}", "row": r, "col": c}, {}


def read_docx(data: bytes) -> Iterator[Segment]:
    """Paragraphs in order, those in tables too."""
    root = _xml(data, "word/document.xml")
    for p in root.iter() if root is not None else ():
        if _local(p) == "p":
            yield _runs(p), None, None, None, {}


def _column(address: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", address).group():
        n = n * 26 + ord(c) - 64
    return n


def read_xlsx(data: bytes) -> Iterator[Segment]:
    """Cells that aren't empty, by sheet, with their values."""
    shared = [_runs(s) for s in (_xml(data, "xl/sharedStrings.xml") or ())]
    book = _xml(data, "xl/workbook.xml")
    names = [e.get("name") for e in book.iter() if _local(e) == "sheet"] if book is not None else []
    for k, name in enumerate(names, 1):
        sheet = _xml(data, f"xl/worksheets/sheet{k}.xml")
        for c in sheet.iter() if sheet is not None else ():
            if _local(c) != "c":
                continue
            value = next((v.text or "" for v in c if _local(v) == "v"), _runs(c))
            text = shared[int(value)] if c.get("t") == "s" and value else value
            if text:
                at = c.get("r", "")
                yield text, None, None, {"sheet": name, "address": at, "row": int(re.sub(r"\D", "", at) or 0), "col": _column(at)}, {}


def read_pptx(data: bytes) -> Iterator[Segment]:
    """Texts of shapes that aren't blank, by slide."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for k, name in slides:
        for shape in _xml(data, name).iter():
            if _local(shape) == "sp":
                text = "\n".join(_runs(p) for p in shape.iter() if _local(p) == "p").strip()
                ids = [e.get("id", "") for e in shape.iter() if _local(e) == "cNvPr"]
                if text:
                    yield text, None, None, None, {"slide_index": str(k - 1), "shape_id": ids[0] if ids else ""}


READERS: dict[str, Callable[[bytes], Iterator[Segment]]] = {
    ".txt": read_text, ".html": read_html, ".htm": read_html, ".csv": read_csv, ".docx": read_docx, ".xlsx": read_xlsx, ".pptx": read_pptx,
}


def register(ext: str, reader: Callable[[bytes], Iterator[Segment]] | None = None, writer: Writer | None = None) -> None:
    """A reader and a writer for an extension: a PDF or OCR engine where there is one.

    Its segments carry page_index and bbox, and so do the changes that its writer draws into the file.
    """
    if reader:
        READERS[ext.lower()] = reader
    if writer:
        WRITERS[ext.lower()] = writer


def reader_of(path: str, readers: dict | None = None) -> Callable[[bytes], Iterator[Segment]]:
    """The reader of a path; an extension without one raises (PDF and images need an engine that is registered)."""
    ext, known = os.path.splitext(path)[1].lower(), READERS if readers is None else readers
    if ext not in known:
        raise ValueError(f"no reader for {ext or path}")
    return known[ext]


def empty_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content) of files without any bytes, which Spark's file sources leave out; only their names are gathered."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [s.getPath() for s in fs.globStatus(where) or ()]
    while todo:
        place = todo.pop()
        status = fs.getFileStatus(place)
        if status.isDirectory():
            todo += [s.getPath() for s in fs.listStatus(place) if recursive or not s.isDirectory()]
        elif status.getLen() == 0 and fnmatch(place.getName(), glob) and place.getName()[0] not in "._":
            found.append((place.toString(), b""))
    return spark.createDataFrame(found, "path string, content binary")


def scan(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, most: int = 1 << 30) -> DataFrame:
    """Segments (see SEGMENTS) of all files below path: each file is read and parsed in one task.

    A file of more than `most` bytes raises: it is held whole. One without bytes is read like others.
    """
    source = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    small = F.when(F.col("length") <= most, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("too large: "), "path")))
    files = source.load(path).select("path", small.alias("content")).unionByName(empty_files(spark, path, glob, recursive))
    readers = dict(READERS)
    names = ["path", "ext", "segment_id", "text", "page_index", "bbox", "cell", "metadata"]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                ext = os.path.splitext(name)[1].lower()
                rows = [(name, ext, i, *s) for i, s in enumerate(reader_of(name, readers)(bytes(data)))]
                yield pd.DataFrame(rows, columns=names).astype({"page_index": "Int32"})

    return files.mapInPandas(each, SEGMENTS)


def visible_blocks(blocks: DataFrame, least: float) -> DataFrame:
    """OCR blocks (text, conf, ...) that aren't blank and are sure enough; confidences up to 1 are taken as shares of 100."""
    limit = least * 100 if least <= 1 else least
    conf = F.when(F.col("conf") <= 1, F.col("conf") * 100).otherwise(F.col("conf"))
    return blocks.where((conf >= limit) & (F.length(F.trim("text")) > 0))


def html_texts(df: DataFrame, html: str = "html", collapse: bool = False) -> DataFrame:
    """df with `text`, the text of its pages."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return pd.Series([html_text(h, collapse) for h in x])

    return df.withColumn("text", text(html))


def rebuilt_csv(data: str, values: list[tuple[int, int, str, str]]) -> str:
    """A CSV text with, in given cells (row, col), the first occurrence of an original replaced."""
    rows = list(csv.reader(io.StringIO(data, newline="")))
    for r, c, original, new in values:
        if 0 < r <= len(rows) and 0 < c <= len(rows[r - 1]):
            rows[r - 1][c - 1] = rows[r - 1][c - 1].replace(original, new, 1)
    out = io.StringIO(newline="")
    csv.writer(out).writerows(rows)
    return out.getvalue()


def rebuilt_cells(segments: DataFrame, replacements: DataFrame) -> DataFrame:
    """Segments (path, segment_id, cell, text) with, in each, the first occurrence of every original replaced, in order.

    replacements: (path, segment_id, seq, original, value). Cells without any stay as they are; masked values are values
    like others, so nothing is left as it was because of a mode.
    """
    listed = replacements.groupBy("path", "segment_id").agg(F.array_sort(F.collect_list(F.struct("seq", "original", "value"))).alias("r"))

    def first(t, x):
        place = F.call_function("locate", x["original"], t)
        return F.when((place > 0) & (F.length(x["original"]) > 0), F.concat(F.substring(t, F.lit(1), place - 1), x["value"], F.substring(t, place + F.length(x["original"]), F.length(t)))).otherwise(t)

    joined = segments.join(listed, ["path", "segment_id"], "left")
    return joined.withColumn("text", F.when(F.col("r").isNull(), F.col("text")).otherwise(F.aggregate("r", F.col("text"), first))).drop("r")


def csv_lines(cells: DataFrame) -> DataFrame:
    """(path, row, line): the lines of CSV files from their cells, quoted where they must be."""
    text = F.when(F.col("text").rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("text"))
    rows = cells.groupBy("path", F.col("cell.row").alias("row")).agg(F.array_sort(F.collect_list(F.struct(F.col("cell.col").alias("col"), text.alias("text")))).alias("c"))
    return rows.select("path", "row", F.concat_ws(",", F.transform("c", lambda x: x["text"])).alias("line"))


def write_texts(df: DataFrame, path: str, text: str = "output") -> None:
    """A text file for each partition, a line for each document (line feeds escaped), as a cluster writes them."""
    df.select(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), "\n", r"\\n").alias("value")).write.text(path)


def rebuild(results: DataFrame, folder: str, root: str | None = None) -> DataFrame:
    """Writes each result (path, output) as {stem}.deid{ext} in a folder of any file system; returns path and artifact.

    With root given, a file keeps its place below it, so that files of one name in two folders stay two.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names = []
            for name, text in zip(frame["path"], frame["output"], strict=True):
                names.append(artifact_of(name, os.path.dirname(name) if root is None else root, folder))
                put(names[-1], text.encode())
            yield pd.DataFrame({"path": frame["path"], "artifact": names})

    return results.select("path", "output").mapInPandas(each, "path string, artifact string")

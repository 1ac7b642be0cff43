"""What substring deduplication by bytes and by words share: anchors, which tell where a repeated window can be at all.

A window is `length` symbols of one text. Its anchor is the stretch of `anchor` symbols in it with the least hash (the
leftmost of equals), so that equal windows have equal anchors at the same place. Windows in a row with one anchor are a
path. Only a row for each path is ever shuffled, and only paths whose anchor occurs more than once go further: this is a
filter, which no repeated window fails. What is a repeat is decided by the operators, each in its own way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import (
    BYTE_BASE,
    BYTE_CODES,
    WORD_BASES,
    Words,
    blocks,
    mixed,
    row_keys,
    running,
    settled,
    stretch,
    string_buffers,
    text_or_empty,
    whole_windows,
)

#: A path's place in its text: its first window's start, and how many windows it has, in one number.
SHIFT = 16
WINDOWS = (1 << SHIFT) - 1
#: An anchor is hot if it is on more than this share of all paths, so that there are at most 1 / HOT of them; the rows
#: of a hot one are dealt over SALTS parts wherever they are joined.
HOT, SALTS = 1 / 1000, 64
_CODES2 = mixed(BYTE_CODES)


@dataclass(frozen=True)
class Spec:
    """words: whether symbols are words (else bytes); length: of a window; anchor: of an anchor."""

    words: bool
    length: int
    anchor: int


class Symbols:
    """The symbols of a run of texts: where each text's begin, and running hashes over them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, spec: Spec):
        self.spec = spec
        if spec.words:
            self.at = Words(data, offsets)
            self.first, self.base = self.at.first, WORD_BASES[0]
            self.one = running(mixed(self.at.hashes), self.base)
            self.two = running(self.at.hashes, WORD_BASES[1])
        else:
            self.first, self.base = offsets, BYTE_BASE
            self.one, self.two = running(BYTE_CODES[data], self.base), running(_CODES2[data], WORD_BASES[1])

    def paths(self) -> tuple[np.ndarray, ...]:
        """(text, start within it, windows, anchor, path): a row for each path."""
        s = self.spec
        starts = whole_windows(self.first, s.length)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        k = np.arange(len(self.one) - s.anchor)
        least, place, width, wide = stretch(self.one, k, k + s.anchor, self.base), k, 1, s.length - s.anchor + 1
        while width < wide:  # the least of ever longer runs of anchors, from two shorter runs
            step = min(width, wide - width)
            left, right = least[:-step], least[step:]
            right_wins = right < left
            least = np.where(right_wins, right, left)
            place = np.where(right_wins, place[step:], place[:-step])
            width += step
        where = place[starts]
        text = np.searchsorted(self.first, starts, "right") - 1
        begin = np.ones(len(starts), bool)
        begin[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(begin)
        n = np.diff(np.append(at, len(starts)))
        start, text = starts[at], text[at]
        path = stretch(self.two, start, start + n - 1 + s.length, WORD_BASES[1])
        return text, start - self.first[text], n, least[start], path


def spread_out(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(path, place) of each window of paths that start at `start` and have n windows."""
    path = np.repeat(np.arange(len(start)), n)
    return path, np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 and text: k1 and k2 identify a row by doc_id and text."""
    rows = text_or_empty(docs)
    return rows.select("doc_id", *row_keys(rows), "text")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def runs(batch: pa.RecordBatch, spec: Spec) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Symbols]]:
    """Runs of a batch's texts: from and to which row, their bytes and offsets, and symbols."""
    data, offsets = string_buffers(batch.column("text"))
    for lo, hi in blocks(offsets, 1 << 17):
        here, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield lo, hi, here, at, Symbols(here, at, spec)


@dataclass
class Anchors:
    """again: the anchors that occur more than once, one row for each salt; hot: those that have several salts."""

    again: DataFrame
    hot: np.ndarray

    def salts(self) -> Column:
        """The salts that rows of an anchor may have, for the side of a join that has one row for each anchor or path."""
        few = F.array(F.lit(0))
        if not len(self.hot):
            return few
        return F.when(F.col("anchor").isin(self.hot.tolist()), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(few)


def recurring(rows: DataFrame, spec: Spec) -> Anchors:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, symbols in runs(batch, spec):
                yield pa.RecordBatch.from_arrays([signed(symbols.paths()[3])], ["anchor"])

    counts = rows.mapInArrow(each, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    # A table of a row for each anchor is written first: it is also asked for hot ones.
    again = settled(counts.where("n > 1"), "anchors")
    total = again.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = again.where(F.col("n") > max(10_000, total * HOT)).select("anchor").toArrow().column("anchor").to_numpy()
    found = Anchors(again, np.sort(hot.astype(np.int64)))
    found.again = again.select("anchor", F.explode(found.salts()).alias("salt"))
    return found


Extra = Callable[[np.ndarray, np.ndarray, Symbols, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]


def occurrences(rows: DataFrame, spec: Spec, found: Anchors, extra: Extra, schema: str, what: str) -> DataFrame:
    """A row for each path whose anchor occurs again: anchor, salt, lead, k1, k2, place, and what `extra` gives.

    extra(bytes, offsets, symbols, start among all symbols, windows, path) gives the columns that schema names. lead is
    a column of rows to order by, first of all.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    hot = found.hot

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, here, at, symbols in runs(batch, spec):
                text, start, n, anchor, path = symbols.paths()
                owner = pa.array(text + lo)
                salt = np.zeros(len(text), np.int32)
                if len(hot):
                    is_hot = np.isin(anchor.view(np.int64), hot)
                    k1 = batch.column("k1").to_numpy()[text + lo].view(np.uint64)
                    salt[is_hot] = (mixed(k1 + start.view(np.uint64)) % np.uint64(SALTS))[is_hot]
                arrays = [signed(anchor), pa.array(salt), *(batch.column(k).take(owner) for k in ("lead", "k1", "k2"))]
                arrays += [pa.array(start << SHIFT | n), *extra(here, at, symbols, symbols.first[text] + start, n, path)]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "salt", "lead", "k1", "k2", "place", *names])

    every = rows.mapInArrow(each, f"anchor long, salt int, lead long, k1 long, k2 long, place long, {schema}")
    return settled(every.join(found.again, ["anchor", "salt"], "left_semi"), what)


SOURCE = ("lead", "k1", "k2", "place")


def with_text(rows: DataFrame, some: DataFrame, fields: list[str]) -> DataFrame:
    """The texts that some of the paths (k1, k2 and fields) are in, each once, with their list `some`.

    Rows that share doc_id and text are one: only where there are such rows are their texts made distinct.
    """
    listed = some.groupBy("k1", "k2").agg(F.collect_list(F.struct(*fields)).alias("some"))
    twice = settled(rows.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "twice")
    # The lists of a partition are far smaller than its texts: hashed, they spare sorting texts.
    of = lambda part: rows.join(part.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "some")
    if twice.isEmpty():
        return of(listed)
    again = of(listed.join(twice, ["k1", "k2"], "left_semi")).dropDuplicates(["k1", "k2"])
    return of(listed.join(twice, ["k1", "k2"], "left_anti")).unionByName(again)


def listed_places(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, pa.StructArray]:
    """The text of each entry of the lists `some` of rows lo to hi of a batch, and the entries."""
    part = batch.column("some")[lo:hi]
    sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(hi - lo), sizes), part.flatten()


Outcome = Callable[[memoryview, np.ndarray], tuple]


def applied(rows: DataFrame, marks: DataFrame, spec: Spec, outcome: Outcome, schema: dict[str, str]) -> DataFrame:
    """A row for each text: outcome(its bytes, which of its symbols are covered by a marked window).

    marks: k1, k2 and place (windows in a row); the same place may be marked more than once, and counts once.
    """
    listed = marks.groupBy("k1", "k2").agg(F.collect_set("place").alias("places")).hint("shuffle_hash")
    joined = rows.join(listed, ["k1", "k2"], "left").select("doc_id", "text", "places")
    kinds = [pa.int64() if t == "long" else pa.string() for t in schema.values()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            places = batch.column("places")
            sizes = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bounds, flat = np.concatenate(([0], np.cumsum(sizes))), places.flatten().to_numpy()
            out = []
            for lo, hi in blocks(offsets):
                here, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                first = Words(here, at).first if spec.words else at
                step = np.zeros(first[-1] + 1, np.int64)
                mine = flat[bounds[lo] : bounds[hi]]
                start = np.repeat(first[:-1], np.diff(bounds[lo : hi + 1])) + (mine >> SHIFT)
                np.add.at(step, start, 1)
                np.add.at(step, start + (mine & WINDOWS) - 1 + spec.length, -1)
                covered = np.cumsum(step[:-1]) > 0
                raw = memoryview(np.ascontiguousarray(here))
                out += [outcome(raw[at[i] : at[i + 1]], covered[first[i] : first[i + 1]]) for i in range(hi - lo)]
            if out:
                columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            else:
                columns = [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *schema])

    return joined.mapInArrow(each, "doc_id long, " + ", ".join(f"{k} {t}" for k, t in schema.items()))

"""Substring deduplication by words: a de Bruijn graph of repeated windows, compacted in joins and read back at its sources."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import WORD_BASES, drop_settled, settled, settled_so_far, stretch
from umbra.llm.repeats import (
    SHIFT,
    SOURCE,
    WINDOWS,
    Spec,
    Symbols,
    applied,
    keyed,
    listed_places,
    occurrences,
    recurring,
    runs,
    signed,
    spread_out,
    with_text,
)

_OUT = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}
#: An edge of the graph is one window, or several in a row that nothing enters or leaves between: its first and last
#: nodes (the words of a window but one, hashed) and a digest of all its words.
EDGE = ("source", "target", "words")
_EDGE = "source long, target long, words long"


def _plain(here: np.ndarray, symbols: Symbols) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a run of texts joined by single spaces, and where each begins and ends there."""
    starts, ends = symbols.at.starts, symbols.at.ends
    sizes = ends - starts
    stops = np.cumsum(sizes + 1) - 1
    keep = np.zeros(len(here) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    inside = np.cumsum(keep[:-1]) > 0
    out = np.full(int(stops[-1]) + 1 if len(stops) else 0, 32, np.uint8)
    word = np.repeat(stops - sizes - starts, sizes)
    at = np.flatnonzero(inside)
    out[at + word] = here[at]
    return out.tobytes(), stops - sizes, stops


def _edges(here, at, symbols: Symbols, start: np.ndarray, n: np.ndarray, path=None) -> list[pa.Array]:
    """source, target and words of edges that start at word `start` and have n windows."""
    size = symbols.spec.length
    end = start + n - 1 + size
    source = stretch(symbols.two, start, start + size - 1, WORD_BASES[1])
    target = stretch(symbols.two, end - size + 1, end, WORD_BASES[1])
    plain, begins, ends = _plain(here, symbols)
    blake, raw = hashlib.blake2b, memoryview(plain)
    pairs = zip(begins[start].tolist(), ends[end - 1].tolist(), strict=True) if len(start) else []
    words = b"".join([blake(raw[a:b], digest_size=8).digest() for a, b in pairs])
    return [signed(source), signed(target), pa.array(np.frombuffer(words, np.int64))]


#: A window of an edge: the edge by where it first stands (whole), the window's number in it, and its own edge.
_UNIT = f"lead long, k1 long, k2 long, whole long, at long, copies long, {_EDGE}"


def _single(spec: Spec):
    """A row for each window of the edges listed for each text: edges of one window each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, here, at, symbols in runs(batch, spec):
                text, some = listed_places(batch, lo, hi)
                place = some.field("place").to_numpy()
                edge, word = spread_out(symbols.first[text] + (place >> SHIFT), place & WINDOWS)
                of, row = pa.array(edge), pa.array(text[edge] + lo)
                start = symbols.first[text[edge]] + (place[edge] >> SHIFT)
                own = [some.field("lead").take(of), *(batch.column(k).take(row) for k in ("k1", "k2"))]
                own += [pa.array(place[edge]), pa.array(word - start), some.field("copies").take(of)]
                arrays = [*own, *_edges(here, at, symbols, word, np.ones(len(word), np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _UNIT.split(", ")])

    return each


def _inner(edges: DataFrame) -> DataFrame:
    """The nodes that one edge enters and one leaves."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(edges.select(F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    return degrees.where("`out` = 1 and `in` = 1").select("node")


def unitigs(edges: DataFrame) -> DataFrame:
    """edges (source, target, words, n, and where each first stands: k1, k2, start) with unitig and offset.

    Most edges that follow each other in the graph first stand one after the other in one text too. These are made runs
    within their text first, so that the graph which is compacted in joins is far smaller.
    """
    inner = _inner(edges).select(F.col("node").alias("source"), F.lit(True).alias("passed"))
    text = Window.partitionBy("k1", "k2").orderBy("start")
    follows = (F.lag(F.col("start") + F.col("n")).over(text) == F.col("start")) & (F.lag("target").over(text) == F.col("source"))
    here = edges.join(inner, "source", "left").withColumn("new", ~F.coalesce(F.col("passed") & follows, F.lit(False)))
    here = here.withColumn("run", F.sum(F.col("new").cast("long")).over(text))
    before = Window.partitionBy("k1", "k2", "run").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    here = settled(here.withColumn("on", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("passed", "new"), "runs")
    ends = (F.min_by("source", "start").alias("source"), F.max_by("target", "start").alias("target"), F.sum("n").alias("n"))
    paths = compacted(settled(here.groupBy("k1", "k2", "run").agg(*ends), "run-edges"))
    paths = settled(paths.select("k1", "k2", "run", "unitig", F.col("offset").alias("from")), "compacted")
    return here.join(paths, ["k1", "k2", "run"]).select(*EDGE, "unitig", (F.col("from") + F.col("on")).alias("offset"))


def compacted(edges: DataFrame) -> DataFrame:
    """edges (source, target, n) with unitig and offset: the nonbranching path each is on, and where on it, in windows.

    A node that one edge enters and one leaves is passed through; edges in a row over such nodes are one path. Each such
    node points to the one before it, and pointers are doubled in joins until all reach the first node of their path, so
    rounds grow with the logarithm of the longest path. What is left when a round finishes no node are cycles, which
    stay as single edges.
    """
    inner = settled(_inner(edges), "inner")
    entered = edges.join(inner.withColumnRenamed("node", "target"), "target").select("source", "target", "n")
    before = entered.join(inner.select(F.col("node").alias("source"), F.lit(True).alias("passed")), "source", "left")
    # far: windows between the start of the path and the node, as far as it is known.
    now = settled(
        before.select(F.col("target").alias("node"), F.when(F.col("passed"), F.col("source")).alias("to"), F.col("n").alias("far")),
        "pointers",
    )
    ended, todo = [now.where("to is null").select("node", F.col("node").alias("unitig"), "far")], now.where("to is not null")
    left = todo.count()
    while left:
        known = ended[0]
        for part in ended[1:]:
            known = known.unionByName(part)
        known = known.select(F.col("node").alias("to"), "unitig", F.col("far").alias("more"))
        on = now.where("to is not null").select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        step = known.select("to", "unitig", F.lit(None).cast("long").alias("next"), "more").unionByName(
            on.select("to", F.lit(None).cast("long").alias("unitig"), "next", "more")
        )
        joined = now.where("to is not null").join(step, "to")
        moved = settled(
            joined.select("node", "unitig", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far")), "pointers"
        )
        ended.append(moved.where("unitig is not null").select("node", "unitig", "far"))
        now = moved.select("node", "to", "far")
        last, left = left, now.where("to is not null").count()
        if left == last:
            break
    known = ended[0]
    for part in ended[1:]:
        known = known.unionByName(part)
    known = settled(known, "unitigs")
    through = known.select(F.col("node").alias("source"), F.col("unitig").alias("u1"), F.col("far"))
    into = known.where("node = unitig").select(F.col("node").alias("target"), F.col("unitig").alias("u2"))
    out = edges.join(through, "source", "left").join(into, "target", "left")
    alone = F.xxhash64("source", "target")
    return out.withColumn("unitig", F.coalesce("u1", "u2", alone)).withColumn("offset", F.coalesce("far", F.lit(0))).drop("u1", "u2", "far")


def _graph(rows: DataFrame, spec: Spec, first_stays: bool) -> tuple[DataFrame, DataFrame]:
    """(found, kept): edges of the texts, and those repeated: unitig, offset, and where in the edges of a text they are."""
    before = settled_so_far(rows.sparkSession)
    known = recurring(rows, spec)
    found = occurrences(rows, spec, known, _edges, _EDGE, "edges")
    first = F.min(F.struct(*SOURCE)).alias("first")
    classes = settled(found.groupBy("anchor", *EDGE).agg(F.count("*").alias("copies"), first), "classes")
    ways = classes.groupBy("anchor").agg(F.count("*").alias("ways"), F.min("copies").alias("least"))
    forks = settled(ways.where("ways > 1" + ("" if first_stays else " and least = 1")).select("anchor"), "forks")
    forked = classes.join(forks, "anchor", "left_semi").select("anchor", *EDGE, "copies", "first.*")
    texts = with_text(rows, forked, ["place", "lead", "copies"])
    single = settled(texts.mapInArrow(_single(spec), _UNIT), "windows")
    own = F.struct("lead", "k1", "k2", (F.shiftleft(F.shiftright("whole", SHIFT) + F.col("at"), SHIFT) + 1).alias("place"))
    again = single.groupBy(*EDGE).agg(F.sum("copies").alias("copies"), F.min(own).alias("first")).where("copies > 1")
    again = settled(again, "again")
    repeated = classes.join(forks, "anchor", "left_anti").where("copies > 1")
    windows = F.col("first.place").bitwiseAND(F.lit(WINDOWS))
    first = ("first.k1", "first.k2", F.shiftright("first.place", SHIFT).alias("start"))
    edges = repeated.select(*EDGE, windows.alias("n"), *first)
    edges = edges.unionByName(again.select(*EDGE, F.lit(1).cast("long").alias("n"), *first))
    graph = settled(unitigs(settled(edges, "graph")), "unitigs")
    piece = lambda at, n, low: F.struct(at.alias("at"), n.alias("n"), "unitig", "offset", low.alias("low"))
    zero, one, null = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(None).cast("boolean")
    whole = repeated.join(graph, list(EDGE)).select("anchor", *EDGE, "first", F.array(piece(zero, windows, null)).alias("pieces"))
    hits = single.join(again.select(*EDGE, F.col("first").alias("least")), list(EDGE)).join(graph, list(EDGE))
    hits = hits.groupBy("k1", "k2", F.col("whole").alias("place")).agg(F.collect_list(piece(F.col("at"), one, own == F.col("least"))).alias("pieces"))
    # first_stays: later copies of a forked edge are repeated as a whole, whichever of its windows are elsewhere too
    forked = classes.join(forks, "anchor", "left_semi").select("anchor", *EDGE, "first", "first.k1", "first.k2", "first.place")
    hits = forked.join(hits, ["k1", "k2", "place"], "left" if first_stays else "inner")
    kept = whole.unionByName(hits.select("anchor", *EDGE, "first", "pieces"))
    kept = settled(kept, "kept")
    drop_settled(rows.sparkSession, before | {found.settled_at, kept.settled_at})  # the result reads these two
    return found, kept.withColumn("salt", F.explode(known.salts()))


def repeated_spans(docs: DataFrame, width: int = 35, anchor: int = 12, first_stays: bool = False) -> DataFrame:
    """k1, k2, place, unitig, offset: the windows of each row of docs (see keyed) that occur elsewhere too.

    place is a run of windows, start << SHIFT | number; unitig names the repeated passage they are on, at offset.
    """
    spec = Spec(True, width, anchor)
    rows = keyed(docs).withColumn("lead", F.col("doc_id") if first_stays else F.lit(0).cast("long"))
    return _spans(*_graph(rows, spec, first_stays), first_stays)


def _spans(found: DataFrame, kept: DataFrame, first_stays: bool) -> DataFrame:
    hit = found.join(kept, ["anchor", *EDGE, "salt"])
    start, n = F.shiftright("place", SHIFT), F.col("place").bitwiseAND(F.lit(WINDOWS))
    pieces = F.col("pieces")
    if first_stays:
        own = F.lit(True)
        for k in SOURCE:
            own = own & F.col(k).eqNullSafe(F.col(f"first.{k}"))
        later = F.filter(F.coalesce(pieces, F.array().cast(kept.schema["pieces"].dataType)), lambda p: F.lit(False) == p["low"])
        null = F.lit(None).cast("long")
        all_of = F.array(F.struct(F.lit(0).cast("long").alias("at"), n.alias("n"), null.alias("unitig"), null.alias("offset"), F.lit(None).cast("boolean").alias("low")))
        pieces = F.when(own, later).otherwise(all_of)
    hit = hit.select("k1", "k2", start.alias("start"), F.explode(pieces).alias("p"))
    place = F.shiftleft(F.col("start") + F.col("p.at"), SHIFT).bitwiseOR(F.col("p.n"))
    return hit.select("k1", "k2", place.alias("place"), "p.unitig", "p.offset")


def _outcome(text: memoryview, covered: np.ndarray) -> tuple[int, int, str]:
    words = bytes(text).split()
    removed = int(covered.sum())
    if removed:
        words = [words[i] for i in np.flatnonzero(~covered)]
    return len(covered), removed, hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(docs: DataFrame, width: int = 35, anchor: int = 12, first_stays: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of docs, without the words of repeated windows.

    Windows of `width` words are the edges of a de Bruijn graph, between their first and last width-1 words. Windows in
    a row under one anchor are one edge to begin with, unless some but not all of an anchor's edges are repeated: these
    fork within, and are taken window by window. Edges that occur more than once are kept; those in a row over nodes
    that one edge enters and one leaves are compacted into paths by pointer doubling in joins. Each text's edges are
    then looked up at their own coordinates: equal ones have equal end nodes and the same digest of all their words
    there (192 bits together), and every word that a repeated one covers is removed (first_stays: only windows with an
    earlier copy, in the order of doc_id, text hash and place).

    Words are [^\\x20\\x09-\\x0D]+. Windows lie within one text; texts with fewer words, null and empty ones lose nothing;
    very long ones are worked on whole, in memory that grows with them. Repeated rows are copies of each other like
    others and each give their row; rows with a null doc_id, or one that others have too, count like others; other
    columns, whatever their names, are left out; an empty table gives no rows.
    """
    spec = Spec(True, width, anchor)
    rows = keyed(docs).withColumn("lead", F.col("doc_id") if first_stays else F.lit(0).cast("long"))
    spans = _spans(*_graph(rows, spec, first_stays), first_stays)
    return applied(rows, spans.select("k1", "k2", "place"), spec, _outcome, _OUT)

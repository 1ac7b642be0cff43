"""Substring deduplication by bytes: longest-previous-factor arrays over the suffixes of candidate regions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import drop_settled, settled, settled_so_far, string_buffers
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
    signed,
    spread_out,
    with_text,
)

#: Different regions of one anchor that are put into one suffix order; those of anchors with more are sorted further,
#: by longer anchors.
WAYS = 1024
#: Bytes of regions that are ordered at once; an anchor's regions stay together.
REGIONS = 1 << 20
_REGION = "anchor long, path long, lead long, k1 long, k2 long, place long, copies long, content binary"
_NAMES = [f.split()[0] for f in _REGION.split(", ")]
_SPANS = "anchor long, path long, spans array<long>"
_OUT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes that start at `at`, cut off at `length` bytes (all have that many).

    lcp[i] is how many bytes the i-th in order has in common with the one before it. Equal ones keep their order.
    """
    wide = -(-length // 8) * 8
    suffixes = np.zeros((len(at), wide), np.uint8)
    if len(at):
        suffixes[:, :length] = sliding_window_view(data, length)[at]
    order = np.argsort(suffixes.view(f"S{wide}").ravel(), kind="stable")
    lcp = np.zeros(len(at), np.int64)
    if len(at) > 1:
        eights = suffixes.view("<u8")[order]
        apart = eights[1:] ^ eights[:-1]
        column = (apart != 0).argmax(1)
        x = apart[np.arange(len(apart)), column]
        low = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64)  # zero bits below the first set
        lcp[1:] = np.where(x == 0, length, np.minimum(8 * column + low // 8, length))
    return order, lcp


def _before(source: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """What each suffix has in common with the nearest one before it in order whose source is smaller; under `least`: 0.

    The nearest smaller one is found by halving: the least source and the least lcp are known for every run of 2**k
    entries, and a run without a smaller source is passed over whole.
    """
    n = len(source)
    at, common = np.arange(n) - 1, lcp.copy()
    open_ = np.flatnonzero((at >= 0) & (common >= least))
    open_ = open_[source[at[open_]] > source[open_]]
    if len(open_):
        lows, commons = [source], [lcp]
        while (1 << len(lows)) <= n:
            w = 1 << (len(lows) - 1)
            for table in (lows, commons):
                x = table[-1].copy()
                x[w:] = np.minimum(x[w:], table[-1][:-w])
                table.append(x)
        place, shared, own = at[open_], common[open_], source[open_]
        for k in range(len(lows) - 1, -1, -1):
            over = np.flatnonzero((place >= 0) & (lows[k][np.maximum(place, 0)] > own))
            shared[over] = np.minimum(shared[over], commons[k][place[over]])
            place[over] -= 1 << k
        common[open_] = np.where(place >= 0, shared, 0)
    return np.where(common >= least, common, 0)


def previous_factors(source: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest-previous-factor array: how many bytes each suffix shares with some suffix of smaller source.

    source: where each suffix in order starts; lcp: what it has in common with the one before it. The earlier match that
    is longest is with the nearest smaller source on either side in suffix order. Lengths under `least` count as 0.
    """
    back = np.concatenate((lcp[:1] * 0, lcp[:0:-1]))  # the order read from its end
    return np.maximum(_before(source, lcp, least), _before(source[::-1], back, least)[::-1])


def next_factors(source: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """The mirror of previous_factors: with some suffix of larger source."""
    return previous_factors(-source, lcp, least)


def _contents(spec: Spec):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            text, some = listed_places(batch, 0, batch.num_rows)
            place = some.field("place").to_numpy()
            begin = offsets[text] + (place >> SHIFT)
            end = begin + (place & WINDOWS) - 1 + spec.length
            content = [data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            anchor, path, lead, copies = (some.field(k) for k in ("anchor", "path", "lead", "copies"))
            k1, k2 = (batch.column(k).take(pa.array(text)) for k in ("k1", "k2"))
            arrays = [anchor, path, lead, k1, k2, pa.array(place), copies, pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    return each


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by anchor, dealt anew so that an anchor's rows are in one of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
        if held and cut:
            first = held[0].column("anchor")[0].as_py()
            split = int(np.searchsorted(anchor, first, "right"))
            held.append(batch.slice(0, split))
            yield pa.concat_batches(held)
            held = []
            if split < cut:
                yield batch.slice(split, cut - split)
            held = [batch.slice(cut)]
        elif held and anchor[0] != held[0].column("anchor")[0].as_py():
            yield pa.concat_batches(held)
            held = [batch]
        elif held:
            held.append(batch)
        else:
            if cut:
                yield batch.slice(0, cut)
            held = [batch.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def repeated_windows(
    data: np.ndarray, starts: np.ndarray, n: np.ndarray, text: np.ndarray, place: np.ndarray, copies: np.ndarray, spec: Spec
) -> tuple[np.ndarray, np.ndarray]:
    """(region, earlier, either) for each window of regions: has it an earlier match, has it an earlier or a later one.

    Region i is data[starts[i]:] with n[i] windows; its first source is at `place` of `text`. A region that has more
    sources is in the suffix order twice, once for its first source and once for a later one; equal suffixes stand side
    by side in it and have all of their bytes in common.
    """
    region, at = spread_out(starts, n)
    first = (text[region] << 40) + place[region] + at - starts[region]
    by_source = np.argsort(first, kind="stable")
    order, lcp = suffix_order(data, at[by_source], spec.length)
    order = by_source[order]
    entries = 1 + (copies[region[order]] > 1)
    which = np.repeat(order, entries)
    later = np.zeros(len(which), bool)
    later[1:] = which[1:] == which[:-1]
    common = np.where(later, spec.length, np.repeat(lcp, entries))
    source = np.where(later, first[which] + (1 << 61), first[which])
    before = previous_factors(source, common, spec.length) >= spec.length
    after = next_factors(source, common, spec.length) >= spec.length
    earlier, either = np.zeros(len(region), bool), np.zeros(len(region), bool)
    earlier[which[before & ~later]] = True
    either[which[before | after]] = True
    return earlier, either


def _factors(spec: Spec, first_stays: bool):
    """Repeated windows of the regions of each anchor: a list of windows in a row for each region that has some."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            _, offsets = string_buffers(batch.column("content"))
            anchor = batch.column("anchor").to_numpy()
            breaks = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]))
            lo = 0
            while lo < len(breaks) - 1:
                size = offsets[breaks[lo]] + REGIONS
                hi = max(lo + 1, int(np.searchsorted(offsets[breaks], size, "right")) - 1)
                part = batch.slice(int(breaks[lo]), int(breaks[hi] - breaks[lo]))
                lo = hi
                here, at = string_buffers(part.column("content"))
                null = part.column("lead").is_null().to_numpy(zero_copy_only=False)
                lead = part.column("lead").fill_null(0).to_numpy(zero_copy_only=False)
                k1, k2, place, copies = (part.column(k).to_numpy() for k in ("k1", "k2", "place", "copies"))
                keys = np.lexsort((k2, k1, lead, ~null))
                new = np.zeros(len(keys), np.int64)
                for k in (null, lead, k1, k2):
                    new[1:] |= k[keys[1:]] != k[keys[:-1]]
                text = np.zeros(len(keys), np.int64)
                text[keys] = np.cumsum(new)
                n = place & WINDOWS
                earlier, either = repeated_windows(here, at[:-1], n, text, place >> SHIFT, copies, spec)
                hit = earlier if first_stays else either
                region, offset = spread_out(np.zeros(len(n), np.int64), n)
                on, begin = np.flatnonzero(hit), np.zeros(len(hit), bool)
                begin[on] = ~hit[on - 1] | (offset[on] == 0)
                begin = np.flatnonzero(begin)
                stop = ~np.append(hit[1:], False)
                stop[np.cumsum(n) - 1] = True
                stop = np.flatnonzero(stop & hit)
                spans = offset[begin] << SHIFT | (stop - begin + 1)
                ends = np.concatenate(([0], np.cumsum(np.bincount(region[begin], minlength=len(n))))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(spans))
                yield pa.RecordBatch.from_arrays([part.column("anchor"), part.column("path"), lists], ["anchor", "path", "spans"])

    return each


def _by_suffix(regions: DataFrame, spec: Spec, first_stays: bool) -> DataFrame:
    near = regions.repartition("anchor").sortWithinPartitions("anchor")
    return near.mapInArrow(_factors(spec, first_stays), _SPANS)


_CUT = "path0 long, anchor0 long, at long, " + _REGION


def _cut(spec: Spec):
    """Regions cut into paths under longer anchors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("content"))
            region, start, n, anchor, path = Symbols(data, offsets, spec).paths()
            begin = offsets[region] + start
            content = [data[a : a + k].tobytes() for a, k in zip(begin.tolist(), (n - 1 + spec.length).tolist(), strict=True)]
            of = pa.array(region)
            place = ((batch.column("place").to_numpy()[region] >> SHIFT) + start) << SHIFT | n
            own = [batch.column(k).take(of) for k in ("path", "anchor")]
            rest = [batch.column(k).take(of) for k in ("lead", "k1", "k2")]
            arrays = [*own, pa.array(start << SHIFT | n), signed(anchor), signed(path), *rest, pa.array(place)]
            arrays += [batch.column("copies").take(of), pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _CUT.split(", ")])

    return each


def _is_first(first: str) -> Column:
    """Whether a row's own source is the one that `first` holds."""
    same = [F.col(k).eqNullSafe(F.col(f"{first}.{k}")) for k in SOURCE]
    return same[0] & same[1] & same[2] & same[3]


def _of_all(paths: DataFrame, spans: DataFrame) -> DataFrame:
    """(anchor, path, first, spans) of all paths: without spans, an empty list."""
    none = F.array().cast("array<long>")
    every = paths.select("anchor", "path", "first").join(spans, ["anchor", "path"], "left")
    return every.withColumn("spans", F.coalesce("spans", none))


def _marked(rows: DataFrame, spans: DataFrame, keys: list[str], whole: Column, first_stays: bool) -> DataFrame:
    """rows with a column span for each run of repeated windows of theirs; spans: by path, and for the first source."""
    hit = rows.join(spans, keys)
    if first_stays:  # a later source of a path has an earlier copy of all of it
        hit = hit.withColumn("spans", F.when(_is_first("first"), F.col("spans")).otherwise(F.array(whole)))
    return hit.withColumn("span", F.explode("spans")).drop("spans")


def _resolved(regions: DataFrame, spec: Spec, first_stays: bool, ways: int, longer: tuple[int, ...]) -> DataFrame:
    """(anchor, path, spans) for different regions, settled: those of anchors with few ways are ordered at once.

    Regions of an anchor with more than `ways` are cut into paths under longer anchors first, and those whose anchors
    still have too many ways under longer ones again; the last anchors are whole windows, which have one way each.
    """
    many = regions.groupBy("anchor").agg(F.count("*").alias("ways")).where(F.col("ways") > ways)
    if not longer or (many := settled(many.select("anchor"), "many")).isEmpty():
        return _by_suffix(regions, spec, first_stays)
    few = _by_suffix(regions.join(many, "anchor", "left_anti"), spec, first_stays)
    hot = regions.join(many, "anchor", "left_semi")
    cut = settled(hot.mapInArrow(_cut(Spec(False, spec.length, longer[0])), _CUT), "cut")
    first = F.min(F.struct(*SOURCE)).alias("first")
    paths = cut.groupBy("anchor", "path").agg(first, F.sum("copies").alias("copies"), F.first("content").alias("content"))
    paths = settled(paths, "cut-paths")
    inner = _resolved(paths.select("anchor", "path", "first.*", "copies", "content"), spec, first_stays, ways, longer[1:])
    inner = settled(_of_all(paths, inner), "cut-spans")
    marked = _marked(cut, inner, ["anchor", "path"], F.col("at").bitwiseAND(F.lit(WINDOWS)), first_stays)
    # A span is an offset and a number of windows; the offset grows by that of the path within its region.
    span = F.col("span") + F.shiftleft(F.shiftright("at", SHIFT), SHIFT)
    more = marked.select(F.col("anchor0").alias("anchor"), F.col("path0").alias("path"), span.alias("span"))
    return few.unionByName(more.groupBy("anchor", "path").agg(F.collect_set("span").alias("spans")))


def _outcome(text: memoryview, covered: np.ndarray) -> tuple[int, int, int, str]:
    removed = int(covered.sum())
    if not removed:
        return len(covered), 0, 0, hashlib.sha256(text).hexdigest()
    spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
    return len(covered), removed, spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~covered].tobytes()).hexdigest()


def _path(here, at, symbols: Symbols, start: np.ndarray, n: np.ndarray, path: np.ndarray) -> list[pa.Array]:
    return [signed(path)]


def remove_repeats(
    docs: DataFrame, length: int = 200, anchor: int = 80, first_stays: bool = False, ways: int = WAYS
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs, without bytes of repeated strings.

    Strings of `length` bytes that occur more than once share an anchor, which tells the regions where they can be; an
    anchor that occurs once has none. The different regions around each anchor go into one suffix order, each with its
    sources, and longest-previous-factor arrays and their mirror come from previous and next smaller sources in that
    order: a factor of `length` marks a repeated string. Anchors with more than `ways` different regions are sorted
    further, by longer anchors, so that no task gathers an unbounded group. What holds for a region holds for all paths
    that equal it (by 128 bits of hashes). first_stays: only strings with an earlier copy are removed, in the order of
    doc_id, text hash and place; otherwise every copy is.

    Strings lie within one text, and may overlap; they are judged on the input. Null and empty texts, and shorter ones,
    lose nothing; very long ones are worked on whole, in memory that grows with them. Repeated rows are copies of each
    other and each give their row; rows with a null doc_id, or one that others have too, count like others; other
    columns, whatever their names, are left out; an empty table gives no rows.
    """
    spec = Spec(False, length, anchor)
    rows = keyed(docs).withColumn("lead", F.col("doc_id") if first_stays else F.lit(0).cast("long"))
    before = settled_so_far(docs.sparkSession)
    known = recurring(rows, spec)
    found = occurrences(rows, spec, known, _path, "path long", "paths")
    first = F.min(F.struct(*SOURCE)).alias("first")
    classes = settled(found.groupBy("anchor", "path").agg(F.count("*").alias("copies"), first), "classes")
    texts = with_text(rows, classes.select("anchor", "path", "copies", "first.*"), ["place", "anchor", "path", "lead", "copies"])
    regions = settled(texts.mapInArrow(_contents(spec), _REGION), "regions")
    spans = _resolved(regions, spec, first_stays, ways, ((length + anchor + 1) // 2, length))
    spans = _of_all(classes, spans) if first_stays else spans.where(F.size("spans") > 0)
    spans = settled(spans, "marks")
    drop_settled(docs.sparkSession, before | {found.settled_at, spans.settled_at})  # the result reads these two
    spans = spans.withColumn("salt", F.explode(known.salts()))
    windows = F.col("place").bitwiseAND(F.lit(WINDOWS))
    marks = _marked(found, spans, ["anchor", "path", "salt"], windows, first_stays)
    marks = marks.select("k1", "k2", (F.shiftleft(F.shiftright("place", SHIFT), SHIFT) + F.col("span")).alias("place"))
    return applied(rows, marks, spec, _outcome, _OUT)

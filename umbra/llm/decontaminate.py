"""Benchmark decontamination by spaced seeds: masks that ignore some word positions find overlaps with substitutions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import (
    FOLD,
    PUNCTUATION,
    Words,
    blocks,
    mixed,
    prepared,
    row_keys,
    settled,
    string_buffers,
    text_or_empty,
    whole_windows,
)

#: Fixed masks: a 1 is a word that must be equal, a 0 one that may differ.
MASKS = ("11111", "1101101", "11110111", "100110101", "1010010011")
#: Items of so many words or more are looked for; those shorter than the longest mask by their whole sequence, with as
#: many words changed as SHARE allows.
LEAST = 1
#: A document goes if it overlaps with an item of so many words; shorter ones are phrases that clean texts have as well.
DROPS = 4
#: An overlap is a stretch of so many aligned words, or a whole shorter item, of which at least this share are equal.
STRETCH, SHARE = 25, 0.8
#: Seeds of a block of the benchmark, which is broadcast; a larger benchmark takes more blocks, each a pass over the texts.
BLOCK_SEEDS = 1 << 20
#: Places of an item that are compared at once, and how far they reach around the block that a hit is in.
_PLACES, _AROUND = 64, 64
#: Seeds at more places of the benchmark than this are hot: their places are sifted by the words around before any other work.
_HOT = 64
#: Pairs of places that are held at once.
_PAIRS = 1 << 20
_TABLE = 20


def seed_hashes(words: np.ndarray, starts: np.ndarray, mask: str) -> np.ndarray:
    out = np.full(len(starts), len(mask) * 1000 + int(mask, 2), np.uint64)
    for i, m in enumerate(mask):
        if m == "1":
            out = (out ^ words[starts + i]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return mixed(out)


@dataclass
class Probe:
    """A block of benchmark items: their words one after the other, and by mask the sorted seeds with item and place."""

    ids: list
    words: np.ndarray
    first: np.ndarray  # where each item's words begin, and the end
    seeds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def lowered(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of letters and digits, A-Z in lower case."""
    return Words(FOLD[data], offsets, PUNCTUATION)


def _short_masks(n: int, share: float = SHARE) -> list[str]:
    """Masks over a whole item of n words, one for each way to change as many of them as an overlap may."""
    off = n - math.ceil(share * n - 1e-9)
    return ["".join("0" if i in gone else "1" for i in range(n)) for gone in combinations(range(n), off)]


def probe(ids: list, texts: list[str], least: int = LEAST, share: float = SHARE) -> Probe:
    data, offsets = string_buffers(pa.array(texts, pa.string()))
    w = lowered(data, offsets)
    sizes = w.counts()
    longest = max(map(len, MASKS))
    short = {m: int(n) for n in np.unique(sizes) if least <= n < longest for m in _short_masks(int(n), share)}
    seeds = {}
    for mask in dict.fromkeys([*MASKS, *sorted(short)]):
        at = whole_windows(w.first, len(mask))
        item = np.searchsorted(w.first, at, "right") - 1
        fits = (sizes[item] >= longest) & (mask in MASKS) | (sizes[item] == len(mask)) & (mask in short)
        at, item = at[fits & (sizes[item] >= least)], item[fits & (sizes[item] >= least)]
        h = seed_hashes(w.hashes, at, mask)
        order = np.argsort(h, kind="stable")
        table = np.zeros(1 << _TABLE, bool)
        table[h >> np.uint64(64 - _TABLE)] = True
        seeds[mask] = (h[order], item[order], (at - w.first[item])[order], table)
    return Probe(ids, w.hashes, w.first, seeds)


def _around(words: np.ndarray, first: np.ndarray, owner: np.ndarray, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The words from `reach` before to `reach` after places, a row for each, and whether they are their owner's."""
    place = at[:, None] + np.arange(-reach, reach + 1)
    inside = (place >= first[owner][:, None]) & (place < first[owner + 1][:, None])
    return words[np.clip(place, 0, max(0, len(words) - 1))], inside


def _sifted(p: Probe, w: Words, at: np.ndarray, low: int, high: int, mask: str, seeds: tuple, stretch: int, share: float):
    """(text places, entries) of a hot seed whose surroundings leave room for an overlap.

    An overlap around the seed has so many equal words within `stretch` of it besides the seed's own; each text place is
    held against all of the seed's entries by those words alone.
    """
    _, item, place, _ = seeds
    entries = np.arange(low, high)
    length = np.minimum(p.sizes()[item[entries]], stretch)
    need = np.ceil(share * length - 1e-9).astype(np.int64)
    owner = np.searchsorted(w.first, at, "right") - 1
    reach = stretch + len(mask)
    mine, mine_in = _around(w.hashes, w.first, owner, at, reach)
    theirs, theirs_in = _around(p.words, p.first, item[entries], p.first[item[entries]] + place[entries], reach)
    for k in range(len(at)):
        same = ((theirs == mine[k]) & theirs_in & mine_in[k]).sum(1)
        good = entries[same >= need]
        yield np.full(len(good), at[k]), good


def _hits(p: Probe, w: Words, stretch: int, share: float) -> Iterator[np.ndarray]:
    """Rows (text, item, alignment, block of the item's places) of seeds that texts share with items, some at a time."""
    for mask, seeds in p.seeds.items():
        h, item, place, table = seeds
        at = whole_windows(w.first, len(mask))
        own = seed_hashes(w.hashes, at, mask)
        maybe = table[own >> np.uint64(64 - _TABLE)]
        at, own = at[maybe], own[maybe]
        low, high = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
        n = high - low
        rows = lambda x, k: np.stack((np.searchsorted(w.first, x, "right") - 1, item[k], x - place[k], place[k] // _PLACES), 1)  # noqa: E731, B023
        for seed in np.unique(low[n > _HOT]).tolist():
            some = np.flatnonzero(low == seed)
            for x, k in _sifted(p, w, at[some], seed, int(high[some[0]]), mask, seeds, stretch, share):
                yield rows(x, k)
        few = np.flatnonzero((n > 0) & (n <= _HOT))
        for lo in range(0, len(few), _PAIRS // _HOT):
            part = few[lo : lo + _PAIRS // _HOT]
            m = n[part]
            yield rows(np.repeat(at[part], m), np.repeat(low[part] - np.cumsum(m) + m, m) + np.arange(m.sum()))


def overlaps(data: np.ndarray, offsets: np.ndarray, p: Probe, stretch: int = STRETCH, share: float = SHARE) -> np.ndarray:
    """Rows (text, item, start, length, equal): the best overlap of each text with each item, in words of the text.

    Each hit fixes an alignment, on which the item's places around the hit are compared: all of an item up to 128 words.
    """
    w = lowered(data, offsets)
    sizes, column = p.sizes(), np.arange(-_AROUND, _PLACES + _AROUND)
    best, held, many = np.zeros((0, 5), np.int64), [], 0

    def verified(every: np.ndarray) -> np.ndarray:
        out = [best]
        for lo in range(0, len(every), _PAIRS // len(column)):  # a bounded number at a time
            text, item, at, block = every[lo : lo + _PAIRS // len(column)].T
            theirs = block[:, None] * _PLACES + column
            place = at[:, None] + theirs
            inside = (theirs >= 0) & (theirs < sizes[item][:, None])
            inside &= (place >= w.first[text][:, None]) & (place < w.first[text + 1][:, None])
            mine = w.hashes[np.clip(place, 0, len(w.hashes) - 1)]
            same = inside & (mine == p.words[np.clip(p.first[item][:, None] + theirs, 0, len(p.words) - 1)])
            length = np.minimum(sizes[item], stretch)
            total = np.concatenate((np.zeros((len(same), 1), np.int64), np.cumsum(same, 1)), 1)
            ends = np.minimum(np.arange(len(column)) + length[:, None], len(column))
            equal = np.take_along_axis(total, ends, 1) - total[:, :-1]
            equal[(theirs < 0) | (theirs + length[:, None] > sizes[item][:, None])] = 0
            first = equal.argmax(1)
            most = equal[np.arange(len(first)), first]
            good = most >= share * length
            start = place[np.arange(len(first)), first] - w.first[text]
            out.append(np.stack((text, item, start, length, most), 1)[good])
        rows = np.concatenate(out)
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 4], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        return rows[new]

    for rows in _hits(p, w, stretch, share):
        held.append(rows)
        many += len(rows)
        if many > _PAIRS:
            best, held, many = verified(np.unique(np.concatenate(held), axis=0)), [], 0
    return verified(np.unique(np.concatenate(held), axis=0)) if held else best


def probes(benchmark: DataFrame, key: str = "item_id", block_seeds: int = BLOCK_SEEDS, least: int = LEAST, share: float = SHARE):
    """(how many blocks, an iterator over them): the benchmark in blocks of bounded size, one of which is held at a time.

    Items without text, or with too few words, find nothing.
    """
    items = prepared(benchmark, key, "text").where("text is not null").withColumn(key, F.col(key).cast("long"))
    words = items.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-int(words) * len(MASKS) // (2 * block_seeds)))  # a word and its end take two characters at least

    def blocks_of() -> Iterator[Probe]:
        for k in range(parts):
            rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).collect()
            if rows:
                yield probe([r[key] for r in rows], [r["text"] for r in rows], least, share)

    return parts, blocks_of()


_LEAKS = "doc_id long, item_id long, start long, length long, equal long, similarity double"


def _leaks(shared, stretch: int, share: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for lo, hi in blocks(offsets):
                hits = overlaps(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], p, stretch, share)
                if len(hits):
                    ids = pa.array([p.ids[i] for i in hits[:, 1]], pa.int64())
                    rest = [pa.array(hits[:, k]) for k in (2, 3, 4)] + [pa.array(hits[:, 4] / hits[:, 3])]
                    owner = batch.column("doc_id").take(pa.array(hits[:, 0] + lo))
                    yield pa.RecordBatch.from_arrays([owner, ids, *rest], [f.split()[0] for f in _LEAKS.split(", ")])

    return each


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    stretch: int = STRETCH,
    share: float = SHARE,
    block_seeds: int = BLOCK_SEEDS,
    least: int = LEAST,
) -> DataFrame:
    """doc_id, item_id, start, length, equal, similarity: the best overlap of each row of docs with each benchmark item.

    Seeds of the whole texts are joined with the benchmark's by binary search, behind a table that most seeds fail; each
    hit fixes an alignment, and an overlap counts if at least `share` of a stretch of `stretch` aligned words (or of a
    whole shorter item) are equal. Places of a seed that much of the benchmark has are sifted by the words around it.
    A benchmark of more than one block is gone through block by block, each written before the next is held.

    Only rows with an overlap are returned. Null and empty texts overlap with nothing, nor do items of fewer than
    `least` words; very long texts are worked on whole. Repeated rows each give theirs; equally good overlaps of a pair
    give the first; other columns, whatever their names, are left out; empty tables give no rows.
    """
    spark, out = docs.sparkSession, docs.sparkSession.createDataFrame([], _LEAKS)
    parts, some = probes(benchmark, "item_id", block_seeds, least, share)
    for p in some:
        shared = spark.sparkContext.broadcast(p)
        part = text_or_empty(docs).mapInArrow(_leaks(shared, stretch, share), _LEAKS)
        if parts == 1:
            return part
        out = out.unionByName(settled(part, "leaks"))
        shared.destroy()
    return out


def _without(shared, stretch: int, share: float, keys: bool):
    """Batches without the rows that overlap with an item, or (keys) k1 and k2 of those that do."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text").fill_null(""))
            gone = np.zeros(batch.num_rows, bool)
            for lo, hi in blocks(offsets):
                here, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                gone[overlaps(here, at, shared.value, stretch, share)[:, 0] + lo] = True
            yield batch.filter(pa.array(gone)).select(["k1", "k2"]) if keys else batch.filter(pa.array(~gone))

    return each


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    stretch: int = STRETCH,
    share: float = SHARE,
    block_seeds: int = BLOCK_SEEDS,
    least: int = DROPS,
) -> DataFrame:
    """The rows of docs that overlap with no benchmark item of at least `least` words, with all their columns.

    Overlaps are those of leaks. Null and empty texts stay, as do rows with a null doc_id; repeated rows stay or go
    alike; an empty table, or an empty benchmark, takes nothing away.
    """
    schema, docs = docs.schema, prepared(docs, *docs.columns)
    spark, found = docs.sparkSession, None
    parts, some = probes(benchmark, "item_id", block_seeds, least, share)
    for p in some:
        shared = spark.sparkContext.broadcast(p)
        if parts == 1:
            return docs.mapInArrow(_without(shared, stretch, share, False), schema)
        keyed = docs.select(*row_keys(docs), "text")
        part = settled(keyed.mapInArrow(_without(shared, stretch, share, True), "k1 long, k2 long"), "leaky")
        found = part if found is None else found.unionByName(part)
        shared.destroy()
    if found is None:
        return docs
    whole = docs.select(*row_keys(docs), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return whole.join(found.distinct().hint("shuffle_hash"), ["k1", "k2"], "left_anti").select("row.*")

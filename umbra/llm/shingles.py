"""Near-duplicates by the Jaccard similarity of word shingles: SimHash first, and an exact prefix-filtered join for the rest.

Fingerprints of 64 bits find copies that differ little: covering tables guarantee every pair within a few bits. A pair at
a similarity of 0.8 is some ten bits apart, where no covering of 64 bits is selective. So links that fingerprints find are
verified on whole sets and kept, and pairs of texts that aren't connected over them are looked for by shared shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import (
    FOLD,
    WORD_BASES,
    Words,
    blocks,
    drop,
    mixed,
    row_keys,
    running,
    settled,
    stretch,
    string_buffers,
    text_or_empty,
    whole_windows,
)
from umbra.llm.graph import components
from umbra.llm.simhash import BUCKET as FINGERPRINTS
from umbra.llm.simhash import KEY, one_each
from umbra.llm.simhash import links as fingerprint_links

#: Texts are linked from this similarity on, a fraction so that comparisons are exact.
SIMILARITY = (4, 5)
#: Bits between fingerprints that are looked for first.
RADIUS = 4
#: In buckets of more than so many sets, links to leaders are tried before all pairs that are still open.
BUCKET = 2
#: Leaders that a set is compared with; sets of a large bucket that are compared within one row.
LEADERS, BLOCK = 8, 1024
#: Common shingles come last in the order of all; one text of so many is looked at to find up to COMMON of them.
#: Any order gives the same links: this one keeps what many texts share out of the prefixes.
SHARE, OFTEN, COMMON = 16, 8, 1 << 16
#: Least and most 64-bit words of a set's parities: four bits for each of its shingles, rounded up to a power of two, so
#: that few shingles share one. What they let through that whole sets don't is then little.
_LEAST, _MOST = 16, 1 << 12
#: Bits of the bitmaps that say which texts' whole sets, and which shingles, are looked at again.
MARKS = 1 << 23


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its different shingles of `width` words, A-Z in lower case, as sorted hashes; a shorter text is one."""
    for lo, hi in blocks(offsets):
        base = offsets[lo]
        w = Words(FOLD[data[base : offsets[hi]]], offsets[lo : hi + 1] - base)
        prefix = running(mixed(w.hashes), WORD_BASES[0])
        starts = whole_windows(w.first, width)
        hashes = stretch(prefix, starts, starts + width, WORD_BASES[0])
        n = w.counts()
        at = np.concatenate(([0], np.cumsum(np.maximum(n - width + 1, 0))))
        for k in range(hi - lo):
            if 0 < n[k] < width:
                yield stretch(prefix, w.first[k : k + 1], w.first[k + 1 : k + 2], WORD_BASES[0])
            else:
                yield np.unique(hashes[at[k] : at[k + 1]])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _name(x: np.ndarray) -> np.uint64:
    return mixed(mixed(x).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x)))[0]


def _tokens(width: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0, np.uint64), *sets(*string_buffers(batch.column("text")), width)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["t"])

    return each


def fingerprint(x: np.ndarray) -> int:
    """The SimHash of a set of hashes: a bit is 1 if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(x), 1 << 14):
        ones += np.unpackbits(x[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(x), bitorder="little").view("<i8")[0])


def parities(x: np.ndarray) -> np.ndarray:
    """64-bit words of parities: each shingle flips one bit, so that sets differ in at least as many shingles as bits."""
    words = min(_MOST, max(_LEAST, 1 << max(0, (len(x) - 1) // 16).bit_length()))
    odd = np.bincount((x & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray) -> np.ndarray:
    """Parities of half as many words (along the last axis)."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def _rows(width: int, similarity: tuple[int, int], common: np.ndarray):
    p, q = similarity

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = list(sets(*string_buffers(batch.column("text")), width))
            size = np.array([len(x) for x in every], np.int64)
            heads, bits = [], []
            names, prints = np.zeros(len(every), np.uint64), np.zeros(len(every), np.int64)
            for k, x in enumerate(every):
                late = np.isin(x, common, assume_unique=True)
                heads.append(np.concatenate((x[~late], x[late]))[: len(x) - -(-p * len(x) // q) + 1])
                bits.append(parities(x))
                names[k], prints[k] = _name(x), fingerprint(x)
            own = [pa.array(names.view(np.int64)), pa.array(size), pa.array(prints), _lists(heads), _lists(bits)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), *own], [*KEY, "c", "n", "fp", "head", "bits"])

    return each


def _again(marks: np.ndarray):
    """(c, n, t) of the shingles of heads whose mark is set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.column("head")
            t, owner = head.flatten().to_numpy(), head.value_parent_indices().to_numpy()
            some = marks[(t.view(np.uint64) % np.uint64(MARKS)).astype(np.int64)]
            of = pa.array(owner[some])
            yield pa.RecordBatch.from_arrays([batch.column("c").take(of), batch.column("n").take(of), pa.array(t[some])], ["c", "n", "t"])

    return each


def _chosen(width: int, marks: np.ndarray):
    """Names and whole sets of the texts whose mark is set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(marks[batch.column("mark").to_numpy()]))
            every = list(sets(*string_buffers(some.column("text")), width))
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_name(x) for x in every], np.uint64).view(np.int64)), _lists(every)], ["c", "all"])

    return each


def _close(similarity: tuple[int, int]):
    """The pairs that sizes and parities don't rule out."""
    p, q = similarity

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, o = (batch.column(k).to_numpy() for k in ("na", "nb"))
            keep = q * np.minimum(n, o) >= p * np.maximum(n, o)
            sides = [batch.column(k) for k in ("bitsa", "bitsb")]
            starts = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in sides]
            for i in np.flatnonzero(keep).tolist():
                x, y = (values[at[i] : at[i + 1]] for at, values in starts)
                x, y = folded(x) if len(x) > len(y) else x, folded(y) if len(y) > len(x) else y
                keep[i] = (p + q) * int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= (q - p) * int(n[i] + o[i])
            some = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b")], ["a", "b"])

    return each


class _Side:
    """One side of a comparison of blocks: names, sizes, groups and classes of sets, and their parities by number of words."""

    def __init__(self, rows: list[dict]):
        self.c, self.n, self.g = (np.array([r[k] for r in rows], np.int64) for k in "cng")
        self.low = np.array([r["low"] for r in rows], bool)
        by: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            by.setdefault(len(r["bits"]), []).append(k)
        self.bits = {w: (np.array(at), np.array([rows[k]["bits"] for k in at], np.int64)) for w, at in by.items()}

    def apart(self, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which sets, bits that differ) for all sets whose number of words is as large, or twice or half as large."""
        w = len(bits)
        for words, (at, own) in self.bits.items():
            if words == w:
                yield at, np.bitwise_count((own ^ bits).view(np.uint64)).sum(1, dtype=np.int64)
            elif words == 2 * w:
                yield at, np.bitwise_count((folded(own) ^ bits).view(np.uint64)).sum(1, dtype=np.int64)
            elif 2 * words == w:
                yield at, np.bitwise_count((own ^ folded(bits)).view(np.uint64)).sum(1, dtype=np.int64)


def _across(similarity: tuple[int, int]):
    """Pairs of different groups that sizes and parities don't rule out."""
    p, q = similarity

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, left, right in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "left", "right")), strict=True):
                if not left or not right:
                    continue
                side, found = _Side(right), []
                for r in left:
                    fits = (side.g != r["g"]) & ~(side.low & r["low"]) & (q * np.minimum(side.n, r["n"]) >= p * np.maximum(side.n, r["n"]))
                    if i == j:
                        fits &= side.c > r["c"]
                    if not fits.any():
                        continue
                    for at, apart in side.apart(np.array(r["bits"], np.int64)):
                        near = at[fits[at] & ((p + q) * apart <= (q - p) * (side.n[at] + r["n"]))]
                        found.append(np.stack((side.c[near], np.full(len(near), r["c"]))))
                if found:
                    both = np.concatenate(found, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(both.min(0)), pa.array(both.max(0))], ["a", "b"])

    return each


def _mark() -> Column:
    return F.pmod(F.col("k1"), F.lit(MARKS)).cast("int")


def _bitmap(marks: DataFrame) -> np.ndarray:
    """Which of the MARKS numbers are there: what comes to the driver is bounded, whatever the size of the input."""
    out = np.zeros(MARKS, bool)
    out[marks.distinct().toArrow().column(0).to_numpy()] = True
    return out


def _verified(pairs: DataFrame, sides: DataFrame, full: DataFrame, rows: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) of the pairs whose whole sets are similar: all their shingles are compared.

    Whole sets are made again, from one text for each set of a pair, so that those of other texts are never written. The
    bitmap of marks only spares others the work; what it lets through besides, the joins leave out.
    """
    p, q = similarity
    one, two = (sides.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in ("a", "b"))
    pairs = pairs.join(one, "a").join(two, "b").mapInArrow(_close(similarity), "a long, b long")
    pairs = settled(pairs.distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    least = full.groupBy("c").agg(F.min("k1").alias("k1")).join(asked, "c").select("k1")
    marks = _bitmap(least.select(_mark().alias("mark")))
    whole = rows.select(_mark().alias("mark"), "text").mapInArrow(_chosen(width, marks), "c long, all array<long>").dropDuplicates(["c"])
    whole = settled(whole.join(asked, "c", "left_semi"), "sets")
    one = whole.select(F.col("c").alias("a"), F.col("all").alias("x"))
    two = whole.select(F.col("c").alias("b"), F.col("all").alias("y"))
    same = F.size(F.array_intersect("x", "y")) * (p + q) >= p * (F.size("x") + F.size("y"))
    out = settled(pairs.join(one, "a").join(two, "b").where(same).select("a", "b"), "similar")
    drop(rows.sparkSession, pairs, whole)
    return out


def by_fingerprint(full: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of different sets within `radius` bits of each other, enough to connect all such pairs."""
    first = settled(full.groupBy("fp").agg(F.min("c").alias("low")), "fingerprints")
    near = fingerprint_links(first.select("fp"), radius, FINGERPRINTS)
    low = lambda k: first.select(F.col("fp").alias(k), F.col("low").alias(f"{k}0"))
    across = near.join(low("a"), "a").join(low("b"), "b").select(F.col("a0").alias("x"), F.col("b0").alias("y"))
    same = full.join(first, "fp").where("c <> low").select(F.col("c").alias("x"), F.col("low").alias("y"))
    both = across.unionByName(same)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs that aren't connected yet."""
    of = lambda k: label.select(F.col("node").alias(k), F.col("label").alias(f"{k}0"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("a0", "a") != F.coalesce("b0", "b")).select("a", "b")


def links(
    full: DataFrame,
    rows: DataFrame,
    width: int = 5,
    similarity: tuple[int, int] = SIMILARITY,
    bucket: int = BUCKET,
    block: int = BLOCK,
) -> DataFrame:
    """(a, b): links among the sets (c, n, fp, head, bits) of full, made of the texts in rows, that connect all similar pairs.

    First the pairs that fingerprints give are compared. Then, similar sets share a shingle of their heads, the first
    n - ceil(p n / q) + 1 in an order of all shingles; each such shingle makes a bucket. The least and the greatest of a
    bucket are compared, and the sets of a bucket of more than `bucket` with some leaders; then all pairs of a bucket
    that still aren't connected are, in blocks. So a large group of near copies is mostly done by its leaders. Buckets of
    the same sets are compared once, and in a bucket only sets of like sizes, by parities of a quarter of the words (but
    _LEAST): what they let through meets the others as single pairs. So little is shipped to each bucket.
    """
    p, q = similarity
    spark = rows.sparkSession
    sides = settled(full.select("c", "n", "bits").dropDuplicates(["c"]), "sides")
    similar = _verified(by_fingerprint(full), sides, full, rows, width, similarity)
    label = components(similar, "a", "b")
    tokens = full.select("c", F.explode("head").alias("t"))
    counted = tokens.groupBy("t").agg(F.count("*").alias("m"), F.min("c").alias("a"), F.max("c").alias("b"))
    buckets = settled(counted.where("a <> b"), "buckets")
    pairs = buckets.select("a", "b").distinct()
    many = buckets.where("m > 2").select("t")
    marks = _bitmap(many.select(_modulo("t").alias("mark")))
    if marks.any():
        some = full.select("c", "n", "head").mapInArrow(_again(marks), "c long, n long, t long")
        once = settled(some.distinct().join(many, "t", "left_semi"), "once")  # texts of one set are one from here on
        sizes = settled(once.groupBy("t").agg(F.count("*").alias("m"), F.min(_lead("c", "n")).alias("lead")).where("m > 1"), "leaders")
        alike = lambda x, y: q * F.least(x, y) >= p * F.greatest(x, y)
        tried = once.join(sizes.where(F.col("m") > bucket), "t").where((F.col("c") != F.col("lead.l")) & alike(F.col("n"), F.col("lead.o")))
        of = F.struct(F.xxhash64("lead.l").alias("h"), F.col("lead.l").alias("l"))
        tried = tried.groupBy("c").agg(F.slice(F.array_sort(F.collect_set(of)), 1, LEADERS).alias("ls"))
        tried = tried.select("c", F.explode("ls").alias("x")).select(F.least("c", "x.l").alias("a"), F.greatest("c", "x.l").alias("b"))
        pairs = pairs.unionByName(tried).distinct()
    more = _verified(_apart(pairs, label), sides, full, rows, width, similarity)
    similar = settled(similar.unionByName(more), "similar")
    if not marks.any():
        drop(spark, buckets, sides)
        return similar
    label = components(similar, "a", "b")
    grouped = once.join(label, once.c == label.node, "left").select("t", "c", "n", F.coalesce("label", "c").alias("g"))
    grouped = settled(grouped, "grouped")
    still = settled(_open(grouped, similarity), "open")
    k = F.ceil(F.col("m") / block).cast("int")
    rest = _by_size(grouped, similarity).join(still, ["t", "s"]).join(sides.select("c", _fewer(_fewer("bits")).alias("bits")), "c")
    rest = rest.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("c"), k).cast("int"))
    rest = rest.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rest = rest.select("t", "s", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", F.struct("c", "n", "g", "low", "bits").alias("row"))
    sides_of = lambda k, name: F.collect_list(F.when(F.col("own") == F.col(k), F.col("row"))).alias(name)
    rest = rest.groupBy("t", "s", "i", "j").agg(sides_of("i", "left"), sides_of("j", "right"))
    last = settled(rest.select("i", "j", "left", "right").mapInArrow(_across(similarity), "a long, b long").distinct(), "last")
    last = _verified(last, sides, full, rows, width, similarity)
    drop(spark, buckets, once, sizes, grouped, still, sides)
    return similar.unionByName(last)


def _fewer(bits: Column | str) -> Column:
    """What folded() makes of parities, half as many words; those of the least number stay as they are."""
    half = (F.size(bits) / 2).cast("int")
    fold = F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > _LEAST, fold).otherwise(F.col(bits) if isinstance(bits, str) else bits)


def _class(n: str, similarity: tuple[int, int]) -> Column:
    """Classes of sizes: those of similar sets are the same or follow each other, as a class is a little wider than need be."""
    p, q = similarity
    return F.floor(F.log(n) / math.log(q / p * (1 + 1e-9)))


def _by_size(grouped: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(t, s, c, n, g, low): each set of a bucket t with those of its own class s, and as a lower one with those of the next."""
    s = _class("n", similarity)
    both = F.array(F.struct(s.alias("s"), F.lit(False).alias("low")), F.struct((s + 1).alias("s"), F.lit(True).alias("low")))
    return grouped.select("t", "c", "n", "g", F.explode(both).alias("x")).select("t", "x.s", "c", "n", "g", "x.low")


def _open(grouped: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(t, s, m): buckets by class of size that hold pairs which aren't connected, one for all of the same m sets.

    A passage that some texts share makes a bucket of the same sets for each of its shingles; one has all their pairs.
    That sets are the same is told by their number and 128 bits of hashes.
    """
    sets = [F.bit_xor(F.xxhash64("c")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("second seed"), "c")).alias("x2")]
    found = [F.count("*").alias("m"), *sets, F.min("g").alias("g1"), F.max("g").alias("g2")]
    one = grouped.groupBy("t").agg(*found).where("g1 <> g2").groupBy("m", "x1", "x2").agg(F.min("t").alias("t"))
    sized = _by_size(grouped.join(one.select("t"), "t"), similarity)
    sized = sized.groupBy("t", "s").agg(*found, F.min("low").alias("low")).where("g1 <> g2 and not low")
    return sized.groupBy("s", "m", "x1", "x2").agg(F.min("t").alias("t")).select("t", "s", "m")


def _modulo(t: str) -> Column:
    """What _again takes of a shingle as an unsigned number: MARKS is a power of two."""
    return F.pmod(F.col(t), F.lit(MARKS)).cast("int")


def _lead(c: str, n: str) -> Column:
    return F.struct(F.xxhash64(c, "t").alias("h"), F.col(c).alias("l"), F.col(n).alias("o"))


def labelled(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = SIMILARITY, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(doc_id, k1, k2, label) for each row of docs; rows whose texts are linked over similar ones have one label.

    Texts of the same shingles are one set before any pairing, texts without words (null ones too) among them.
    Equality of shingles and of sets is by 64-bit hashes.
    """
    rows = text_or_empty(docs)
    rows = rows.select("doc_id", *row_keys(rows), "text")
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0).select("text").mapInArrow(_tokens(width), "t long")
    often = some.groupBy("t").agg(F.count("*").alias("m")).where(F.col("m") >= OFTEN).orderBy(F.desc("m"), "t").limit(COMMON).toArrow()
    common = np.sort(often.column("t").to_numpy().astype(np.int64).view(np.uint64))
    schema = "doc_id long, k1 long, k2 long, c long, n long, fp long, head array<long>, bits array<long>"
    full = settled(rows.mapInArrow(_rows(width, similarity, common), schema), "shingles")
    label = components(links(full, rows, width, similarity, bucket, block), "a", "b")
    own = full.select(*KEY, "c").join(label, F.col("c") == label.node, "left")
    own = settled(own.select(*KEY, F.coalesce("label", "c").alias("label")), "labels")
    drop(docs.sparkSession, full)
    return own


def keep_one(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, the one with the smallest doc_id.

    Links are the pairs of texts whose sets of shingles have at least that Jaccard similarity. Of rows with that doc_id
    one stays; a component all of whose doc_ids are null keeps one row too.
    """
    return one_each(docs, labelled(docs, width, similarity, bucket))

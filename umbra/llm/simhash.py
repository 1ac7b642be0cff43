"""SimHash near-duplicates: fingerprints of word shingles, paired by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import Words, blocks, prepared, row_keys, settled, string_buffers, text_or_empty
from umbra.llm.graph import components

#: Buckets of up to so many different fingerprints are compared within one row; larger ones go another way, just as exact.
BUCKET = 4096


#: A row by its id, and by k1 and k2, which are hashes of doc_id and text: rows that share them are the same.
KEY = ("doc_id", "k1", "k2")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2**(radius+1) - 1 bit masks such that any `radius` bits lie outside at least one of them.

    Bit i gets a non-zero vector m(i) of radius+1 bits; mask v holds the bits with <m(i), v> odd. The vectors of at
    most `radius` differing bits span a proper subspace, so some non-zero v is orthogonal to all of them: mask v then
    holds none of these bits, and both fingerprints agree under it.
    """
    top = (1 << (radius + 1)) - 1
    vectors = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(width: int):
    digest = xxhash.xxh64_intdigest

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            out = np.zeros(batch.num_rows, np.uint64)
            for lo, hi in blocks(offsets):
                base = offsets[lo]
                w = Words(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                raw = data[base : offsets[hi]].tobytes().lower()
                for k in range(hi - lo):
                    a, b = w.first[k], w.first[k + 1]
                    if a == b:
                        continue
                    sizes = w.ends[a:b] - w.starts[a:b]
                    text = b" ".join(raw[w.starts[a] : w.ends[b - 1]].split())
                    stops = np.cumsum(sizes + 1) - 1
                    begins = (stops - sizes).tolist()
                    n = max(1, b - a - width + 1)
                    stops = stops[width - 1 :].tolist() if b - a >= width else [len(text)]
                    h = np.array([digest(text[s:e], 42) for s, e in zip(begins[:n], stops, strict=True)], np.uint64)
                    ones = np.zeros(64, np.int64)
                    for at in range(0, n, 1 << 16):
                        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
                        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
                    out[lo + k] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
            keys = [batch.column(k) for k in KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(out.view(np.int64))], [*KEY, "fp"])

    return each


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, k1, k2, fp): 64-bit SimHash of every whole text, A-Z in lower case, over shingles of `width` words.

    Repeats count. Fewer words make one shingle; a text without words, or a null one, has fingerprint zero.
    """
    rows = text_or_empty(docs)
    keyed = rows.select("doc_id", *row_keys(rows), "text")
    return keyed.mapInArrow(_fingerprints(width), "doc_id long, k1 long, k2 long, fp long")


def _bucket_edges(radius: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for row in batch.column("fps").to_pylist():
                x = np.array(row, np.int64).view(np.uint64)
                left = np.arange(len(row))
                while len(left):  # a spanning forest holds a bucket's links: each fingerprint is reached once
                    found, left = [int(left[0])], left[1:]
                    while found and len(left):
                        i = found.pop()
                        near = np.bitwise_count(x[left] ^ x[i]) <= radius
                        for j in left[near].tolist():
                            found.append(j)
                            seen.add((max(row[i], row[j]), min(row[i], row[j])))
                        left = left[~near]
            both = np.array(sorted(seen), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return each


def _near(radius: int):
    """Every value within `radius` bits of a fingerprint."""
    singles = [1 << i for i in range(64)]
    reach = {0}
    for _ in range(radius):
        reach |= {x ^ s for x in reach for s in singles}
    flips = np.array(sorted(reach), np.uint64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in batch.column("fp").to_numpy(zero_copy_only=False):
                z = (flips ^ np.int64(fp).view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.full(len(z), fp, np.int64))], ["z", "fp"])

    return each


def links(fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links among the different fingerprints of column fp that connect all pairs within `radius` bits.

    Each pair within the radius shares a bucket of some covering table. A bucket of up to `bucket` fingerprints gives
    a spanning forest of its pairs. For the fingerprints of larger buckets, every value within radius/2 bits is made:
    those that share such a value are within the radius, and any two within the radius (an even one) share one; each is
    linked to the smallest that shares it. No pairs of a group are ever listed.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    masks = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(signed(m)).alias("m")) for v, m in enumerate(covering_masks(radius))])
    tables = fps.select("fp", F.explode(masks).alias("t")).select("fp", F.col("t.v").alias("v"), F.col("fp").bitwiseAND(F.col("t.m")).alias("key"))
    sizes = settled(tables.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    few = tables.join(sizes.where(F.col("n") <= bucket), ["v", "key"]).groupBy("v", "key").agg(F.collect_list("fp").alias("fps"))
    edges = few.select("fps").mapInArrow(_bucket_edges(radius), "a long, b long")
    if sizes.where(F.col("n") > bucket).isEmpty():
        return edges.distinct()
    hot = tables.join(sizes.where(F.col("n") > bucket).select("v", "key"), ["v", "key"]).select("fp").distinct()
    shared = hot.mapInArrow(_near(radius // 2), "z long, fp long")
    low = shared.groupBy("z").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    more = shared.join(low, "z").where("fp > low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return edges.unionByName(more).distinct()


def _parts(docs: DataFrame) -> int:
    """Parts for work that grows with the number of texts but not with their size: as many as there are shuffle parts."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def labelled(docs: DataFrame, width: int, radius: int, bucket: int) -> DataFrame:
    """(doc_id, k1, k2, fp, label) for each row of docs; rows of one component have one label, a fingerprint of theirs.

    Copies share a fingerprint and are grouped by it before any pairing, so a large group of copies is one candidate.
    """
    fps = settled(fingerprints(docs, width), "fingerprints")
    classes = settled(fps.select("fp").distinct().repartition(_parts(docs)), "classes")
    label = components(links(classes, radius, bucket), "a", "b")
    return fps.join(label, fps.fp == label.node, "left").select(*KEY, "fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) for each row of docs.

    Texts without words, null ones too, have fingerprint zero and are linked like any other. Rows of one doc_id are rows
    of their own, each with its fingerprint. A null doc_id stays null and doesn't name a component: one without any
    doc_id has none. Empty tables give empty results.
    """
    rows = labelled(docs, width, radius, bucket)
    least = settled(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")), "components")
    return rows.join(least, "label").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, the one with the smallest doc_id.

    Of rows with that doc_id one stays; a component all of whose doc_ids are null keeps one row too.
    """
    return one_each(docs, labelled(prepared(docs, "doc_id", "text"), width, radius, bucket))


def one_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with one row of each label of rows (doc_id, k1, k2, label), as keep_one has them."""
    times = rows.groupBy("label", *KEY).agg(F.count("*").alias("n"))
    first = times.groupBy("label").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), *KEY, "n")).alias("first"))
    kept = settled(first.select("first.k1", "first.k2", "first.n"), "kept")
    whole = docs.select(*row_keys(docs), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # Keys of a partition are far smaller than its texts: hashed, they spare sorting texts.
    of = lambda some: whole.join(some.select("k1", "k2").hint("shuffle_hash"), ["k1", "k2"], "left_semi")
    out, again = of(kept.where("n = 1")), kept.where("n > 1")
    if not again.isEmpty():  # only rows that are there more than once need their copies removed
        out = out.unionByName(of(again).dropDuplicates(["k1", "k2"]))
    return out.select("row.*")

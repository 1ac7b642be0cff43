"""Packing of documents into token sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import settled, text_or_empty
from umbra.llm.tokens import encoder, paths

#: Documents that are packed together, about; more fill sequences better, fewer pack faster and in less memory.
GROUP = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class BinTree:
    """A tournament tree over the room left in bins: the first bin with enough room is found in logarithmic time."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.size)

    def put(self, need: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin that has `need`; its room is then less by that."""
        most, i = self.most, 1
        while i < self.size:
            i *= 2
            if most[i] < need:
                i += 1
        had = most[i]
        found, most[i] = i - self.size, had - need
        while i > 1:
            i //= 2
            low, high = most[2 * i], most[2 * i + 1]
            most[i] = low if low > high else high
        return found, had


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each size; equal sizes keep their order. Bins are numbered from 0 without gaps."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = BinTree(len(sizes), room)
    for i in np.argsort(-sizes, kind="stable").tolist():
        b, had = tree.put(int(sizes[i]))
        bins[i], offsets[i] = b, room - had
    return bins, offsets


def _encoded(vocabulary: str, ranks: str | None, room: int, end_id: int, keep_ids: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(vocabulary, ranks), np.array([end_id], np.uint32)
        for batch in batches:
            totals, sums, kept = [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.concatenate((enc.ids(text), tail)).astype("<u4")
                totals.append(len(ids))
                sums.append([zlib.crc32(ids[at : at + room].tobytes()) for at in range(0, len(ids), room)])
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            arrays = [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(sums, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                arrays + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, ["doc_id", "total", "sums", "ids"][: 3 + keep_ids]
            )

    return each


def _packed(room: int, keep_ids: bool):
    def each(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.combine_chunks().sort_by([("total", "ascending"), ("doc_id", "ascending")])
        total = table.column("total").to_numpy()
        full, rest = total // room, total % room
        pieces = full + (rest > 0)
        owner = np.repeat(np.arange(len(total)), pieces)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.where(k < full[owner], room, rest[owner])
        short = np.flatnonzero(length < room)
        sequence, offset = np.arange(len(owner), dtype=np.int64), np.zeros(len(owner), np.int64)
        bins, offset[short] = first_fit_decreasing(length[short], room)
        sequence[short] = len(owner) + bins
        _, sequence = np.unique(sequence, return_inverse=True)
        out = {
            "doc_id": table.column("doc_id").take(pa.array(owner)),
            "start": k * room,
            "length": length,
            "ids_crc32": table.column("sums").combine_chunks().flatten(),
            "doc_tokens": total[owner],
            "sequence_id": (np.int64(group) << 40) + sequence,
            "offset": offset,
        }
        if keep_ids:
            flat = table.column("ids").combine_chunks().flatten()
            cuts = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(cuts), flat)
        return pa.table(out)

    return each


def pack(
    docs: DataFrame,
    room: int = 1024,
    end_id: int = 0,
    group: int = GROUP,
    vocabulary: str | None = None,
    ranks: str | None = None,
    keep_ids: bool = False,
    seed: int = 17,
) -> DataFrame:
    """The pieces of all documents, each at its place in a sequence of `room` tokens.

    A document is its ids and then end_id, cut every `room` ids: whole sequences, and one shorter piece at most. The
    documents are dealt into groups of about `group` by a hash of doc_id, row and seed, so no doc_id or source makes a
    large group, and the pieces of each group are packed on their own, longest first, into the first sequence with room.
    What encoding gives is written first, so that rows are numbered as they stand in files and a task that is run again
    deals them as before.
    Columns as in PIECES, and `ids` if keep_ids; other columns of docs, whatever their names, are left out. A very long
    text is encoded whole, in memory that grows with it. A null or empty text is its end_id alone; repeated rows and rows with a
    null doc_id are packed like others. An empty table gives no pieces.
    """
    vocabulary, ranks = paths(vocabulary, ranks)
    schema = "doc_id long, total long, sums array<long>" + ", ids array<int>" * keep_ids
    rows = settled(text_or_empty(docs).mapInArrow(_encoded(vocabulary, ranks, room, end_id, keep_ids), schema), "encoded")
    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(_packed(room, keep_ids), PIECES + ", ids array<int>" * keep_ids)

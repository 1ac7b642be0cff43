"""Shared pieces: the shared folder, materialised tables, Arrow batch handling and hashing of byte and word sequences."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: The tables written so far and not dropped, and the application that wrote each.
_SETTLED: list[str] = []
_WRITER: dict[str, str] = {}
#: Rows and bytes of an Arrow batch; texts may be very long, so the default of 10,000 rows isn't bounded enough.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="umbra-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        found = f"file://{_OWN[app]}"
    return found.rstrip("/")


#: Shuffle files of a finished write are of no further use; without this they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage is cut, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    _SETTLED.append(path)
    _WRITER[path] = spark.sparkContext.applicationId
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def _mine(spark: SparkSession) -> list[str]:
    return [path for path in _SETTLED if _WRITER[path] == spark.sparkContext.applicationId]


def settled_so_far(spark: SparkSession) -> set[str]:
    """The tables that this application has written: what drop_settled is to spare."""
    return set(_mine(spark))


def drop_settled(spark: SparkSession, spare: set[str] = frozenset()) -> None:
    """Deletes the tables written so far, but for some: for after all that reads them has been written."""
    drop(spark, *[path for path in _mine(spark) if path not in spare])


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes settled tables that nothing will read any more: what was made from them is settled itself."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        path = table if isinstance(table, str) else table.settled_at
        _SETTLED.remove(path)
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def prepared(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns (extra ones, whatever their names, never reach an operator), with bounded Arrow batches."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.select(*[df[n] for n in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(df: DataFrame) -> DataFrame:
    """doc_id and text of df; a null text counts as empty, and doc_id may be any whole number."""
    text = F.coalesce("text", F.lit("")).alias("text")
    return prepared(df, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text)


def digest(*columns: Column | str) -> list[Column]:
    """Two 64-bit hashes of the columns under different seeds, 128 bits together; a null differs from any value."""
    known = [c if isinstance(c, Column) else F.col(c) for c in columns]
    every = [x for c in known for x in (c, F.isnull(c))]
    return [F.xxhash64(*every), F.xxhash64(F.lit("second seed"), *every)]


def row_keys(df: DataFrame) -> list[Column]:
    """k1 and k2, which identify a row by its doc_id and text: rows that share them are the same."""
    k1, k2 = digest(F.coalesce(df["text"], F.lit("")), df["doc_id"].cast("long"))
    return [k1.alias("k1"), k2.alias("k2")]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls, not copied; offsets has one entry more than there are rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], (at - at[0]).astype(np.int64) if len(at) else np.zeros(1, np.int64)


def blocks(offsets: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `size` bytes (a longer row makes a run of its own), so that work stays in the CPU's caches."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BYTE_CODES = np.frombuffer(hashlib.shake_128(b"byte codes").digest(256 * 8), np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        back = pow(base, -1, 1 << 64)
        out = []
        for b in (base, back):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have[0], have[1]


def running(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i: with them, the hash of any stretch costs one subtraction and one product."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def stretch(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The hashes of the stretches [start, end): the same for the same values, wherever they stand."""
    return mixed((prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but letters and digits.
PUNCTUATION = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Words:
    """The words of a run of texts: byte places, 64-bit hashes, and the first word of each text.

    Words are [^\\x20\\x09-\\x0D]+, or what stands between other bytes that `between` names.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE):
        solid = ~between[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a text's border also ends a word
        before, after = np.empty_like(solid), np.empty_like(solid)
        before[:1], before[1:] = True, ~solid[:-1]
        after[-1:], after[:-1] = True, ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        prefix = running(BYTE_CODES[data], BYTE_BASE)
        self.hashes = stretch(prefix, self.starts, self.ends, BYTE_BASE)
        for i in np.flatnonzero(self.ends - self.starts > 512):  # such sums are only sound for short words
            word = data[self.starts[i] : self.ends[i]].tobytes()
            self.hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def whole_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the k-long windows that lie within one text; first: where each text begins, and the end."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    if not n.sum():
        return np.zeros(0, np.int64)
    return np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def safe_hashes(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte stretches; the long ones, for which running sums aren't sound, by a digest."""
    out = stretch(prefix, starts, ends, BYTE_BASE)
    for i in np.flatnonzero(ends - starts > 512):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def within(owners: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, earlier): how often each hash occurs in its owner's text, and whether it has occurred there before."""
    key = hashes ^ mixed(owners.astype(np.uint64) + np.uint64(1))
    _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return n[back], first[back] != np.arange(len(key))


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the stretches that begin at first."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]

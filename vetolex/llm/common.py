"""Helpers shared by the training-data operators: shared-folder cuts, global ranks, word hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_root

#: ASCII letters only; every other byte stays, so multi-byte characters are untouched.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The same as a Spark ``translate`` pair.
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the driver and all executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stash(df: DataFrame, name: str = "stash") -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    A lost executor then costs a re-read, never a re-computation, and a table that two later
    branches need is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text") -> F.Column:
    """The UTF-8 bytes of a text (null: empty)."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def text_key(column: str = "text") -> F.Column:
    """With doc_id, the identity of a row: rows that agree on both have equal results."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def row_key(doc_id: str = "doc_id", text: str = "text") -> F.Column:
    """doc_id (null: a dash) and a hash of the text as one string, for joins that nulls must survive."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.hex(text_key(text)))


def ranked(df: DataFrame, order: list[str], rank: str = "__rank") -> DataFrame:
    """Global 0-based rank by ``order`` without a single-task window.

    Range partitioning spreads even one hot leading key over the partitions (the later columns
    split it), each partition numbers its own rows, and the per-partition counts (as many rows
    as partitions) give the offsets."""
    local = (df.repartitionByRange(*order).sortWithinPartitions(*order)
             .withColumn("__pid", F.spark_partition_id())
             .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    local = stash(local, "ranked")
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (local.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
               .select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")))
    return (local.join(F.broadcast(offsets), "__pid")  # one row per partition
            .withColumn(rank, F.col("__off") + F.col("__at")).drop("__pid", "__at", "__off"))


def release() -> None:
    """Give freed memory back to the machine, where the C library can: a reused worker would keep its last task's peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bits of the filters that tasks hold to skip what has no partner: 2 MB whatever the tables' size.
FILTER_BITS = 1 << 24


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """Bitmap (FILTER_BITS bits, packed) of the low bits of the hashes in column ``h``.

    Built by aggregation: at most FILTER_BITS / 2**15 rows of 4 KB reach the driver, however many hashes there are."""
    slots = hashes.select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot")).distinct()
    rows = slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes whose bit is set."""
    slot = h & np.uint64(FILTER_BITS - 1)
    return np.flatnonzero((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)


def documents_named(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(row, text)`` of the documents named in column ``row`` of ``rows``, and a few more; equal rows stay repeated."""
    return documents_hashed(docs, rows.select(F.xxhash64("row").alias("h"))).select("row", "text")


def documents_hashed(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(row, h, text)`` of the documents whose row key has its hash in column ``h`` of ``hashes``, and a few more.

    A fixed-size filter of the hashes spares all other texts the shuffle of the join that follows."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(hashes))

    def pick(batches):
        for batch in batches:
            at = in_filter(bits.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(at)) for i in range(3)], ["row", "h", "text"])

    return (docs.select(row_key().alias("row"), F.xxhash64(row_key()).alias("h"), text_bytes().alias("text"))
            .mapInArrow(pick, "row string, h long, text binary"))


#: Upper case to lower case, every other ASCII byte that is no digit or letter to a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(raw: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all bytes outside ASCII."""
    return raw.translate(_PLAIN).split()


class WordHashes(dict):
    """word bytes -> 64-bit hash; remembers at most ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of word hashes spread over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each position (empty if there are fewer than k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0x100000001B3) + h[j:j + n]
    return mix64(out)


_BASE = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as texts have needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


def prefix_sums(raw: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """``q``, ``up`` such that ``(q[e] - q[s]) * up[s]`` is a hash of the bytes from s to e."""
    up, down = powers.upto(len(raw) + 1)
    q = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(raw, np.uint8)] * down[:-1], out=q[1:])
    return q, up

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries
    _trim = None

#: Largest row group of an intermediate table; a writing task holds one uncompressed.
GROUP_BYTES = 16 << 20

#: Most shuffled bytes that adaptive execution merges into one task of an operator.
TASK_BYTES = 16 << 20

#: Largest side, in bytes, that an operator may broadcast; beyond it sides are shuffled.
BROADCAST_BYTES = 48 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def space_words(raw: bytes) -> list[bytes]:
    """A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes."""
    return raw.translate(LOWER).split()


def alnum_words(raw: bytes) -> list[bytes]:
    """A-Z lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return raw.translate(ALNUM).split()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see.  Where the cluster names none, a session of a single
    process gets a folder of its own; others must be told one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    Written tables cut the lineage, so a lost executor costs the stage at hand
    and not the run.  ``drop()`` deletes them once the caller has consumed the
    operator's result; what no one drops goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/quillspark/{uuid.uuid4().hex}"
        self._n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches small enough for texts of any length, and tasks that read at most
    ``TASK_BYTES`` of merged shuffle partitions, or what the session says if that is less."""
    merged = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(merged)) > TASK_BYTES:
        spark.conf.set(merged, TASK_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def utf8(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def maybe_broadcast(df: DataFrame, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a written table only if its counted rows times ``width`` fit ``limit``."""
    return F.broadcast(df) if df.count() * width <= limit else df


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def released(run):
    """The batch function, after which its worker gives freed memory back to the system."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, kept for words seen before; emptied when it grows large."""

    LIMIT = 65_536

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence if shorter."""
    n = len(word_hashes)
    if not n:
        return np.empty(0, np.uint64)
    m = min(size, n)
    acc = np.full(n - m + 1, m, np.uint64)
    for j in range(m):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + word_hashes[j : n - m + 1 + j]
    return np.unique(mix64(acc))

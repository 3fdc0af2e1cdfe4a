"""Shared helpers of the training-data operators: text access, scratch tables, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace of every word definition here: bytes.split() and bytes.lower() use exactly this ASCII set.
SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
MAX_BATCH_ROWS, MAX_BATCH_BYTES = 500, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset: one machine shares all."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="evigraph-"))
    return base.rstrip("/")


_own: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evigraph/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables from written() that nothing reads any more."""
    for t in tables:
        hadoop = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        hadoop.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def join_hubs(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """big.join(small, key, how) where no key of big fills a task; small has few rows for each key, big is a written table.

    Keys with more than 1/10,000 of the rows (and 256) are hubs, 10,000 at most; their rows of small are broadcast, so
    big's rows stay where they are. All others are joined by a shuffle.
    """
    most = max(256, big.count() // 10_000)
    hubs = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most).select(key)
    found = hubs.collect()  # 10,000 at most
    if not found:
        return big.join(small, key, how)
    hubs = F.broadcast(big.sparkSession.createDataFrame(found, hubs.schema))
    hub_rows = F.broadcast(small.join(hubs, key, "left_semi"))
    rest = big.join(hubs, key, "left_anti").join(small.join(hubs, key, "left_anti"), key, how)
    return big.join(hubs, key, "left_semi").join(hub_rows, key, how).unionByName(rest)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and by bytes, so that a batch of very long texts still fits a worker.

    Frames are lazy, so the bounds stand for the session; a session's own smaller ones stay.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > MAX_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(MAX_BATCH_ROWS))
    bound = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")
    if not bound.isdigit() or int(bound) > MAX_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MAX_BATCH_BYTES))


def text_frame(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and the whole text as UTF-8 (null: empty); other columns of docs, whatever their names, stay out."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *more
    )


def held_out(remainder: int, modulus: int = 5, column: str = "doc_id") -> Column:
    """crc32 of the document's id as text has this remainder; a null id counts as empty text."""
    crc = F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(modulus)) == remainder


def row_numbers(n: int, start: int) -> np.ndarray:
    """Numbers of rows that no other partition gives; a repeated task gives the same ones."""
    return (TaskContext.get().partitionId() << 36) + np.arange(start, start + n, dtype=np.int64)


class WordHashes(dict):
    """64-bit hashes of words, remembered within bounds: map(hashes.__getitem__, words)."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_hashes: WordHashes | None = None


def word_hashes() -> WordHashes:
    """One cache for each Python worker."""
    global _hashes
    if _hashes is None:
        _hashes = WordHashes()
    return _hashes


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling polynomial hashes of all windows of n words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _ODD
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """The sorted distinct n-word shingles as 64-bit hashes; fewer words: the whole sequence as one; none: empty."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes().of(words), min(n, len(words))))


def batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


Batches = Iterator[pa.RecordBatch]

"""Helpers that several operators share: reading, shared tables, batches."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space and the controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Upper bound for the rows and bytes that go to Python at once.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a local session without it (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="waymark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/waymark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a Bloom filter: at least, at most, and for each value.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 16, 1 << 27, 16


def bloom_bits(value: bytes, bits: int) -> tuple[int, int]:
    """Two places in a Bloom filter."""
    h = int.from_bytes(hashlib.blake2b(value, digest_size=16).digest(), "big")
    return h % bits, (h >> 64) % bits


def _places(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(np.array([b for x in batch.column("value").to_pylist() for b in bloom_bits(x, bits)], np.int64))
            word, at = np.unique(places >> 5, return_index=True)
            marks = np.bitwise_or.reduceat(np.int64(1) << (places & 31), at) if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(marks)], ["word", "bits"])

    return run


def bloom(values: DataFrame) -> np.ndarray:
    """Bytes of a Bloom filter of a column of binary values; its size follows their number, up to MOST_BITS.

    It sifts texts before a shuffle; the join behind it must be exact, so a full filter costs shuffle only.
    """
    values = values.toDF("value")
    n, bits = values.count(), LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * n):
        bits *= 2
    filled = values.mapInArrow(_places(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # MOST_BITS / 32 rows at most
    words = np.zeros(bits >> 5, "<u4")
    words[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    return words.view(np.uint8)


def in_bloom(sieve: np.ndarray, value: bytes) -> bool:
    return all(sieve[b >> 3] >> (b & 7) & 1 for b in bloom_bits(value, 8 * len(sieve)))


def _sift(sieve: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("sift").to_pylist()
            yield batch.filter(pa.array([x is not None and in_bloom(sieve, x) for x in ids], pa.bool_())).drop_columns(["sift"])

    return run


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs joined with ids (id_col and others). Only rows that a Bloom filter of the ids lets pass are shuffled."""
    as_bytes = F.col(id_col).cast("string").cast("binary")
    sieve = bloom(ids.select(as_bytes))
    near = docs.withColumn("sift", as_bytes).mapInArrow(_sift(sieve), docs.schema)
    return near.join(ids.hint("merge"), id_col)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds about `limit` bytes (a longer row stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if len(sizes) > start:
            yield batch.slice(start)


def give_back() -> None:
    """Returns what a task no longer uses: a Python worker lives on for the next tasks, beside the heap of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)

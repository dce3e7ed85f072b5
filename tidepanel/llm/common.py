"""Helpers the corpus operators share: reading tables, written steps, Arrow columns of a batch."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import configure, scratch_path

#: Arrow batches to Python are cut by rows and, where Spark knows the setting, by bytes: very long texts stay few to a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 3 << 20


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """A step written as Parquet in the shared folder and read back: later jobs start from the files, whoever is lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run: Callable, *stores: Callable) -> Callable:
    """A function over batches that leaves nothing behind: a worker lives on idle beside the tasks of later stages.

    Clears the cached `stores`, and gives what Arrow and the allocator hold back to the system.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for store in stores:
                store.cache_clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return clean


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def crc_mod(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


#: Bits of a set that tells scans which rows may be wanted: 8 MB, whatever the number of rows.
BITS = 1 << 26


def bit_set(hashes: DataFrame, column: str) -> Broadcast:
    """The hashes as a bit set of fixed size, held by every worker. A crowded set lets more through; a join must remove false hits."""
    place = F.pmod(column, F.lit(BITS))
    parts = hashes.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits"))
    bits = np.zeros(BITS >> 3, np.uint8)
    for r in parts.collect():  # 4 KB for each of BITS / 32768 parts at most
        bits[r["part"] << 12:(r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def maybe_in(held: Broadcast, batch: pa.RecordBatch, place: str) -> pa.RecordBatch:
    """The rows of a batch whose place (a hash modulo BITS) is in the set."""
    at = batch.column(place).to_numpy()
    return batch.filter(pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def join_classes(rows: DataFrame, classes: DataFrame, key: list[str], size: str) -> DataFrame:
    """rows joined with the class of their key; `size` of a class is the number of its rows, and goes.

    Both should be read from files. A class of more than a thousandth of the rows would meet in one task. There are at most a thousand such classes,
    whatever the input, so they are broadcast; all others are joined by shuffle.
    """
    total = rows.count()
    large = F.col(size) * 1000 > total
    hot = F.broadcast(classes.where(large).drop(size))
    others = rows.join(F.broadcast(classes.where(large).select(*key)), key, "left_anti")
    return rows.join(hot, key).unionByName(others.join(classes.where(~large).drop(size), key))

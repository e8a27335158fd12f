"""Helpers shared by the corpus operators: staged tables, guarded joins, batched text arrays."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many narrow rows, or ids alone, may be broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_IDS = 50_000, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on this machine may it be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpus-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(context.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually short: broadcast behind a row count, by shuffle beyond `most` rows."""
    rows = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if rows <= most else small, on, how)


def only(big: DataFrame, ids: DataFrame, on: str, rows: int | None = None) -> DataFrame:
    """The rows of big whose id is among ids (one column of longs): 8 MB at most are broadcast, more are shuffled."""
    return join_small(big, ids, on, "left_semi", rows, BROADCAST_IDS)


@functools.cache
def lean() -> None:
    """Have this Python worker give freed arrays back to the system at once. Workers live on between tasks, and would keep what the largest of them took."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # of glibc
    if mallopt:
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: larger ones are mapped by themselves
        mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD


def sliced(batches, rows: int = 256):
    """Arrow batches cut to few rows, so that only that many texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def utf8_batch(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column (null: empty) as one byte array and n + 1 offsets, without copying row by row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift, multiply), on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def sorted_runs(keys: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))

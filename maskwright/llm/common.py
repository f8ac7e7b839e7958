"""Scratch tables in the shared folder, and small helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[object, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder named in spark.checkpoint.dir.

    Only where that setting is missing on a local master (tests on one machine) a temporary folder is set; on a cluster its lack is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/maskwright/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, own: bool = True) -> DataFrame:
    """Writes df below the shared folder and reads it back: this cuts the lineage, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if not own:
        _SCRATCH.pop()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files of finished steps, and the driver's memory of their plans, go when its garbage is collected; between the steps of a long job that is asked for."""
    gc.collect()
    tidy()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no DataFrame needs any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


def scratch_since():
    """A function that deletes the scratch tables made from now on. Only call it when no DataFrame that reads them is still needed."""
    start = len(_SCRATCH)

    def delete() -> None:
        mine, _SCRATCH[start:] = _SCRATCH[start:], []
        for spark, path in mine:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    return delete


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_bytes(docs: DataFrame, name: str = "text") -> tuple[int, int]:
    """Rows of docs and UTF-8 bytes of its text: block counts are set in proportion."""
    n, b = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    return n, b


def held_out(name: str = "doc_id") -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit integer hash, elementwise; uint64 in and out."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def tidy() -> None:
    """Gives freed memory of this worker process back to the system: idle workers share an executor's memory with busy ones."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batches, column: str = "text", size: int = 4 << 20):
    """Splits Arrow batches into slices of about `size` bytes of text (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to
    tidy()

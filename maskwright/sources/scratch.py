"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset on a local master (one machine: tests), a temporary folder is set; on a cluster its lack is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared folder and read back: a lost executor costs no recomputation, and what runs once (sampled bounds, numbers of rows) stays as it was.

    The table goes with release(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/maskwright/{name}-{uuid.uuid4().hex[:12]}"
    _MADE[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no DataFrame needs any more."""
    for t in tables:
        if (spark := _MADE.pop(t.written_at, None)) is not None:
            _delete(spark, t.written_at)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_MADE.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended
            return

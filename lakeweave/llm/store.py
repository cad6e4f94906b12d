"""Tables that cut lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where it is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="lakeweave-")
    return _local[app]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it again.

    Lineage ends there, so a lost executor costs a re-read instead of a recomputation, and non-deterministic
    columns get one value for good.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/lakeweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeweave_path = path
    return out


def read_all(frames: list[DataFrame]) -> DataFrame:
    """What several calls of keep() wrote, of one schema, as one scan."""
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*(f._lakeweave_path for f in frames))


def drop(df: DataFrame) -> None:
    """Delete what keep() wrote; the caller no longer reads it."""
    path = getattr(df, "_lakeweave_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nobody holds any more (else it waits for the driver's next collection)."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)  # a thread of its own tells the JVM what Python has dropped
        spark._jvm.System.gc()


def broadcast_below(df: DataFrame, rows: int, limit: int):
    """df with a broadcast hint if its counted rows stay within the limit; else df as it is, to be shuffled."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= limit else df

"""Cutting lineage, and choosing how to join by measured size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode, where it is unset, a folder of our own that goes with the process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="srcgraph-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(named or own)
    return named or sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder, so that iteration doesn't grow plans and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder by column: for wide rows that are read many times, each time for a few of their columns. Order isn't kept."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python a few MB at once from here on, however large a partition is."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def wide(spark: SparkSession) -> int:
    """Partitions of source: parsing is the work, so at least two for each core, however small the text."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sized(df: DataFrame, width: int) -> DataFrame:
    """``df`` to be broadcast if its rows, of about ``width`` bytes, take at most ``BROADCAST_BYTES``; counts them."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the current one of ``path``: one appended row, so that until it is there the one before counts."""
    spark.createDataFrame([(time.time_ns(), version)], "at long, version string").coalesce(1).write.mode("append").parquet(f"{path}/versions")


def published(spark: SparkSession, path: str) -> list[str]:
    """All versions that were ever published, the latest first."""
    try:
        rows = spark.read.schema("at long, version string").parquet(f"{path}/versions").orderBy(F.desc("at"), F.desc("version")).collect()
    except AnalysisException:
        return []
    return [r.version for r in rows]


def current(spark: SparkSession, path: str) -> str | None:
    """The version that was published last, or None."""
    return next(iter(published(spark, path)), None)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Hadoop knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

"""The cache of extracted files: Parquet, reused for files that haven't changed."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph import runtime, schemas
from srcgraph.operators.extract import extract


def unchanged(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Keys of files whose time and size are as cached, or whose bytes have the same hash."""
    c = cached.filter("error IS NULL").select("file_key", F.col("last_modified").alias("_t"), F.col("file_size").alias("_s"), F.col("content_hash").alias("_h"))
    same = (F.col("last_modified") == F.col("_t")) & (F.col("file_size") == F.col("_s")) | (F.col("content_hash") == F.col("_h"))
    return files.join(c, "file_key").filter(same).select("file_key")


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """What is cached, or None; a half-written version is never read."""
    version = runtime.current(spark, path)
    return spark.read.schema(schemas.struct(schemas.EXTRACTED)).parquet(f"{path}/{version}") if version else None


def write_cache(extracted: DataFrame, path: str) -> None:
    """Write a new version; the one before stays for its readers, older ones go."""
    spark, version = extracted.sparkSession, f"v-{uuid.uuid4().hex}"
    extracted.write.parquet(f"{path}/{version}")
    runtime.publish(spark, path, version)
    for old in runtime.published(spark, path)[2:]:
        runtime.remove(spark, f"{path}/{old}")


def extract_changed(files: DataFrame, cached: DataFrame | None, compat: bool = False, only: Iterable[str] | None = None) -> DataFrame:
    """The extraction of ``files``, taking from the cache what hasn't changed; files that are gone drop out. ``only``: the relations that are wanted, which ``cached`` must have."""
    if cached is None:
        return extract(files, compat=compat, only=only)
    same = unchanged(files, cached)
    new = extract(files.join(same, "file_key", "left_anti").repartition(runtime.wide(files.sparkSession), "file_key"), compat=compat, only=only)
    return cached.join(same, "file_key", "left_semi").select(*new.columns).unionByName(new)

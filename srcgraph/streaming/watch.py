"""A stream of source-file rows that keeps a graph store up to date.

The reference semantics are incremental, not streaming; this is the same incremental push, batch by batch: each
micro-batch of (file_key, source, ...) rows is extracted and pushed as a targeted update that never prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from srcgraph.operators import propgraph
from srcgraph.operators.store import GraphStore
from srcgraph.plans.engine import analyze_sources


def latest(batch: DataFrame) -> DataFrame:
    """Of several rows for a file the latest."""
    w = Window.partitionBy("file_key").orderBy(F.col("last_modified").desc_nulls_last(), "content_hash")
    return batch.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def keep_store(files: DataFrame, store: GraphStore, app: str) -> DataStreamWriter:
    """A writer to be started; give it a checkpoint location to make pushes exactly-once in effect (a repeated batch pushes the same rows)."""

    def push(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.push(*propgraph.project(analyze_sources(batch.sparkSession, latest(batch)), app), app, full=False)

    return files.writeStream.foreachBatch(push)

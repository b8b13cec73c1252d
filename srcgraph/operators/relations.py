"""Relations of extracted files. Each is an ``inline`` of one column, so others are pruned before they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def relation(extracted: DataFrame, name: str) -> DataFrame:
    return extracted.select("file_key", F.inline(name))


def modules(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error IS NULL").select("file_key", "module_name", "dotted", "content_hash", "last_modified", "file_size")


def parse_errors(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error IS NOT NULL").select("file_key", "error")


def last_definition(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows equal in ``keys`` the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def callables_by_signature(callables: DataFrame) -> DataFrame:
    return last_definition(callables, ["signature"], ["file_key", "ord"])


def declared_signatures(callables: DataFrame, classes: DataFrame) -> DataFrame:
    return callables.select("signature").union(classes.select("signature")).distinct()


def signature_to_file(callables: DataFrame, classes: DataFrame) -> DataFrame:
    """(signature, file_key); of several files the last counts."""
    both = callables.select("signature", "file_key").union(classes.select("signature", "file_key"))
    return both.groupBy("signature").agg(F.max("file_key").alias("file_key"))


def module_inventory(callables: DataFrame, classes: DataFrame) -> DataFrame:
    """How many callables and classes each file declares."""
    ones = callables.select("file_key", F.lit(1).alias("a"), F.lit(0).alias("b")).union(classes.select("file_key", F.lit(0), F.lit(1)))
    return ones.groupBy("file_key").agg(F.sum("a").cast("long").alias("n_callables"), F.sum("b").cast("long").alias("n_classes"))

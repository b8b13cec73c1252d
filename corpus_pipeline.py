"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of documents. Nulls,
empty and very long texts, repeated rows, empty tables and extra columns are handled as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcgraph.llm import common as C
from srcgraph.llm import decontaminate, mixing, near_dedup, quality, tokens

#: Rows and bytes that go to Python at once: stages share executors, whose workers live on from one to the next.
BATCH = (2000, 4 << 20)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among ``docs``, doesn't reject."""
    C.batches(spark, *BATCH)
    return quality.drop_low_quality(docs, C.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all that have none."""
    C.batches(spark, *BATCH)
    return near_dedup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark`` within its error budget."""
    C.batches(spark, *BATCH)
    return decontaminate.drop_leaks(docs, C.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose first token is in a block that its source was given."""
    return mixing.Mix(docs).keep(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in Simple-8b words."""
    C.batches(spark, *BATCH)
    return tokens.token_ids(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]
#: SQL can express neither the classifier, nor the sketches, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents`` of ``sf_dir``."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = C.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

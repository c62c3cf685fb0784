"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing and sharding, each over all that the last stage kept.

Every stage takes null columns, empty and very long texts, ties, repeated rows, empty tables and extra columns as its operator does.
Null and empty texts score below the threshold where toxic labels are the fewer, are near-duplicates of each other, hold no
benchmark item and count 0 words. Repeated rows are one after the second stage, and may be up to three again after the mix. An empty
table stays empty. Extra columns are kept until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.op3_simhash import deduplicated
from colloquy.llm.op6_toxicity import toxicity_model, without_toxic
from colloquy.llm.op7_decontamination import decontaminated
from colloquy.llm.op8_mixing import mix_documents
from colloquy.llm.op10_sharding import sharded
from colloquy.staging import new_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The model learns from labelled rows of the stage's own input."""
    return without_toxic(docs, toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in a store of shards; gives each row's doc_id and shard."""
    return sharded(docs, new_path(spark, "shards")).placed()


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained classifier and a SimHash closure are not expressible in SQL; tests compare the other stages with brute-force versions, and
#: the classifier with its features added up one by one and with held-out labels.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

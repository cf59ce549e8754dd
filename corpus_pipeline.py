"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Models (language, toxicity) are learned from the input of their own stage and from labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, language, mixing, ngram_join, toxicity
from quern.llm.common import stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that holds enough of them, go."""
    return language.keep_identified(docs, language.model_of(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents flagged as toxic go."""
    return toxicity.remove(docs, toxicity.chain_of(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "toxic")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return ngram_join.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("ngram_join", near_duplicates),
    ("decontaminate", decontaminated),
    ("mixing", mixed),
]

#: SQL cannot express the stages (trained models, similarity components); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = stash(stage(spark, docs, sf_dir), name)
    return docs

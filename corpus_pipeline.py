"""From raw documents to an encoded mixture: the stages, in order, and run(), which applies them all.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns a DataFrame; all but
the last return the columns of documents. Stages that filter hand rows on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import byte_bpe, language_id, mixing, near_dup, quality
from lodeweave.llm._common import dropped, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the network is sure of go."""
    return language_id.known_language(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards labelled good text leaves out go."""
    return quality.select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become the words that the mix takes of them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the texts decoded from them."""
    return byte_bpe.digests(docs)


STAGES = [("language", identified), ("quality", good), ("near_duplicates", unlike), ("mixing", mixed), ("encoding", encoded)]

#: SQL cannot express the trained stages; tests/llm holds the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        now = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            dropped(docs)
        docs = now
    return docs

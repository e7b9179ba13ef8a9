"""All queries of the library proper, by operator, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeweave.plans import evaluate, files, learning, masking, prepare, report, runs

_MODULES = (report, prepare, evaluate, masking, learning, runs, files)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.QUERIES["g03_embedder_leaderboard"][0](spark, sf_dir)


def queries() -> dict:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}

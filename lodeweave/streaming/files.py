"""File streams: lazy filter and map, and resume through the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_once(stream: DataFrame, each: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Applies `each` to what the stream has not yet delivered, appends it as Parquet and stops; a later call goes on from there."""
    query = each(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()

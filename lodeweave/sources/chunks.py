"""A writer in chunks that goes on where an earlier run stopped.

A chunk is published by renaming its folder, so it is there whole or not at all; what is there is never written again.
Chunks live below a folder named by a hash of the configuration that made them: another configuration begins anew and
never takes chunks of this one for its own.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.sources.readers import _hadoop


def config_folder(path: str, config: dict) -> str:
    """path/<16 hex digits of the SHA-256 of the configuration as JSON with sorted keys>."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return f"{path.rstrip('/')}/{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def chunks_done(spark: SparkSession, folder: str) -> set[int]:
    """Numbers of the chunks that are there; only names are listed."""
    fs, p = _hadoop(spark, folder)
    if not fs.exists(p):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {int(n.removeprefix("chunk=")) for n in names if n.startswith("chunk=")}


def write_chunks(df: DataFrame, path: str, config: dict, chunk: Column, chunks: int, wave: int = 16) -> str:
    """Writes the rows of df in chunks 0 to chunks - 1 by `chunk` (int) and returns their folder; chunks already there are skipped.

    `chunk` must depend on the row alone (a range of ids, a hash), so that each run deals alike. A wave of chunks is one
    job: rows are dealt to their chunks, staged aside and then published one by one; a run that stops loses one wave at
    most. Chunks without rows are published empty. What earlier runs left staged is removed. Rows with a null or another
    number are an error.
    """
    spark = df.sparkSession
    folder = config_folder(path, config)
    fs, at = _hadoop(spark, folder)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(at)
    fs.delete(new(f"{folder}/_staged"), True)
    with_chunk = df.withColumn("__chunk", chunk.cast("int"))
    outside = with_chunk.where(F.col("__chunk").isNull() | ~F.col("__chunk").between(0, chunks - 1))
    if not outside.isEmpty():
        raise ValueError(f"rows outside chunks 0 to {chunks - 1}")
    left = sorted(set(range(chunks)) - chunks_done(spark, folder))
    for k in range(0, len(left), wave):
        some = left[k : k + wave]
        staged = f"{folder}/_staged/{uuid.uuid4().hex}"
        rows = with_chunk.where(F.col("__chunk").isin(some))
        rows.repartition("__chunk", F.pmod(F.xxhash64(*df.columns), F.lit(8)) if df.columns else F.lit(0)).write.partitionBy("__chunk").parquet(staged)
        for c in some:
            made = new(f"{staged}/__chunk={c}")
            if not fs.exists(made):
                fs.mkdirs(made)
                fs.create(new(f"{staged}/__chunk={c}/_EMPTY")).close()
            if not fs.rename(made, new(f"{folder}/chunk={c}")):
                raise OSError(f"chunk {c} could not be published")
        fs.delete(new(staged), True)
    fs.delete(new(f"{folder}/_staged"), True)
    return folder


def read_chunks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all chunks there, with their chunk."""
    return spark.read.schema(f"{schema}, chunk int").option("basePath", folder).parquet(f"{folder}/chunk=*") if chunks_done(spark, folder) else spark.createDataFrame([], f"{schema}, chunk int")

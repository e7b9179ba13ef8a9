"""Cutting lineage in loops and scratch folders, where the driver and all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder set before; a local folder only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if before.isDefined():
            found = before.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = f"file://{tempfile.gettempdir()}/checkpoints"
        else:
            raise ValueError("name a folder that all nodes share in spark.checkpoint.dir")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lodeweave-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed and checkpointed in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()

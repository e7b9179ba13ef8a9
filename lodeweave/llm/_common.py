"""Shared helpers: the shared folder of the cluster, written intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where the session names none a local folder is taken if driver and executors are one process (tests); on a cluster
    that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            found = set_before.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = f"file://{tempfile.gettempdir()}/checkpoints"
        else:
            raise ValueError("name a folder that all nodes share in spark.checkpoint.dir")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written as Parquet into the shared folder and read again: survives lost executors, cuts lineage.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodeweave-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `written` made and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[0], begin[0] + 1, ... of runs of the given sizes, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its own columns of these names (in any case) put aside under others, and what brings docs' columns back."""
    kept = {c: f"__own_{c}" if c.lower() in names else c for c in docs.columns}
    renamed = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in kept.items()])
    return renamed, lambda df: df.select(*[F.col(f"`{k}`").alias(c) for c, k in kept.items()])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the graph of `edges`: rows (node, component), component = the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each a group-by on nodes whose
    neighbourhoods are only reduced to a minimum and joined back, never gathered; a written table cuts the lineage
    after each round. Rounds grow with the logarithm of the number of nodes, and end when one changes no edge; without
    edges there is none. Nodes without edges give no row; edges with a null end or two equal ends are ignored.
    """

    def edges_and_mark(some: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        out = written(some.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        return out, seen.get

    now, last = edges_and_mark(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    while last.get("n"):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(joined.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        after, state = edges_and_mark(small)
        dropped(now)
        now = after
        if state == last:
            break
        last = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

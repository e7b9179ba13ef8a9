"""Writers; all commit by Spark's protocol, so a reader sees whole tables only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.corpus import row_slices
from lodeweave.sources.readers import _hadoop, read_table


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, CSV or TSV by suffix; other suffixes are an error."""
    if path.endswith((".parquet", ".pq")):
        df.write.parquet(path)
    elif path.endswith((".csv", ".tsv")):
        df.write.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    else:
        raise ValueError(f"unknown suffix: {path}")


def write_shards(df: DataFrame, path: str, order: str, shards: int) -> None:
    """n equal contiguous slices in an order, each a folder shard=i."""
    sliced = row_slices(df, order, shards)
    sliced.repartition(shards, "shard").sortWithinPartitions("shard", order).write.partitionBy("shard").parquet(path)


def vocabulary_json(vocab: DataFrame) -> DataFrame:
    """One row: the vocabulary as a JSON object in order of id."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("id", "token"))), lambda x: F.struct(x["token"].alias("key"), x["id"].alias("value")))
    return vocab.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def write_by_metric(df: DataFrame, path: str, metric: str) -> None:
    """One folder of CSV per metric."""
    df.write.partitionBy(metric).option("header", True).csv(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside and renamed; one that is there is replaced."""
    fs, target = _hadoop(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(text.encode())
    out.close()
    fs.delete(target, False)
    if not fs.rename(new, target):
        raise OSError(f"{path} could not be written")


def write_metadata(df: DataFrame, path: str, config: dict, split: str | None = None, overlap: DataFrame | None = None) -> dict:
    """A JSON file beside a data set: its configuration, columns, rows (by split), and overlaps of splits (few rows). Returns it."""
    import pyspark

    facts = {"config": config, "columns": {f.name: f.dataType.simpleString() for f in df.schema}, "spark": pyspark.__version__}
    if split:
        facts["rows_by_split"] = {str(r[split]): r["n"] for r in df.groupBy(split).agg(F.count("*").alias("n")).collect()}
        facts["rows"] = sum(facts["rows_by_split"].values())
    else:
        facts["rows"] = df.count()
    if overlap is not None:
        facts["overlap"] = [r.asDict() for r in overlap.collect()]
    write_text(df.sparkSession, path, json.dumps(facts, indent=2, sort_keys=True, ensure_ascii=False))
    return facts


def replace_table(df: DataFrame, path: str) -> None:
    """df in place of the table at path, from which df may be read: written beside, then renamed; readers see the old or the new."""
    spark = df.sparkSession
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    beside, before = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix in ("csv", "tsv"):
        df.write.option("header", True).option("sep", "\t" if suffix == "tsv" else ",").csv(beside)
    else:
        df.write.parquet(beside)
    fs, target = _hadoop(spark, path)
    if fs.exists(target) and not fs.rename(target, new(before)):
        raise OSError(f"{path} could not be replaced")
    if not fs.rename(new(beside), target):
        raise OSError(f"{path} could not be replaced")
    fs.delete(new(before), True)
    spark.catalog.refreshByPath(path)


def append_results(spark: SparkSession, path: str, rows: DataFrame, key: str = "id") -> None:
    """Rows of results, numbered on behind the largest whole-number id of the table at path (from 1 on), which they join; columns that either lacks are null."""
    fs, target = _hadoop(spark, path)
    if fs.exists(target):
        old = read_table(spark, path)
        last = old.agg(F.coalesce(F.max(F.col(key).try_cast("long")), F.lit(0)).alias("last"))
    else:
        old, last = None, spark.sql("SELECT 0L AS last")
    from pyspark.sql import Window

    # what is appended are results of one run: few rows
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    new = rows.drop(key).withColumn("__place", place).join(F.broadcast(last)).withColumn(key, (F.col("last") + F.col("__place")).cast("long")).drop("__place", "last")
    whole = new if old is None else old.withColumn(key, F.col(key).cast("long")).unionByName(new, allowMissingColumns=True)
    replace_table(whole.select(key, *[c for c in whole.columns if c != key]), path)


def delete_results(spark: SparkSession, path: str, which: Column) -> int:
    """Rewrites the table at path without the rows for which `which` holds; returns how many these were."""
    old = read_table(spark, path)
    n = old.where(which).count()
    if n:
        replace_table(old.where(~F.coalesce(which, F.lit(False))), path)
    return n


def write_submission(df: DataFrame, path: str, key: str, value: str, expected: DataFrame) -> None:
    """Predictions as CSV (key, value), one for each key of expected; missing, further or repeated keys and values that are no finite numbers are errors, and then nothing is written."""
    v = F.col(value).cast("double")
    n = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.coalesce(F.sum((~F.coalesce(F.abs(v) < float("inf"), F.lit(False))).cast("long")), F.lit(0)).alias("bad")).first()
    wanted = expected.select(key).distinct()
    missing, further = wanted.join(df, key, "left_anti").count(), df.join(wanted, key, "left_anti").count()
    faults = {"bad values": n["bad"], "repeated keys": n["n"] - n["keys"], "missing keys": missing, "further keys": further}
    if any(faults.values()):
        raise ValueError(", ".join(f"{c} {k}" for k, c in faults.items() if c))
    df.select(key, v.alias(value)).write.option("header", True).csv(path)


def write_by_keys(df: DataFrame, path: str, keys: list[str]) -> None:
    """CSV in a folder for each combination of keys (dataset=a/embedder=b); only folders that df has rows for are replaced."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(*keys).csv(path)
    spark.catalog.refreshByPath(path)


def write_symbols(symbols: DataFrame, path: str, mode: str) -> None:
    """(token, n) as lines of tokens (`symbols`), in the order of text, or as a table of counts (`symbol_counts`), largest first; other modes are an error."""
    if mode == "symbols":
        symbols.orderBy("token").select("token").write.text(path)
    elif mode == "symbol_counts":
        symbols.orderBy(F.desc("n"), "token").select("token", "n").write.option("sep", "\t").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown mode: {mode}")


def markdown_table(df: DataFrame, order: str) -> str:
    """A report's rows as a Markdown table; numbers with four digits, nulls and NaN as dashes. Reports are few rows: they come to the driver."""

    def shown(x) -> str:
        if x is None or x != x:
            return "—"
        return f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")

    rows = [[shown(x) for x in r] for r in df.orderBy(order).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])

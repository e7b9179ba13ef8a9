"""Readers: files by suffix, split files, line lists, counts, vocabularies, run documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.hashing import draw
from lodeweave.functions.text import stripped

#: Names under which splits are stored.
SPLIT_ALIASES = {"train": ("train",), "valid": ("valid", "validation", "val"), "test": ("test",)}


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, JSON lines, CSV or TSV by suffix, compressed or not; other suffixes are an error."""
    name = path.lower().removesuffix(".gz")
    reader = spark.read.schema(schema) if schema else spark.read
    if name.endswith((".parquet", ".pq")):
        return reader.parquet(path)
    if name.endswith((".jsonl", ".json")):
        return reader.json(path)
    if name.endswith((".csv", ".tsv")):
        return reader.option("header", True).option("sep", "\t" if name.endswith(".tsv") else ",").csv(path)
    raise ValueError(f"unknown suffix: {path}")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def split_files(spark: SparkSession, root: str, split: str) -> list[str]:
    """Parquet files of a split under any of its names, `name.parquet` or `name-*.parquet`: flat ones, else in subfolders."""
    fs, _ = _hadoop(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for depth in ("", "*/"):
        found = set()
        for name in SPLIT_ALIASES.get(split, (split,)):
            for pattern in (f"{name}.parquet", f"{name}-*.parquet"):
                found |= {s.getPath().toString() for s in fs.globStatus(path(f"{root}/{depth}{pattern}")) or []}
        if found:
            return sorted(found)
    return []


def available_splits(spark: SparkSession, root: str) -> list[str]:
    return [s for s in SPLIT_ALIASES if split_files(spark, root, s)]


def json_sequences(spark: SparkSession, path: str, column: str, n: int) -> DataFrame:
    """The first n filled values of a field of JSON lines; blank lines and lines that are no objects are skipped."""
    value = stripped(F.get_json_object("value", f"$.{column}"))
    return spark.read.text(path).where(F.col("value").rlike(r"^\s*\{")).select(value.alias("sequence")).where("sequence IS NOT NULL").limit(n)


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines without white space around; blank ones and those from # on are skipped."""
    return spark.read.text(path).select(stripped(F.col("value")).alias("line")).where("line IS NOT NULL AND NOT startswith(line, '#')")


def symbol_counts(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, n) of tab-separated lines; a header, comments and lines without a whole number are skipped."""
    parts = F.split("line", "\t")
    return line_list(spark, path).where(F.size(parts) == 2).select(parts[0].alias("symbol"), parts[1].try_cast("long").alias("n")).where("n IS NOT NULL")


def vocabulary(spark: SparkSession, path: str, specials: tuple[str, ...] = ()) -> DataFrame:
    """(token, id) of one JSON object; repeated ids and missing special tokens are an error."""
    vocab = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))
    r = vocab.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.col("token").isin(*specials).cast("long") if specials else F.lit(0)).alias("specials")).first()
    if not r["n"] or r["n"] != r["ids"] or (r["specials"] or 0) < len(specials):
        raise ValueError(f"{path}: not a vocabulary: empty, repeated ids or missing special tokens")
    return vocab


def ragged(spark: SparkSession, path: str, short: list[str], long: list[str]) -> DataFrame:
    """Rows of two widths in one file, header rows inside it skipped; the short rows' fields go where they belong by name. Other widths are an error."""
    raw = spark.read.schema(", ".join(f"_{i} string" for i in range(len(long) + 1))).csv(path)
    width = F.size(F.array_compact(F.array(*[F.when(F.col(f"_{i}").isNotNull(), F.lit(i)) for i in range(len(long) + 1)])))
    last = F.greatest(*[F.when(F.col(f"_{i}").isNotNull(), F.lit(i + 1)).otherwise(0) for i in range(len(long) + 1)])
    rows = raw.withColumn("__w", F.when(last <= len(short), len(short)).when(last <= len(long), len(long)).otherwise(F.raise_error(F.lit("a row is too wide")).cast("int")))
    rows = rows.where((width > 0) & ~((F.col("_0") == short[0]) | (F.col("_0") == long[0])))
    at = {c: i for i, c in enumerate(short)}
    return rows.select(*[F.when(F.col("__w") == len(long), F.col(f"_{i}")).otherwise(F.col(f"_{at[c]}") if c in at else F.lit(None)).alias(c) for i, c in enumerate(long)])


def run_names(df: DataFrame, column: str) -> DataFrame:
    """Adds strategy, mlm_probability and learning_rate of names like mask_span__mlm_0p15__lr_1e-4."""
    pattern = r"mask_(.+?)__mlm_([0-9p.]+)__lr_([0-9pe.\-]+)"
    number = lambda k: F.replace(F.regexp_extract(column, pattern, k), F.lit("p"), F.lit(".")).try_cast("double")
    return df.withColumn("strategy", F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))).withColumn("mlm_probability", number(2)).withColumn("learning_rate", number(3))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in an order, all if there are fewer; fewer than one is an error."""
    if n < 1:
        raise ValueError("take one row at least")
    return df.orderBy(order).limit(n)


def collected(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """(sequence): n of the column's filled values, stripped, in the order of a hash of seed and value; all if there are fewer, an error if there is none.

    Equal values come together. Only the n are sorted in one place.
    """
    rows = df.select(stripped(F.col(column)).alias("sequence")).where("sequence IS NOT NULL")
    if rows.isEmpty():
        raise ValueError("the corpus has no sequence")
    return rows.orderBy(draw(seed, "collect", "sequence"), "sequence").limit(n)

"""Preparing a corpus: filters that let nulls pass, keep-first dedupe, hash splits and their checks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.hashing import bucket, draw, unit_interval
from lodeweave.operators.lineage import cut


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks; nothing is read."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def passes(*tests: Column) -> Column:
    """Whether no test is false: a test on a null passes."""
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(True))
    return out


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows without a key count as one key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def with_split(df: DataFrame, key: Column, valid: float, test: float, seed: int) -> DataFrame:
    """Adds split: test, valid or train by the hash of seed and key, so a key's split never depends on other rows."""
    if not (0 <= test < 1 and 0 < valid < 1 and valid + test < 1):
        raise ValueError("fractions must leave something to train on")
    u = unit_interval(F.concat_ws(":", F.lit(str(seed)), key))
    return df.withColumn("split", F.when(u < test, "test").when(u < test + valid, "valid").otherwise("train"))


def in_validation(key: Column, buckets: int, below: int) -> Column:
    return bucket(key, buckets) < below


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of their key: the same rows whatever the partitions. All if there are fewer."""
    return df.orderBy(draw(seed, "sample", key), key).limit(n)


def split_overlap(df: DataFrame, key: str, splits: list[str], examples: int = 20) -> DataFrame:
    """For each two splits how many keys they share, and the first of them, in one pass over df."""
    held = df.groupBy(key).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in splits])
    both = [F.when((F.col(a) == 1) & (F.col(b) == 1), F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"))) for a, b in combinations(splits, 2)]
    shared = held.select(key, F.explode(F.filter(F.array(*both), lambda p: p.isNotNull())).alias("p")).select(key, "p.*")
    place = F.row_number().over(Window.partitionBy("split_a", "split_b").orderBy(key))
    # a limit on row_number cuts each partition to the first keys before the exchange
    first = shared.withColumn("__place", place).where(F.col("__place") <= examples)
    first = first.groupBy("split_a", "split_b").agg(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ",").alias("first_keys"))
    n = shared.groupBy("split_a", "split_b").agg(F.count("*").alias("shared")).join(first, ["split_a", "split_b"])
    every = df.sparkSession.createDataFrame(list(combinations(splits, 2)), "split_a string, split_b string")
    return every.join(n, ["split_a", "split_b"], "left").select("split_a", "split_b", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("first_keys", F.lit("")).alias("first_keys"))


def require_splits(df: DataFrame, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """df, or an error that names the splits without a row: one count of the splits."""
    there = {r["split"] for r in df.groupBy("split").count().collect()}
    if missing := [s for s in splits if s not in there]:
        raise ValueError(f"empty splits: {', '.join(missing)}")
    return df


def canonical(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns of the names given, each the first filled one of its aliases that df has, without regard to case; other columns stay.

    A name without any of its aliases is an error. Blank text counts as not filled.
    """
    own = {c.lower(): c for c in df.columns}
    found = {name: [own[a.lower()] for a in dict.fromkeys([name, *aliases]) if a.lower() in own] for name, aliases in names.items()}
    if missing := [n for n, f in found.items() if not f]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    used = {c for f in found.values() for c in f}

    def filled(c: str) -> Column:
        return F.when(F.trim(F.col(c)) != "", F.col(c)) if df.schema[c].dataType.simpleString() == "string" else F.col(c)

    return df.select(*[F.coalesce(*[filled(c) for c in f]).alias(n) for n, f in found.items()], *[c for c in df.columns if c not in used])


def numbered(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """df with `out`: each row's place, from 1, in an order of all rows, ties in no fixed order.

    Rows are dealt to range partitions, which are kept, so that their sizes and their rows are of one dealing; places are
    summed up over partitions and counted inside them: no task sees all rows.
    """
    keys = [f"__o{k}" for k in range(len(order))]
    rows = df.withColumns(dict(zip(keys, order, strict=True)))
    parts = cut(rows.repartitionByRange(max(2, df.sparkSession.sparkContext.defaultParallelism), *keys).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy(F.col("__part").alias("__of")).agg(F.count("*").alias("__n"))
    # one row a partition
    before = sizes.select("__of", F.coalesce(F.sum("__n").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return parts.withColumn("__in", inside).join(F.broadcast(before), F.col("__part") == F.col("__of")).select(*df.columns, (F.col("__before") + F.col("__in")).cast("long").alias(out))


def row_slices(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Adds shard: n equal contiguous slices in an order, row i in the slice k with k*n//shards <= i < (k+1)*n//shards.

    Places are summed by range partitions, so no task sees all rows.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(max(2, spark.sparkContext.defaultParallelism), order).withColumn("__part", F.spark_partition_id())
    # partition ids of a range exchange are in order; sizes are few
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("__n").alias("__all"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    out = parts.withColumn("__in", place).join(F.broadcast(before.select("__part", "__before")), "__part").crossJoin(F.broadcast(total))
    i = F.col("__before") + F.col("__in")
    return out.withColumn("shard", F.floor(((i + 1) * shards - 1) / F.col("__all")).cast("int")).drop("__part", "__in", "__before", "__all")


#: Columns that are never labels.
NO_LABELS = {"smiles", "split", "id", "graph"}


def label_columns(columns: list[str], others: set[str] = frozenset()) -> list[str]:
    """The columns that are labels: all but `NO_LABELS` and others, without regard to case, in their order."""
    out = {c.lower() for c in NO_LABELS | set(others)}
    return [c for c in columns if c.lower() not in out]


def normalised(c: Column) -> Column:
    """A name for comparing: lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def skipping(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """df without the rows whose name is one of `names`, a short list of a user, compared as `normalised`; nulls stay."""
    held = {"".join(x for x in n.lower() if x.isascii() and x.isalnum()) for n in names}
    return df.where(~F.coalesce(normalised(F.col(column)).isin(*held), F.lit(False))) if held else df


def parsable(df: DataFrame, good: Column, split: str) -> tuple[DataFrame, DataFrame]:
    """(rows for which `good` holds, counts (split, kept, dropped) of all); a null counts as not good."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.groupBy(split).agg(F.sum(ok.cast("long")).alias("kept"), F.sum((~ok).cast("long")).alias("dropped"))


def sorted_json(pairs: Column) -> Column:
    """A map of text as JSON with its keys in order, without white space."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))

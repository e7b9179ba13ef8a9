"""Splits that keep the rows of a group together and fill train and validation by capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.hashing import draw
from lodeweave.operators.lineage import cut
from lodeweave.operators.order import placed, running_sum
from lodeweave.operators.statistics import budgets


def filled(groups: DataFrame, capacity: int) -> Column:
    """Whether a group (key, size, at in [0, 1)) is taken when groups come in the order of (at, key), each if it still fits.

    Taking whole runs does as well as one group after the other: of the groups no larger than what is left, as many as
    fit in order; the next of them doesn't fit, so what is left is smaller now, and the rest of the order is gone through
    again without the groups that are too large. Each round is a running sum over ranges; what it took is told by where
    it begins and ends and what was left, so rounds add a condition, not a column. Sizes are above 0.
    """
    taken, after, left = F.lit(False), None, capacity
    place = F.struct("at", "key")
    while left > 0:
        rest = groups.where(F.col("size") <= left)
        if after is not None:
            rest = rest.where(place > after)
        fits = running_sum(rest, [], F.col("at"), ["key"], F.col("size"), "upto").where(F.col("upto") <= left)
        last = fits.agg(F.max(place).alias("place"), F.max("upto").alias("upto")).first()
        if last["upto"] is None:
            break
        end = F.struct(F.lit(last["place"]["at"]).alias("at"), F.lit(last["place"]["key"]).alias("key"))
        took = (F.col("size") <= left) & (place <= end)
        taken = taken | (took if after is None else took & (place > after))
        after, left = end, left - last["upto"]
    return taken


def group_split(df: DataFrame, key: str, seed: int, train: float = 0.7, valid: float = 0.1) -> DataFrame:
    """df with split: train, valid or test, the same for all rows of a key; rows without a key are left out.

    Groups above half of what validation or test are to hold come first, then the others, both in the order of a hash of
    seed and key. A group goes to train if it still fits into its share of the rows, else to validation if it fits
    there, else to test. Keys are compared as text. No rows give none.
    """
    if not (0 < train < 1 and 0 <= valid < 1 and train + valid <= 1):
        raise ValueError("shares must leave something to test on")
    rows = df.where(F.col(key).isNotNull())
    sizes = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("size"))
    n = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_train, n_valid = int(n * train), int(n * valid)
    small = (F.col("size") <= n_valid / 2) & (F.col("size") <= (n - n_train - n_valid) / 2)
    groups = cut(sizes.withColumn("at", (draw(seed, "group", "key") + F.when(small, 1.0).otherwise(0.0)) / 2))
    in_train = filled(groups, n_train)
    rest = groups.where(~in_train)
    in_valid = filled(rest, n_valid)
    split = groups.select(F.col("key").alias("__key"), F.when(in_train, "train").when(in_valid, "valid").otherwise("test").alias("split"))
    return rows.join(split, F.col(key).cast("string") == F.col("__key")).drop("__key")


def subsample(df: DataFrame, split: str, position: str, selected: list[str], budget: int, seed: int) -> DataFrame:
    """df with quota-many rows of each selected split, drawn by a hash of seed and position, and new_position: places from 0 in the order of the old ones.

    Quotas are shared out by `budgets` over the selected splits; rows of other splits all stay. Positions are unique
    longs. What is drawn doesn't depend on partitions.
    """
    sizes = df.where(F.col(split).isin(selected)).groupBy(split).agg(F.count("*").alias("size"))
    quota = budgets(sizes, split, "size", budget).select(F.col(split).alias("__split"), "quota")
    drawn = placed(df, [split], draw(seed, "sample", position), [position], "__place")
    # one row a split
    kept = drawn.join(F.broadcast(quota), F.col(split) == F.col("__split"), "left").where(F.col("quota").isNull() | (F.col("__place") < F.col("quota")))
    rows = kept.drop("__split", "quota", "__place")
    most = max(1, rows.agg(F.max(position)).first()[0] or 1)
    return placed(rows, [], F.col(position) / (most + 1), [position], "new_position")


def subsample_name(model: str, scope: str, budget: int, seed: int) -> str:
    """The identity under which results of a subsample are stored."""
    return f"{model}__subsample_{scope}{budget}_seed{seed}"


def excluded(df: DataFrame, key: str, split: str, listed: DataFrame, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """df without the keys of listed (key); a row whose split is none of `splits` is an error when it is read."""
    known = F.when(F.col(split).isin(*splits), F.col(split)).otherwise(F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(F.col(split).cast("string"), F.lit("null")))))
    return df.join(listed.select(key).distinct(), key, "left_anti").withColumn(split, known)


def of_split(df: DataFrame, column: str | None, wanted: str, sequence: str) -> DataFrame:
    """df's rows of a split under any of its names, without regard to case, that have a sequence; all rows of these if there is no split column."""
    from lodeweave.functions.text import stripped
    from lodeweave.sources.readers import SPLIT_ALIASES

    rows = df.where(stripped(F.col(sequence)).isNotNull())
    if column is None or column not in df.columns:
        return rows
    return rows.where(F.lower(F.trim(F.col(column))).isin(*SPLIT_ALIASES.get(wanted, (wanted,))))


def without_nan(df: DataFrame, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose vector is there without null or NaN, one row with the number n of the others)."""
    good = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return df.where(good), df.agg(F.coalesce(F.sum((~F.coalesce(good, F.lit(False))).cast("long")), F.lit(0)).alias("n"))

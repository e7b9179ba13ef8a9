"""Operators of result reports: ranks, best rows, pairwise outcomes, coverage, pivots and summaries.

All take and return DataFrames. Metrics point up (larger is better) unless their name is in LOWER_IS_BETTER.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.operators.order import exact_quantiles

#: Metrics whose smaller values are better, and those bounded by 1 that reports show times 100.
LOWER_IS_BETTER = ("mae", "mse", "rmse", "rae")
BOUNDED = ("accuracy", "auprc", "auroc", "f1", "pr_auc", "roc_auc")


def direction(metric_name: Column) -> Column:
    """1 for metrics to maximise, -1 for those to minimise; an unknown name raises an error."""
    name = F.lower(F.trim(metric_name))
    known = F.when(name.isin(*LOWER_IS_BETTER), -1).when(name.isin(*BOUNDED, "r2", "spearman"), 1)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown metric: "), F.coalesce(metric_name, F.lit("null")))).cast("int"))


def display_scale(metric_name: Column, value: Column) -> Column:
    """value times 100 for metrics bounded by 1."""
    return F.when(F.lower(F.trim(metric_name)).isin(*BOUNDED), value * 100).otherwise(value)


def average_rank(value: Column, *by: str, descending: bool = True) -> Column:
    """Rank inside the groups of `by`, ties sharing the mean of their places; nulls rank last together."""
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def best_rows(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in an order; whole rows, never columns of different rows mixed."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def best_by_cv(results: DataFrame) -> DataFrame:
    """One row per dataset, metric and embedder: the head with the best cross-validated metric, by name on ties."""
    signed = direction(F.col("cv_metric_name")) * F.col("cv_metric")
    return best_rows(results, ["dataset", "cv_metric_name", "embedder"], signed.desc_nulls_last(), F.col("model"))


def best_by_test(results: DataFrame) -> DataFrame:
    """One row per dataset, embedder and metric: the largest test metric, by head name on ties."""
    return best_rows(results, ["dataset", "embedder", "test_metric_name"], F.col("test_metric").desc_nulls_last(), F.col("model"))


def first_non_null(df: DataFrame, by: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Per group and column the first value that isn't null, so a row may mix rows."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(*by, *[F.first_value(c, ignoreNulls=True).over(w).alias(c) for c in columns]).distinct()


def collapse_variants(df: DataFrame, name: str, by: Sequence[str], value: str) -> DataFrame:
    """Drops a bracketed suffix of `name` and keeps the best row of each base name in a group."""
    base = df.withColumn(name, F.regexp_replace(name, r"_?\[[^\]]+\]", ""))
    return best_rows(base, [*by, name], F.col(value).desc_nulls_last())


def complete_groups(df: DataFrame, group: str, member: str) -> DataFrame:
    """Rows of the groups that hold every member that occurs."""
    everyone = df.agg(F.countDistinct(member).alias("all_members"))
    full = df.groupBy(group).agg(F.countDistinct(member).alias("members")).join(F.broadcast(everyone), F.col("members") == F.col("all_members"))
    return df.join(full.select(group), group, "left_semi")


def model_pairs(scores: DataFrame, item: str, model: str, value: str) -> DataFrame:
    """Rows (item, model_a, model_b, value_a, value_b) of all ordered pairs of different models on an item."""
    left = scores.select(F.col(item), F.col(model).alias("model_a"), F.col(value).alias("value_a"))
    right = scores.select(F.col(item), F.col(model).alias("model_b"), F.col(value).alias("value_b"))
    return left.join(right, item).where("model_a <> model_b")


def outcomes(pairs: DataFrame, tie: float = 0.0, *by: str) -> DataFrame:
    """Wins, losses and ties (differences up to `tie`) of model_a against model_b, and the win rate, mean and median difference."""
    delta = F.col("value_a") - F.col("value_b")
    won, lost = F.sum((delta > tie).cast("long")), F.sum((delta < -tie).cast("long"))
    return pairs.where(delta.isNotNull()).groupBy(*(by or ("model_a", "model_b"))).agg(
        F.count("*").alias("n"), won.alias("wins"), lost.alias("losses"), (F.count("*") - won - lost).alias("ties"),
        (won / F.count("*")).alias("win_rate"), F.avg(delta).alias("mean_delta"), F.median(delta).alias("median_delta"),
    )


def with_group_max(df: DataFrame, by: Sequence[str], value: str, alias: str = "best") -> DataFrame:
    return df.withColumn(alias, F.max(value).over(Window.partitionBy(*by)))


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, sample deviation, quartiles and their distance."""
    q = exact_quantiles(df, list(by), value, [0.25, 0.5, 0.75]).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("quantiles").alias("q"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).join(q, on, "left")
    q1, median, q3 = (F.col("q")[k] for k in range(3))
    return out.select(*by, "n", "mean", median.alias("median"), "sd", q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of rows by two columns, 0 where there are none; the columns are named, so the plan needs no extra pass."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)

"""Places and running sums of rows in an order, and exact quantiles, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, by: list[str], u: Column, ties: list[str], value: Column, out: str, parts: int = 1024) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the group (all rows if `by` is empty) up to and with this one, in the order of u, then of `ties`.

    u lies in [0, 1), spread over it. Its range falls into `parts` equal ones; their sums, `parts` rows a group at most,
    are added up in order, and rows are sorted inside their part only. Nulls in `by` are a group.
    """
    if {"__u", "__part", "__value", "__inside", out} & set(df.columns):
        raise ValueError(f"columns __u, __part, __value, __inside and {out} must be free")
    rows = df.withColumn("__u", u).withColumn("__value", value).withColumn("__part", F.least(F.floor(F.col("__u") * parts), F.lit(parts - 1)).cast("int"))
    names = [f"__by{k}" for k in range(len(by))]
    sums = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("__part").alias("__of")).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*names).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*names, "__of", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    on = F.col("__part") == F.col("__of")
    for c, n in zip(by, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(n))
    upto = Window.partitionBy(*by, "__part").orderBy("__u", *ties).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("__inside", F.sum("__value").over(upto)).join(before, on)
    return met.select(*df.columns, (F.col("__before") + F.col("__inside")).alias(out))


def placed(df: DataFrame, by: list[str], u: Column, ties: list[str], out: str = "place", parts: int = 1024) -> DataFrame:
    """df with `out`: each row's place, from 0, in its group, in the order of u, then of `ties`; see `running_sum`."""
    return running_sum(df, by, u, ties, F.lit(1).cast("long"), out, parts).withColumn(out, F.col(out) - 1)


def _same(by: list[str], names: list[str]) -> Column:
    on = F.lit(True)
    for c, n in zip(by, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return on


def running_by_value(counts: DataFrame, by: list[str], value: str, measures: list[str], parts: int = 64) -> DataFrame:
    """counts, one row a group and value, with m_upto for each measure m, its sum over the group's values up to and with this one, and m_all, over all.

    A sketch of bounded size cuts each group's values into `parts` ranges of about as many values; sums of ranges are
    added up in order and values are sorted inside their range only. The sketch decides who sorts what, never what comes
    out. Values are numbers, neither null nor NaN.
    """
    names = [f"__{c}" for c in by]
    keys = [F.col(c).alias(n) for c, n in zip(by, names, strict=True)]
    edges = counts.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), [k / parts for k in range(1, parts)], 1000).alias("__edges"))
    met = counts.join(edges, _same(by, names)).withColumn("__part", F.size(F.filter("__edges", lambda e: e < F.col(value)))).drop("__edges", *names)
    sums = met.groupBy(*keys, F.col("__part").alias("__of")).agg(*[F.sum(m).alias(f"__s_{m}") for m in measures])
    group = Window.partitionBy(*names)
    earlier = group.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*names, "__of", *[F.coalesce(F.sum(f"__s_{m}").over(earlier), F.lit(0)).alias(f"__b_{m}") for m in measures], *[F.sum(f"__s_{m}").over(group).alias(f"{m}_all") for m in measures])
    upto = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = met.select("*", *[F.sum(m).over(upto).alias(f"__i_{m}") for m in measures])
    out = inside.join(before, _same(by, names) & (F.col("__part") == F.col("__of")))
    return out.select(*counts.columns, *[(F.col(f"__b_{m}") + F.col(f"__i_{m}")).alias(f"{m}_upto") for m in measures], *[f"{m}_all" for m in measures])


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], parts: int = 64) -> DataFrame:
    """(by, n, quantiles): exact percentiles of a group's values, between two values in proportion; nulls and NaN left out.

    Equal values are counted first, then places come from `running_by_value`, so no task sees all values of a group.
    """
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("t"))
    upto = running_by_value(counts, by, "__v", ["t"], parts)

    def at(rank: Column) -> Column:  # the value at a place from 0
        return F.min(F.when(F.col("t_upto") > rank, F.col("__v")))

    rank = [(F.col("t_all") - 1) * p for p in probabilities]
    held = upto.groupBy(*by, "t_all").agg(*[x.alias(f"__{end}{k}") for k, r in enumerate(rank) for end, x in (("low", at(F.floor(r))), ("high", at(F.ceil(r))))])
    between = [F.col(f"__low{k}") + (F.col(f"__high{k}") - F.col(f"__low{k}")) * (r - F.floor(r)) for k, r in enumerate(rank)]
    return held.select(*by, F.col("t_all").alias("n"), F.array(*between).alias("quantiles"))

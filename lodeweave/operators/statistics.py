"""Resampling, signed ranks, calibration and quotas."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lodeweave.operators.order import exact_quantiles, running_by_value


#: Draws that one SHA-1 gives: eight of five hexadecimal digits.
_DRAWS, _DIGITS = 8, 5
#: Rows drawn for together; sums that a task holds at most before it hands them on.
_ROWS, _SUMS = 4096, 1 << 20


def poisson_steps() -> list[float]:
    """The distribution function of the Poisson law of mean 1, from 0 to 8."""
    return [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(9)]


@cache
def _poisson_table() -> np.ndarray:
    """The Poisson draw of each number of five hexadecimal digits."""
    u = (np.arange(16**_DIGITS) + 0.5) * 16.0**-_DIGITS
    return np.searchsorted(poisson_steps(), u).astype(np.uint8)


def _times(items: list[str | None], replicates: int, seed: int) -> np.ndarray:
    """How often each item comes into each replicate; a null item has no part in its hash."""
    ends = [f":{k}".encode() for k in range(replicates // _DRAWS)]
    heads = [f"{seed}:boot".encode() + (b"" if i is None else f":{i}".encode()) for i in items]
    digests = b"".join([hashlib.sha1(head + end, usedforsecurity=False).digest() for head in heads for end in ends])
    x = np.frombuffer(digests, np.uint8).reshape(-1, 5).astype(np.int32)  # five bytes are two draws
    first = x[:, 0] << 12 | x[:, 1] << 4 | x[:, 2] >> 4
    second = (x[:, 2] & 15) << 16 | x[:, 3] << 8 | x[:, 4]
    return _poisson_table()[np.stack([first, second], 1)].reshape(len(items), replicates)


def bootstrap_means(df: DataFrame, by: list[str], item: str, value: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """(by, n, mean, low, high): the mean of value and its percentile interval over resampled items.

    An item comes into a replicate as often as a Poisson draw of mean 1 says, from a hash of seed, item and replicate:
    all groups of `by` share it, so differences and ranks stay paired, and rows never have to meet. A hash gives eight
    draws, which a table turns into Poisson draws; a task adds rows up by group and replicate: what is shuffled is as many
    rows as groups times replicates of each task, however many rows there are. Rows without a value are left out; a replicate that
    draws no item gives no mean.
    """
    if replicates < 1 or replicates % _DRAWS:
        raise ValueError(f"replicates must be a multiple of {_DRAWS}")
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(item).cast("string").alias("__item"), F.col(value).cast("double").alias("__v"))
    types = [rows.schema[c] for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            held = np.array(list(sums.values())).reshape(-1, 2, replicates)
            keys = [pa.array([k[i] for k in sums for _ in range(replicates)], kinds[i]) for i in range(len(types))]
            b = np.tile(np.arange(replicates, dtype=np.int32), len(sums))
            return pa.RecordBatch.from_arrays([*keys, pa.array(b), pa.array(held[:, 0].ravel()), pa.array(held[:, 1].ravel())], [*by, "b", "s", "n"])

        kinds: list[pa.DataType] = []
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                kinds = [c.type for c in part.columns[:-2]]
                items = part.column(len(types)).dictionary_encode(null_encoding="encode")
                times = _times(items.dictionary.to_pylist(), replicates, seed)[items.indices.to_numpy()].astype(float)
                v = part.column(len(types) + 1).to_numpy(zero_copy_only=False)
                keys = list(zip(*[c.to_pylist() for c in part.columns[:-2]], strict=True)) if types else [()] * len(v)
                known: dict[tuple, int] = {}
                code = np.array([known.setdefault(k, len(known)) for k in keys])
                order = np.argsort(code, kind="stable")
                edges = np.searchsorted(code[order], np.arange(len(known) + 1))
                for k, g in known.items():
                    own = order[edges[g] : edges[g + 1]]
                    found = sums.setdefault(k, np.zeros((2, replicates)))
                    found += [v[own] @ times[own], times[own].sum(0)]
                if len(sums) * replicates > _SUMS:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    schema = StructType([*types, StructField("b", IntegerType()), StructField("s", DoubleType()), StructField("n", DoubleType())])
    sums = rows.mapInArrow(run, schema).groupBy(*by, "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = sums.select(*by, (F.col("s") / F.nullif(F.col("n"), F.lit(0.0))).alias("m"))
    q = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    ranges = means.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(q.alias("q"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    plain = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return plain.join(ranges, on or F.lit(True)).select(*by, "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_mean(df: DataFrame, key: str, value: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """(mean, low, high) of all rows; see `bootstrap_means`."""
    return bootstrap_means(df, [], key, value, replicates, seed, level).select("mean", "low", "high")


def signed_rank(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """Wilcoxon's sums: n without zeros, w_plus and w_minus, with shared ranks."""
    g = _signed_sums(df, by, delta)
    return g.select(*by, "n", F.col("plus").cast("double").alias("w_plus"), F.col("minus").cast("double").alias("w_minus"))


def _signed_sums(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """(by, n, plus, minus, ties): rank sums of differences above and below 0, and the sum of t^3 - t over sizes that t share.

    Equal sizes are counted first, so ranks are sums over distinct sizes.
    """
    sizes = df.where(f"{delta} <> 0").groupBy(*by, F.abs(delta).alias("__a")).agg(F.count("*").alias("t"), F.sum(F.expr(f"CASE WHEN {delta} > 0 THEN 1 ELSE 0 END")).alias("up"))
    rank = F.col("t_upto") - F.col("t") + (F.col("t") + 1) / 2
    t = F.col("t").cast("double")
    rows = running_by_value(sizes, by, "__a", ["t"]).withColumn("r", rank)
    return rows.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("r") * F.col("up")).alias("plus"), F.sum(F.col("r") * (F.col("t") - F.col("up"))).alias("minus"), F.sum(t * t * t - t).alias("ties"))


def exact_signed_rank_p(n: Column, w: Column) -> Column:
    """The two-sided p-value of a signed-rank sum w of n differences without ties: twice the smaller tail, 1 at most.

    The number of sign patterns with each sum comes from a fold that adds one rank at a time: the counts so far, and
    the same counts moved by the rank.
    """
    size = (n * (n + 1) / 2 + 1).cast("int")

    def add(counts: Column, rank: Column) -> Column:
        return F.transform(counts, lambda c, i: c + F.when(i >= rank, F.element_at(counts, (F.greatest(i - rank, F.lit(0)) + 1).cast("int"))).otherwise(0.0))

    none = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i == 1, 1.0).otherwise(0.0))
    counts = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), none, add))

    def tail(keep) -> Column:
        return F.aggregate(F.filter(counts, lambda c, i: keep(i)), F.lit(0.0), lambda a, c: a + c) / F.pow(F.lit(2.0), n)

    return F.least(F.lit(1.0), 2 * F.least(tail(lambda i: i <= w), tail(lambda i: i >= w)))


def signed_rank_test(df: DataFrame, by: list[str], delta: str, most_exact: int = 50) -> DataFrame:
    """(by, n, statistic, p_value) of Wilcoxon's two-sided test; statistic is the smaller of both rank sums.

    Up to `most_exact` differences without zeros or ties the p-value is exact; beyond, or with ties, it comes from the
    normal law with the variance corrected for ties. Zero differences and nulls are left out; a group of nothing else
    gives no row.
    """
    g = _signed_sums(df, by, delta)
    n, w = F.col("n"), F.least("plus", "minus")
    m = n.cast("double")
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    z = (w - m * (m + 1) / 4) / F.nullif(sd, F.lit(0.0))
    near = F.least(F.lit(1.0), 2 * normal_below(z))
    return g.select(*by, "n", w.alias("statistic"), F.when((n <= most_exact) & (F.col("ties") == 0), exact_signed_rank_p(n, w)).otherwise(near).alias("p_value"))


def normal_below(z: Column) -> Column:
    """The normal law's distribution function, z of any size: a continued fraction beyond 2.5, a series inside.

    Right to about 1e-12 of its value.
    """
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    # x + x^3/3 + x^5/(3*5) + ...
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("sum"), x.alias("term")), lambda s, k: F.struct((s["sum"] + s["term"] * x * x / (2 * k + 1)).alias("sum"), (s["term"] * x * x / (2 * k + 1)).alias("term")))["sum"]
    # x + 1/(x + 2/(x + 3/(x + ...)))
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda s, k: x + k / s)
    upper = F.when(x > 2.5, density / fraction).otherwise(0.5 - density * series)
    return F.when(z <= 0, upper).otherwise(1 - upper)


def calibration(df: DataFrame, predicted: str, actual: str, bins: int = 10) -> DataFrame:
    """Per quantile bin of the prediction: bin, n, mean_predicted, mean_actual, mae; equal edges make one bin."""
    cuts = [k / bins for k in range(1, bins)]
    edges = exact_quantiles(df, [], predicted, cuts).select(F.array_distinct("quantiles").alias("edges"))
    b = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: F.col(predicted) > e)))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"), F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae"))


def quotas(sizes: DataFrame, name: str, size: str, budget: int) -> DataFrame:
    """(name, size, quota): shares of a budget in proportion, whole parts first, the rest by largest fraction, then by name, falling."""
    every = Window.partitionBy()
    share = F.least(F.col(size).cast("double"), F.lit(float(budget)) * F.col(size) / F.sum(size).over(every))
    s = sizes.withColumn("__floor", F.floor(share).cast("long")).withColumn("__frac", share - F.floor(share))
    spare = F.lit(budget) - F.sum("__floor").over(every)
    place = F.row_number().over(Window.orderBy(F.desc("__frac"), F.desc(name)))
    s = s.withColumn("__spare", spare).withColumn("__place", place)
    return s.select(name, size, (F.col("__floor") + (F.col("__place") <= F.col("__spare")).cast("long")).alias("quota"))


def budgets(sizes: DataFrame, name: str, size: str, budget: int) -> DataFrame:
    """(name, size, quota): a budget of samples shared out to splits, one row each; nobody gets more than it has.

    All get everything if that is within the budget. Else each split that isn't empty gets one, if the budget allows; the
    rest is shared by what is left of the sizes, whole parts first, then one each by (fraction, name), both falling, to
    splits that have more, and what still is left goes to the largest first. Splits are few: the windows see them all.
    """
    every = Window.partitionBy()
    n, full = F.col(size).cast("long"), F.sum(size).over(every)
    s = sizes.select(name, n.alias(size), full.alias("__all"))
    filled = F.sum((F.col(size) > 0).cast("long")).over(every)
    s = s.withColumn("__one", F.when((F.col(size) > 0) & (filled <= budget), 1).otherwise(0).cast("long"))
    s = s.withColumn("__rest", F.lit(budget) - F.sum("__one").over(every)).withColumn("__w", F.col(size) - F.col("__one"))
    exact = F.coalesce(F.col("__rest") * F.col("__w") / F.nullif(F.sum("__w").over(every), F.lit(0)), F.lit(0.0))
    s = s.withColumn("__exact", exact).withColumn("__add", F.least(F.floor("__exact").cast("long"), F.col("__w")))
    s = s.withColumn("__has", F.col("__one") + F.col("__add")).withColumn("__more", F.col(size) - F.col("__has"))
    place = F.row_number().over(Window.partitionBy((F.col("__more") > 0).alias("x")).orderBy(F.desc(F.col("__exact") - F.col("__add")), F.desc(name)))
    spare = F.lit(budget) - F.sum("__has").over(every)
    s = s.withColumn("__place", place).withColumn("__spare", spare)
    s = s.withColumn("__has", F.col("__has") + ((F.col("__more") > 0) & (F.col("__place") <= F.col("__spare"))).cast("long"))
    left = F.lit(budget) - F.sum("__has").over(every)
    room = F.col(size) - F.col("__has")
    before = F.coalesce(F.sum("__room").over(Window.orderBy(F.desc(size), name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("__room", room).withColumn("__left", left).withColumn("__before", before)
    fill = F.greatest(F.lit(0), F.least(F.col("__room"), F.col("__left") - F.col("__before")))
    return s.select(name, size, F.when(F.col("__all") <= budget, F.col(size)).otherwise(F.col("__has") + fill).alias("quota"))


def raster(df: DataFrame, x: str, y: str, low: float, high: float, cells: int) -> DataFrame:
    """(px, py, n, mean_x): counts on a grid; points outside go to border cells."""
    def cell(c):
        return F.least(F.greatest(F.floor((F.col(c) - low) / (high - low) * cells), F.lit(0)), F.lit(cells - 1)).cast("int")

    return df.groupBy(cell(x).alias("px"), cell(y).alias("py")).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"))

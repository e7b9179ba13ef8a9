"""Bootstraps, rank tests and group splits against loops."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.operators import splits, statistics


def test_bootstrap_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(g, f"d{i}", None if rng.random() < 0.1 else rng.random()) for g in ("a", "b", None) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, item string, v double")
    got = {r.g: r for r in statistics.bootstrap_means(df.repartition(3), ["g"], "item", "v", 64, 9).collect()}
    steps = statistics.poisson_steps()

    def times(item, b):
        h = hashlib.sha1(f"9:boot:{item}:{b // 8}".encode()).hexdigest()
        u = (int(h[5 * (b % 8) : 5 * (b % 8) + 5], 16) + 0.5) / 16**5
        return sum(u > s for s in steps)

    for g in ("a", "b", None):
        held = [(i, v) for k, i, v in rows if k == g and v is not None]
        means = []
        for b in range(64):
            n = [times(i, b) for i, _ in held]
            means += [sum(k * v for k, (_, v) in zip(n, held)) / sum(n)] if sum(n) else []
        assert got[g].n == len(held) and got[g].mean == pytest.approx(np.mean([v for _, v in held]))
        assert (got[g].low, got[g].high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    with pytest.raises(ValueError):
        statistics.bootstrap_means(df, ["g"], "item", "v", 7, 1)


def test_multiplicities_are_poisson(spark):
    df = spark.range(3000).select("id", F.lit(1).alias("g"), (F.col("id") % 2).cast("double").alias("v"))
    r = statistics.bootstrap_means(df, [], "id", "v", 400, 2).first()
    assert r.mean == 0.5 and abs((r.high - r.low) / (2 * 1.96 * 0.5 / math.sqrt(3000)) - 1) < 0.15


@pytest.mark.parametrize("n", range(1, 13))
def test_exact_p_equals_enumeration(spark, n):
    rng = random.Random(n)
    size = rng.sample(range(1, 1000), n)
    delta = [s * rng.choice([-1, 1, 1]) for s in size]
    rank = {s: k + 1 for k, s in enumerate(sorted(size))}
    up = sum(rank[abs(x)] for x in delta if x > 0)
    w = min(up, n * (n + 1) // 2 - up)
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    p = min(1.0, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / 2**n)
    r = statistics.signed_rank_test(spark.createDataFrame([(0, x) for x in [*delta, 0]] + [(0, None)], "k int, delta long"), ["k"], "delta").first()
    assert (r.n, r.statistic) == (n, w) and r.p_value == pytest.approx(p, abs=1e-12)


def test_normal_p_with_ties_and_many_rows(spark):
    rng = random.Random(5)
    rows = [(0, rng.choice([-3, -2, -1, 1, 2, 3, 4])) for _ in range(70)] + [(1, k - 20 + (k >= 20)) for k in range(130)] + [(2, 5), (2, 5), (2, -5)]
    for r in statistics.signed_rank_test(spark.createDataFrame(rows, "k int, delta long"), ["k"], "delta").collect():
        held = [x for k, x in rows if k == r.k]
        n, sizes = len(held), [abs(x) for x in held]
        rank = {s: (2 * sum(t < s for t in sizes) + sizes.count(s) + 1) / 2 for s in set(sizes)}
        w = min(sum(rank[abs(x)] for x in held if x * sign > 0) for sign in (1, -1))
        ties = sum(sizes.count(s) ** 3 - sizes.count(s) for s in set(sizes))
        z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        assert r.statistic == w and r.p_value == pytest.approx(math.erfc(-z / math.sqrt(2)), rel=1e-10)


def test_normal_law(spark):
    zs = [-30.0, -9.0, -4.2, -2.51, -2.5, -2.49, -1.0, -0.001, 0.0, 0.7, 2.6, 7.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", statistics.normal_below(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(-r.z / math.sqrt(2)) / 2, rel=1e-11)


def split_by_loop(sizes, seed, train, valid):
    n = sum(sizes.values())
    cap = {"train": int(n * train), "valid": int(n * valid)}
    rest = n - cap["train"] - cap["valid"]

    def at(k):
        u = (int(hashlib.sha1(f"{seed}:group:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return sizes[k] <= cap["valid"] / 2 and sizes[k] <= rest / 2, u

    held, out = {"train": 0, "valid": 0}, {}
    for k in sorted(sizes, key=at):
        out[k] = next((s for s in ("train", "valid") if held[s] + sizes[k] <= cap[s]), "test")
        if out[k] != "test":
            held[out[k]] += sizes[k]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_group_split_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"g{k}": rng.choice([1, 1, 2, 3, 5, 8, 40]) for k in range(90)} | {"hot": 170}
    rows = [(k, i) for k, n in sizes.items() for i in range(n)] + [(None, 1)] * 5
    df = spark.createDataFrame(rows, "k string, i int")
    out = splits.group_split(df.repartition(5), "k", seed).collect()
    assert len(out) == sum(sizes.values())
    assert {(r.k, r.split) for r in out} == set(split_by_loop(sizes, seed, 0.7, 0.1).items())


def test_group_split_edges(spark):
    df = spark.createDataFrame([("only", 1)] * 10, "k string, i int")
    assert {r.split for r in splits.group_split(df, "k", 1).collect()} == {"test"}  # too large for both
    assert splits.group_split(df.limit(0), "k", 1).count() == 0
    with pytest.raises(ValueError):
        splits.group_split(df, "k", 1, 0.9, 0.2)

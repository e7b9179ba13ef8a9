"""Kernel ridge regression against dense solves, corrections against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.functions.hashing import draw
from lodeweave.operators import kernels, statistics


def table(spark, n=70, d=6, seed=2):
    rng = np.random.default_rng(seed)
    kinds = rng.integers(0, 5, size=(6, d))
    x = np.maximum(kinds[rng.integers(0, 6, n)] + rng.integers(-1, 2, size=(n, d)), 0)
    y = x @ rng.normal(size=d) + rng.normal(size=n)
    noise = rng.uniform(0.5, 2, n)
    rows = [(i, x[i].tolist(), float(y[i]), float(noise[i])) for i in range(n)]
    return x.astype(float), y, noise, spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (901, x[0].tolist(), None, 1.0)], "id long, x array<long>, y double, d double")


def dense(k, y, noise, penalty):
    mean = np.average(y, weights=1 / noise)
    return mean, np.linalg.solve(k + penalty * np.diag(noise), y - mean)


def tanimoto(a, b):
    return np.array([[np.minimum(p, q).sum() / max(np.maximum(p, q).sum(), 1e-300) for q in b] for p in a])


@pytest.mark.parametrize("penalty", [0.1, 3.0])
def test_all_rows_as_landmarks_give_the_dense_solution(spark, penalty):
    x, y, noise, df = table(spark)
    marks = kernels.landmarks(df.where("y IS NOT NULL"), "id", "x", draw(1, "m", "id"))
    assert sorted(map(int, marks.keys)) == list(range(70))
    model = kernels.kernel_ridge(df.repartition(3), "id", "x", "y", "d", penalty, marks)
    mean, alpha = dense(tanimoto(x, x), y, noise, penalty)
    want = tanimoto(x, x) @ alpha + mean
    got = {r.id: r.p for r in df.select("id", kernels.predicted(F.col("x"), model, -2.0, 4.0).alias("p")).collect()}
    assert [got[i] for i in range(70)] == pytest.approx(list(np.clip(want, -2, 4)), abs=1e-6) and got[900] is None
    few = kernels.landmarks(df, "id", "x", draw(1, "m", "id"), 5)
    assert len(few.keys) == 5 and len(kernels.kernel_ridge(df, "id", "x", "y", "d", penalty, few).alpha) == 5


def test_neighbourhood_cv_equals_refits(spark):
    x, y, noise, df = table(spark)
    marks = kernels.landmarks(df.where("y IS NOT NULL"), "id", "x", draw(1, "m", "id"))
    k, penalties, anchors = tanimoto(x, x), [0.1, 1.0, 10.0], [3, 17, 40, 41]
    errors = {p: [] for p in penalties}
    for a in anchors:
        held = (k[:, a] >= 0.6) & (np.arange(70) != a)
        if held.sum() < 3:
            continue
        for p in penalties:
            mean, alpha = dense(k[np.ix_(~held, ~held)], y[~held], noise[~held], p)
            errors[p].append(np.abs(k[np.ix_(held, ~held)] @ alpha + mean - y[held]).mean())
    got = kernels.neighbourhood_cv(df, "id", "x", "y", "d", penalties, marks, [str(a) for a in anchors], 0.6)
    assert [r[0] for r in got] == sorted(penalties, key=lambda p: np.mean(errors[p])) and len(errors[0.1]) > 1
    for p, mean, worst, folds in got:
        assert (mean, worst, folds) == (pytest.approx(np.mean(errors[p]), abs=1e-6), pytest.approx(max(errors[p]), abs=1e-6), len(errors[p]))
    assert kernels.neighbourhood_cv(df, "id", "x", "y", "d", penalties, marks, ["3"], 1.1) == []


def test_offsets_equal_a_loop(spark):
    x, y, _, df = table(spark)
    df = df.where("y IS NOT NULL AND x IS NOT NULL").withColumn("p", F.lit(0.5)).withColumn("r", F.col("y") - F.col("p"))
    marks = kernels.landmarks(df, "id", "x", draw(4, "m", "id"), 6)
    got = kernels.cluster_offsets(df, "x", "r", marks, 0.6, 3.0)
    k, want = tanimoto(x, marks.vectors), {}
    for a, name in enumerate(marks.keys):
        near = np.flatnonzero(k[:, a] >= 0.6)
        if len(near) >= 2:
            want[name] = (len(near), len(near) / (len(near) + 3.0) * np.median(y[near] - 0.5))
    assert {n: (c, pytest.approx(o)) for n, (c, o) in want.items()} == got
    smallest = sorted(abs(o) for _, o in want.values())[1]
    shift = np.array([o if abs(o) >= smallest else 0.0 for _, o in (want.get(n, (0, 0.0)) for n in marks.keys)])
    out = {r.id: r.q for r in df.select("id", kernels.with_offsets(F.col("p"), F.col("x"), marks, got, smallest).alias("q")).collect()}
    assert [out[i] for i in range(70)] == pytest.approx(list(0.5 + (k @ shift) / k.sum(1)))


def test_huber_line_equals_its_conditions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300) + 50
    y = 2 * x - 7 + rng.normal(size=300) * 0.3
    y[:40] += rng.uniform(5, 50, 40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, float("nan"))], "x double, y double")
    got = kernels.huber_line(df, F.col("x"), F.col("y"))
    r = (y - got.slope * x - got.intercept) / got.scale
    pull = np.clip(r, -1.35, 1.35)
    inside = np.abs(r) <= 1.35
    # the gradient of the joint loss is zero
    assert abs(pull.sum()) < 1e-5 and abs((pull * (x - 50)).sum()) < 1e-5
    assert (r[inside] ** 2).sum() + 1.35**2 * (~inside).sum() == pytest.approx(300, abs=1e-4)
    assert abs(got.slope - 2) < 0.1
    with pytest.raises(ValueError):
        kernels.huber_line(df.where("x > 1000"), F.col("x"), F.col("y"))
    line = spark.createDataFrame([(float(k), 3.0 * k + 1) for k in range(5)], "x double, y double")
    exact = kernels.huber_line(line, F.col("x"), F.col("y"))
    assert (exact.slope, exact.intercept) == pytest.approx((3.0, 1.0))


@pytest.mark.parametrize("parts", [2, 64])
def test_exact_quantiles_equal_numpy(spark, parts):
    rng = np.random.default_rng(6)
    rows = [("even", float(v)) for v in rng.integers(0, 5, 400)] + [(None, float(v)) for v in rng.lognormal(0, 4, 301)] + [("one", 3.0), ("even", None), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {r.g: (r.n, r.quantiles) for r in statistics.exact_quantiles(df.repartition(3), ["g"], "v", probs, parts).collect()}
    for g in ("even", None, "one"):
        v = [x for k, x in rows if k == g and x is not None and x == x]
        assert got[g][0] == len(v) and got[g][1] == pytest.approx(list(np.quantile(v, probs)), rel=1e-12)
    assert statistics.exact_quantiles(df.limit(0), ["g"], "v", probs).count() == 0

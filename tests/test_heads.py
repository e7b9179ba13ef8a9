"""Heads against naive refits on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.functions.hashing import draw
from lodeweave.operators import heads, order


def table(spark, n=160, d=3, seed=1):
    """Vectors, two learnable endpoints with gaps, one of a single class, one without labels, a number to predict."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 3, 0.2][:d] + [0, 1000, -5][:d]
    z = (x - x.mean(0)) / x.std(0)
    noise = rng.normal(size=n)
    a = (z[:, 0] + z[:, 1] + noise > 0).astype(float)
    b = (z[:, 0] - z[:, 2] + noise > 0.5).astype(float)
    y = x @ [2.0, 0.1, -1.0][:d] + noise
    rows = []
    for i in range(n):
        rows.append((i, [float(v) for v in x[i]], None if i % 5 == 0 else float(a[i]), float("nan") if i % 7 == 0 else float(b[i]), 1.0 if i % 2 else None, None, float(y[i])))
    return x, rows, spark.createDataFrame(rows, "id long, x array<double>, a double, b double, one double, none double, y double")


LABELS = ["a", "b", "one", "none"]


def logistic(x, y, penalty):
    """Newton with tiny damping on one model."""
    a = np.column_stack([np.ones(len(x)), x])
    w, pull = np.zeros(a.shape[1]), penalty * np.r_[0, np.ones(x.shape[1])]
    for _ in range(200):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(pull), a.T @ (p - y) + pull * w)
    return w


def auroc(y, s):
    good, bad = s[y > 0], s[y <= 0]
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) if len(good) and len(bad) else None


def test_logistic_grid_equals_a_naive_refit(spark):
    x, rows, df = table(spark)
    df = heads.stratified_folds(df.repartition(4), LABELS, 4, draw(3, "fold", "id"), ["id"])
    fold = {r.id: r.fold for r in df.collect()}
    f = np.array([fold[i] for i in range(len(rows))])
    y = np.array([[np.nan if v is None else v for v in r[2:6]] for r in rows])
    got = heads.logistic_grid(df, "x", LABELS, [0.001, 0.1, 10.0], "fold")
    z = (x - x.mean(0)) / x.std(0)

    def naive(c, train, test, j):
        m = train & ~np.isnan(y[:, j])
        if len(set(y[m, j])) < 2:
            return np.full(test.sum(), y[m, j][0] if m.any() else 0.5)
        w = logistic(z[m], y[m, j], 1 / c)
        return 1 / (1 + np.exp(-(w[0] + z[test] @ w[1:])))

    scores = {}
    for c in (0.001, 0.1, 10.0):
        means = []
        for k in range(4):
            held = f == k
            found = [auroc(y[held, j][~np.isnan(y[held, j])], naive(c, ~held, held, j)[~np.isnan(y[held, j])]) for j in range(4)]
            means.append(np.mean([v for v in found if v is not None]))
        scores[c] = np.mean(means)
        assert got.scores[c] == pytest.approx(scores[c], abs=1e-9)
    assert got.penalty == max(scores, key=scores.get) and got.constants == {"one": 1.0, "none": 0.5}
    out = {r.id: r for r in heads.predicted(df, "x", got, LABELS).collect()}
    every = np.ones(len(rows), bool)
    for j, name in enumerate(LABELS):
        assert [out[i][f"p_{name}"] for i in range(len(rows))] == pytest.approx(list(naive(got.penalty, every, every, j)), abs=1e-6)


def test_folds_are_stratified(spark):
    _, rows, df = table(spark, 163)
    got = heads.stratified_folds(df, LABELS[:2], 5, draw(1, "fold", "id"), ["id"]).collect()
    for kind in (True, False):
        n = [sum(r.fold == k and (max(r.a or 0, 0 if r.b is None or np.isnan(r.b) else r.b) > 0) == kind for r in got) for k in range(5)]
        assert max(n) - min(n) <= 1
    again = heads.stratified_folds(df.repartition(6), LABELS[:2], 5, draw(1, "fold", "id"), ["id"]).collect()
    assert {r.id: r.fold for r in got} == {r.id: r.fold for r in again} and len(got) == 163
    # one kind only: all rows are dealt out in turn
    one = [r.fold for r in heads.stratified_folds(df, ["none"], 5, draw(1, "fold", "id"), ["id"]).collect()]
    assert sorted(map(one.count, range(5))) == [32, 32, 33, 33, 33]


def test_ridge_grid_equals_dense_solves(spark):
    x, rows, df = table(spark)
    df = df.withColumn("fold", (F.col("id") % 5).cast("int")).union(df.limit(1).select(F.lit(900).cast("long"), F.lit(None).cast("array<double>"), "a", "b", "one", "none", "y", F.lit(0)))
    y, f = np.array([r[6] for r in rows]), np.arange(len(rows)) % 5

    def fit(m, alpha):
        c = x[m] - x[m].mean(0)
        w = np.linalg.solve(c.T @ c + alpha * np.eye(3), c.T @ (y[m] - y[m].mean()))
        return y[m].mean() - x[m].mean(0) @ w, w

    def r2(m, b, w):
        return 1 - ((y[m] - b - x[m] @ w) ** 2).sum() / ((y[m] - y[m].mean()) ** 2).sum()

    alphas = [0.01, 1.0, 100.0, 10000.0]
    scores = {a: np.mean([r2(f == k, *fit(f != k, a)) for k in range(5)]) for a in alphas}
    got = heads.ridge_grid(df, "x", "y", alphas, "fold")
    best = max(scores, key=scores.get)
    b, w = fit(np.ones(len(x), bool), best)
    assert got.alpha == best and got.score == pytest.approx(scores[best], abs=1e-8) and got.weights == pytest.approx([b, *w], rel=1e-6)
    rows_r2 = heads.ridge_r2(df, "x", ["y", "none", "a"], F.col("id") % 4 == 0, 1.0)
    test = np.arange(len(x)) % 4 == 0
    assert rows_r2[0][0] == "y" and rows_r2[0][2] == pytest.approx(r2(test, *fit(~test, 1.0)), abs=1e-9)
    assert rows_r2[-1][0] == "none" and np.isnan(rows_r2[-1][2])


def test_grouped_auroc_equals_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(rng.integers(0, 2)), float(rng.integers(0, 9)) / 8) for g in range(4) for _ in range(60)] + [(9, 1.0, 0.5)]
    got = {r.g: r.auroc for r in heads.grouped_auroc(spark.createDataFrame(rows, "g int, y double, s double"), ["g"], "y", "s", 4).collect()}
    for g in range(4):
        y, s = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        assert got[g] == pytest.approx(auroc(y, s))
    assert got[9] is None


def test_places_equal_a_sort(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    rows = order.placed(df.withColumn("u", draw(1, "x", "id")), ["g"], F.col("u"), ["id"], parts=8).collect()
    for g in (None, 1, 2):
        inside = sorted((r for r in rows if r.g == g), key=lambda r: r.u)
        assert [r.place for r in inside] == list(range(len(inside)))
    flat = order.placed(df, [], draw(1, "x", "id"), ["id"]).collect()
    assert sorted(r.place for r in flat) == list(range(500))


def test_forest_learns_and_keeps_constants(spark):
    x, rows, df = table(spark, 120)
    df = heads.stratified_folds(df, LABELS, 2, draw(3, "fold", "id"), ["id"])
    leaf, score, models = heads.forest_grid(df, "x", ["a", "one", "none"], [1, 60], "fold", trees=10)
    assert leaf == 1 and score > 0.6 and models["one"] == 1.0 and models["none"] == 0.5
    with pytest.raises(ValueError):
        heads.stratified_folds(df, ["a"], 1, draw(1, "f", "id"), ["id"])
    with pytest.raises(ValueError):
        heads.logistic_grid(df.limit(0), "x", ["a"], [1.0], "fold")

"""Prediction heads over vectors: logistic, ridge and forest, one model an endpoint, chosen by cross-validation.

Models are small and rows are many, so a grid is never fitted model by model. Ridge models of all penalties and folds
come from one pass of sums. Logistic models of all endpoints, penalties and folds take their Newton steps together: one
pass a step, a dozen passes a grid. What reaches the driver are sums, whose size depends on the number of columns and of
models, not of rows.

Missing labels are nulls or NaN; an endpoint is fitted on the rows that have one. With labels of one class it gets the
constant predictor of that class, without labels the constant 0.5.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.operators.order import placed

#: The fold of models that are fitted on all rows.
ALL = -1


def finite(label: str) -> Column:
    """A label as double; null where it is missing, NaN or infinite."""
    x = F.col(label).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def stratified_folds(df: DataFrame, labels: list[str], folds: int, u: Column, ties: list[str]) -> DataFrame:
    """df with fold: rows with a positive label, and those with none, are dealt out in turn in the order of the draw u.

    Each fold holds the same number of both, give or take one. Where all rows are of one kind this deals out all rows.
    """
    if folds < 2:
        raise ValueError("cross-validation needs two folds")
    positive = F.greatest(*[F.coalesce(finite(y), F.lit(0.0)) for y in labels], F.lit(0.0)) > 0
    rows = placed(df.withColumn("__positive", positive), ["__positive"], u, ties, "__place")
    return rows.withColumn("fold", (F.col("__place") % folds).cast("int")).drop("__positive", "__place")


def endpoint_constants(df: DataFrame, labels: list[str]) -> DataFrame:
    """(endpoint, n, constant): rows with a label, and what is predicted without a model; null where there are both classes."""
    one = df.select(F.explode(F.array(*[F.struct(F.lit(y).alias("endpoint"), finite(y).alias("y")) for y in labels])).alias("e")).select("e.*")
    n, p = F.count("y"), F.sum((F.col("y") > 0).cast("long"))
    return one.groupBy("endpoint").agg(n.alias("n"), F.when(n == 0, 0.5).when(p == 0, 0.0).when(p == n, 1.0).alias("constant"))


def _rows(batch: pa.RecordBatch, labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features with a leading one, labels with NaN, folds) of the columns fold, features, labels..."""
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    y = np.column_stack([batch.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(labels)])
    return np.column_stack([np.ones(len(x)), x]), y, batch.column(0).to_numpy(zero_copy_only=False)


def _needed(df: DataFrame, features: str, labels: list[str], fold: str | None) -> DataFrame:
    """fold, features, labels of the rows with features: all components there and finite."""
    x = F.col(features).cast("array<double>")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return df.where(good).select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), x.alias("x"), *[finite(y).alias(f"y{k}") for k, y in enumerate(labels)])


def _summed(df: DataFrame, part) -> dict[int, np.ndarray]:
    """Sums of part(batch) -> {key: array} over all batches, by key.

    Each task adds up its own arrays; those of one key are added batch by batch, 16 tasks' worth of keys at a time, so
    no task holds more than one array of a key.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                for k, v in part(some).items():
                    total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(total), pa.int32()), "sums": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, 0.0
        for batch in batches:
            for k, v in zip(batch.column("key").to_pylist(), batch.column("sums"), strict=True):
                key, total = k, total + v.values.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int32()), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "key int, sums array<double>"
    parts = df.mapInArrow(local, schema).withColumn("salt", F.spark_partition_id() % 16)
    once = parts.groupBy("key", "salt").applyInArrow(added, schema)
    return {r["key"]: np.array(r["sums"]) for r in once.groupBy("key").applyInArrow(added, schema).collect()}


@dataclass
class Sums:
    """n, sums and products of (1, x - about, y - about) over rows, as one matrix: relative, so that large offsets don't cancel."""

    m: np.ndarray
    about: np.ndarray

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.m - other.m, self.about)

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and population deviations of the features."""
        mean = self.m[0, 1:-1] / self.m[0, 0]
        return mean + self.about[:-1], np.sqrt(np.maximum(np.diag(self.m)[1:-1] / self.m[0, 0] - mean**2, 0))

    def ridge(self, alpha: float) -> np.ndarray:
        """(intercept, weights) with the least squared error and alpha times the squared weights."""
        n, s = self.m[0, 0], self.m[0, 1:]
        c = self.m[1:, 1:] - np.outer(s, s) / n
        w = np.linalg.solve(c[:-1, :-1] + alpha * np.eye(len(c) - 1), c[:-1, -1])
        return np.concatenate([[(s[-1] - s[:-1] @ w) / n + self.about[-1] - self.about[:-1] @ w], w])

    def r2(self, w: np.ndarray) -> float:
        """R² of a model on these rows; NaN without variance."""
        v = np.concatenate([[w[0] + self.about[:-1] @ w[1:] - self.about[-1]], w[1:], [-1.0]])
        spread = self.m[-1, -1] - self.m[0, -1] ** 2 / self.m[0, 0] if self.m[0, 0] else 0.0
        return float(1 - (v @ self.m @ v) / spread) if spread > 1e-12 * self.m[-1, -1] else float("nan")


def product_sums(df: DataFrame, features: str, labels: list[str], fold: str | None = None) -> dict[tuple[str, int], Sums]:
    """Sums by (label, fold), over rows with that label, in one pass. Fold 0 holds all rows where there is no column for it.

    Values are taken relative to the means of a few rows; which rows doesn't change a result but by rounding.
    """
    k = len(labels)
    data = _needed(df, features, labels, fold)
    few = data.limit(1000)
    means = few.select(F.posexplode(F.concat("x", F.array(*[f"y{j}" for j in range(k)])))).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()
    if not means:
        return {}
    means = np.array([r["m"] or 0.0 for r in means])
    about, about_y = means[:-k], means[-k:]

    def part(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x, y, folds = _rows(batch, k)
        x[:, 1:] -= about
        out = {}
        for f in np.unique(folds):
            for j in range(k):
                at = (folds == f) & ~np.isnan(y[:, j])
                v = np.column_stack([x[at], y[at, j] - about_y[j]])
                out[int(f) * k + j] = (v.T @ v).ravel()
        return out

    size = len(about) + 2
    return {(labels[key % k], key // k): Sums(flat.reshape(size, size), np.append(about, about_y[key % k])) for key, flat in _summed(data, part).items()}


@dataclass
class Ridge:
    """For one label: the penalty with the best mean R² over folds, the first on ties, and the model refitted on all rows."""

    alpha: float
    score: float
    weights: np.ndarray
    scores: dict[float, float]


def ridge_grid(df: DataFrame, features: str, label: str, alphas: list[float], fold: str) -> Ridge:
    """Chooses alpha by cross-validation and fits, from one pass of sums: a fold's model comes from all sums without its own."""
    by_fold = {f: s for (_, f), s in product_sums(df, features, [label], fold).items() if s.m[0, 0] > 0}
    if len(by_fold) < 2:
        raise ValueError("cross-validation needs labelled rows in two folds")
    every = Sums(sum(s.m for s in by_fold.values()), next(iter(by_fold.values())).about)
    scores = {}
    for alpha in alphas:
        found = [held.r2((every - held).ridge(alpha)) for held in by_fold.values()]
        found = [x for x in found if np.isfinite(x)]
        scores[alpha] = float(np.mean(found)) if found else float("nan")
    best = max(alphas, key=lambda a: scores[a] if np.isfinite(scores[a]) else -np.inf)
    return Ridge(best, scores[best], every.ridge(best), scores)


def ridge_r2(df: DataFrame, features: str, labels: list[str], test: Column, alpha: float = 1.0) -> list[tuple[str, int, float]]:
    """(label, n_test, R² on the rows where `test` holds of a model fitted on the others), best first, then by name; one pass."""
    sums = product_sums(df.withColumn("__test", test.cast("int")), features, labels, "__test")
    out = []
    for y in labels:
        train, held = sums.get((y, 0)), sums.get((y, 1))
        ok = train is not None and held is not None and train.m[0, 0] > 0
        out.append((y, int(held.m[0, 0]) if held else 0, held.r2(train.ridge(alpha)) if ok else float("nan")))
    return sorted(out, key=lambda r: (np.isnan(r[2]), -r[2] if np.isfinite(r[2]) else 0.0, r[0]))


@dataclass
class Logistic:
    """Models of endpoints: weights (intercept first, over scaled features) or a constant; how they were chosen."""

    penalty: float
    score: float
    mean: np.ndarray
    sd: np.ndarray
    weights: dict[str, np.ndarray]
    constants: dict[str, float]
    scores: dict[float, float] = field(default_factory=dict)


def _newton(data: DataFrame, labels: int, mean: np.ndarray, sd: np.ndarray, models: list[tuple[int, float, int]], tolerance: float = 1e-7, most: int = 60) -> np.ndarray:
    """Weights of models (endpoint, penalty, fold left out): least loss and half the penalty times the squared weights.

    Damped Newton steps for all models at once; a step that doesn't lower the loss is halved.
    """
    d = len(mean) + 1
    keep = np.concatenate([[0.0], np.ones(d - 1)])  # the intercept bears no penalty
    now, step = np.zeros((len(models), d)), np.zeros((len(models), d))
    loss = np.full(len(models), np.inf)
    open_ = np.ones(len(models), bool)
    for _ in range(most):
        trial = now + step
        left = np.flatnonzero(open_)

        def part(batch: pa.RecordBatch, trial=trial, left=left) -> dict[int, np.ndarray]:
            x, y, folds = _rows(batch, labels)
            x[:, 1:] = (x[:, 1:] - mean) / sd
            out = {}
            for m in left.tolist():
                j, _, without = models[m]
                at = (folds != without) & ~np.isnan(y[:, j])
                a, z = x[at], y[at, j] > 0
                t = a @ trial[m]
                p = np.exp(-np.logaddexp(0, -t))
                out[m] = np.concatenate([[np.logaddexp(0, np.where(z, -t, t)).sum()], a.T @ (p - z), ((a * (p * (1 - p))[:, None]).T @ a).ravel()])
            return out

        for m, sums in _summed(data, part).items():
            pull = models[m][1] * keep
            value = sums[0] + (pull * trial[m] ** 2).sum() / 2
            if value > loss[m] + 1e-9 * max(1.0, abs(loss[m])):
                step[m] /= 2
                open_[m] = np.abs(step[m]).max() > 1e-12
                continue
            now[m], loss[m] = trial[m], value
            slope = sums[1 : d + 1] + pull * now[m]
            open_[m] = np.abs(slope).max() > tolerance * max(1.0, value)
            step[m] = -np.linalg.solve(sums[d + 1 :].reshape(d, d) + np.diag(pull + 1e-12), slope) if open_[m] else 0.0
        if not open_.any():
            break
    return now


def logistic_probability(x: Column, mean: np.ndarray, sd: np.ndarray, weights: np.ndarray) -> Column:
    """The probability that a model gives; x is an array of doubles."""
    w = weights[1:] / sd
    bias = float(weights[0] - (w * mean).sum())
    parts = F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b)
    t = F.aggregate(parts, F.lit(bias), lambda a, b: a + b)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-t))


def grouped_auroc(df: DataFrame, by: list[str], truth: str, score: str, parts: int = 1024) -> DataFrame:
    """(by, auroc): the share of pairs of a positive and a negative row in which the positive scores higher, ties half; null with one class.

    score lies in [0, 1]. Equal scores are counted first; ranges of scores are summed in order, so no task sorts a group.
    """
    part = F.least(F.floor(F.col(score) * parts), F.lit(parts - 1)).cast("int")
    tied = df.groupBy(*by, part.alias("part"), F.col(score).alias("s")).agg(F.sum((F.col(truth) > 0).cast("long")).alias("p"), F.sum((F.col(truth) <= 0).cast("long")).alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = tied.withColumn("lower", F.coalesce(F.sum("n").over(earlier.partitionBy(*by, "part").orderBy("s")), F.lit(0)))
    sums = inside.groupBy(*by, "part").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("lower") + F.col("n") / 2)).alias("won"))
    before = F.coalesce(F.sum("n").over(earlier.partitionBy(*by).orderBy("part")), F.lit(0))
    total = sums.withColumn("won", F.col("won") + F.col("p") * before).groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(*by, (F.col("won") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auroc"))


def logistic_grid(df: DataFrame, features: str, labels: list[str], strengths: list[float], fold: str) -> Logistic:
    """One L2 logistic model an endpoint, on features scaled by their mean and deviation; the strength C chosen by cross-validation.

    A candidate's score is the mean over folds of the mean AUROC of the endpoints that have both classes in the fold;
    the first of equal candidates wins, the first of all if none has a score. Models of all folds and candidates, and
    those refitted on all rows, are fitted together; the features are scaled by all rows.
    """
    k = len(labels)
    data = _needed(df, features, labels, fold)
    sums = product_sums(df.withColumn("__all", F.lit(1.0)), features, ["__all"])
    if not sums:
        raise ValueError("no row has features")
    mean, sd = sums["__all", 0].moments()
    sd[sd <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0

    seen = data.select("fold", F.posexplode(F.array(*[f"y{j}" for j in range(k)])).alias("j", "y")).where("y IS NOT NULL")
    classes = {(r["j"], r["fold"]): (r["p"], r["n"]) for r in seen.groupBy("j", "fold").agg(F.sum((F.col("y") > 0).cast("long")).alias("p"), F.sum((F.col("y") <= 0).cast("long")).alias("n")).collect()}
    folds = sorted({r["fold"] for r in data.select("fold").distinct().collect()})

    def constant(j: int, without: int) -> float | None:
        p, n = (sum(v[c] for (i, f), v in classes.items() if i == j and f != without) for c in range(2))
        return 0.5 if p + n == 0 else 1.0 if n == 0 else 0.0 if p == 0 else None

    fixed = {(j, f): constant(j, f) for j in range(k) for f in [*folds, ALL]}
    models = [(j, 1.0 / c, f) for c, j, f in itertools.product(strengths, range(k), [*folds, ALL]) if fixed[j, f] is None]
    weights = dict(zip(models, _newton(data, k, mean, sd, models), strict=True)) if models else {}

    def score_of(c: float, j: int, f: int) -> Column:
        return F.lit(fixed[j, f]) if fixed[j, f] is not None else logistic_probability(F.col("x"), mean, sd, weights[j, 1.0 / c, f])

    options = []
    for (i, c), j in itertools.product(enumerate(strengths), range(k)):
        score = F.lit(None).cast("double")
        for f in folds:
            score = F.when(F.col("fold") == f, score_of(c, j, f)).otherwise(score)
        options.append(F.struct(F.lit(i).alias("c"), F.lit(j).alias("j"), F.col(f"y{j}").alias("y"), score.alias("s")))
    long = data.select("fold", F.explode(F.array(*options)).alias("o")).select("fold", "o.*").where("y IS NOT NULL")
    found = {(r["c"], r["fold"], r["j"]): r["auroc"] for r in grouped_auroc(long, ["c", "fold", "j"], "y", "s").collect()}
    best, scores = None, {}
    for i, c in enumerate(strengths):
        by_fold = [[found.get((i, f, j)) for j in range(k)] for f in folds]
        means = [np.mean([x for x in row if x is not None]) for row in by_fold if any(x is not None for x in row)]
        scores[c] = float(np.mean(means)) if means else float("nan")
        if np.isfinite(scores[c]) and (best is None or scores[c] > scores[best]):
            best = c
    chosen = strengths[0] if best is None else best
    return Logistic(
        chosen, scores[chosen], mean, sd,
        {labels[j]: weights[j, 1.0 / chosen, ALL] for j in range(k) if fixed[j, ALL] is None},
        {labels[j]: fixed[j, ALL] for j in range(k) if fixed[j, ALL] is not None},
        scores,
    )


def predicted(df: DataFrame, features: str, model: Logistic, labels: list[str]) -> DataFrame:
    """df with p_<label> for each endpoint: its probability; null where the row has no features, the constant for constant endpoints."""
    x = F.col(features).cast("array<double>")
    return df.select("*", *[(F.lit(model.constants[y]) if y in model.constants else logistic_probability(x, model.mean, model.sd, model.weights[y])).alias(f"p_{y}") for y in labels])


def forest_grid(df: DataFrame, features: str, labels: list[str], leaves: list[int], fold: str, trees: int = 500, depth: int = 10, seed: int = 0) -> tuple[int, float, dict]:
    """(least rows of a leaf, score, models by endpoint): forests by entropy, one an endpoint, chosen as `logistic_grid` does.

    An endpoint's value is a fitted model or the constant of its class. Trees grow on the cluster, all of a forest at
    once; a forest is fitted for each candidate, endpoint and fold.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = _needed(df, features, labels, fold).withColumn("v", array_to_vector("x")).drop("x").cache()
    folds = sorted({r["fold"] for r in data.select("fold").distinct().collect()})

    def fitted(j: int, leaf: int, without: int):
        rows = data.where((F.col("fold") != without) & F.col(f"y{j}").isNotNull()).select("v", (F.col(f"y{j}") > 0).cast("double").alias("y"))
        p, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count("*")).first()
        if p in (0, n):
            return 0.5 if n == 0 else p / n
        return RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=trees, impurity="entropy", minInstancesPerNode=leaf, maxDepth=depth, seed=seed).fit(rows)

    def scored(rows: DataFrame, j: int, model) -> DataFrame:
        if isinstance(model, float):
            return rows.withColumn("s", F.lit(model))
        return model.transform(rows.withColumnRenamed("v", model.getFeaturesCol())).withColumn("s", vector_to_array("probability")[1])

    try:
        best, top, scores = None, float("nan"), {}
        for leaf in leaves:
            means = []
            for f in folds:
                held = data.where(F.col("fold") == f)
                found = []
                for j in range(len(labels)):
                    rows = scored(held.where(F.col(f"y{j}").isNotNull()).select("v", F.col(f"y{j}").alias("y")), j, fitted(j, leaf, f))
                    r = grouped_auroc(rows.withColumn("g", F.lit(0)), ["g"], "y", "s").first()
                    found += [r["auroc"]] if r and r["auroc"] is not None else []
                means += [np.mean(found)] if found else []
            scores[leaf] = float(np.mean(means)) if means else float("nan")
            if np.isfinite(scores[leaf]) and (best is None or scores[leaf] > top):
                best, top = leaf, scores[leaf]
        chosen = leaves[0] if best is None else best
        return chosen, scores[chosen], {y: fitted(j, chosen, ALL) for j, y in enumerate(labels)}
    finally:
        data.unpersist()


def head(name: str, task: str):
    """The fitting function of a head: logistic or ridge for `ridge`, by task, and the forest for `rf`; unknown ones are an error.

    Nearest neighbours have nothing to fit: they are `similarity.nearest`. They are refused for data sets of many
    endpoints (`knn_allowed`).
    """
    known = {("ridge", "classification"): logistic_grid, ("ridge", "regression"): ridge_grid, ("rf", "classification"): forest_grid}
    if (name, task) not in known:
        raise ValueError(f"no head {name} for {task}")
    return known[name, task]


def knn_allowed(dataset: str) -> bool:
    """Fixed value: the one data set for which neighbours are not tried."""
    return "muv" not in dataset.lower()

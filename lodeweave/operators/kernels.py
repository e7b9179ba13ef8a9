"""Kernel ridge regression over Tanimoto similarities, its choice by neighbourhoods, and what corrects predictions.

A kernel matrix of all training rows grows with their square. So models are spanned by a stated set of landmarks of
bounded number: similarities of rows with landmarks are summed up in one pass into a matrix of the landmarks' size, which
is solved on the driver for any number of penalties. With all training rows as landmarks this is exact kernel ridge
regression; fewer give the best model that the landmarks span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.heads import _summed
from lodeweave.operators.statistics import exact_quantiles

#: The most landmarks: the driver solves systems of this size, tasks add up matrices of its square.
LANDMARKS = 512


def similarities(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Sums of the smaller counts by sums of the larger, rows of x by rows of z; 0 where both are empty."""
    low = np.zeros((len(x), len(z)))
    for d in range(x.shape[1]):
        low += np.minimum(x[:, d, None], z[None, :, d])
    high = x.sum(1)[:, None] + z.sum(1)[None, :] - low
    return np.divide(low, high, out=np.zeros_like(low), where=high > 0)


@dataclass
class Landmarks:
    keys: list[str]
    vectors: np.ndarray


def landmarks(df: DataFrame, key: str, features: str, u: Column, most: int = LANDMARKS) -> Landmarks:
    """The rows with the smallest draws u, `most` at most: what comes to the driver is bounded by that number."""
    rows = df.where(F.col(features).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(features).cast("array<double>").alias("x"), u.alias("u"))
    found = rows.orderBy("u", "key").limit(most).collect()
    return Landmarks([r["key"] for r in found], np.array([r["x"] for r in found], float).reshape(len(found), -1))


@dataclass
class KernelRidge:
    vectors: np.ndarray
    mean: float
    alpha: np.ndarray


@dataclass
class _Sums:
    """Over rows with weights w, similarities k and targets y: n, sums of w and wy, of wk, wky and wkk'."""

    flat: np.ndarray

    def solved(self, basis: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
        """(mean, alpha) with the least weighted squared error and penalty times the model's norm; the mean is weighted."""
        m = len(basis)
        _, w, wy = self.flat[:3]
        wk, wky, wkk = self.flat[3 : 3 + m], self.flat[3 + m : 3 + 2 * m], self.flat[3 + 2 * m :].reshape(m, m)
        mean = wy / w
        return mean, basis @ np.linalg.solve(basis.T @ wkk @ basis + penalty * np.eye(basis.shape[1]), basis.T @ (wky - mean * wk))


def _basis(z: np.ndarray) -> np.ndarray:
    """What turns similarities with landmarks into features of unit norm; directions that landmarks repeat are dropped."""
    value, vector = np.linalg.eigh(similarities(z, z))
    kept = value > 1e-10 * value[-1]
    return vector[:, kept] / np.sqrt(value[kept])


def _training(df: DataFrame, key: str, features: str, target: str, noise: str) -> DataFrame:
    y, d = F.col(target).cast("double"), F.col(noise).cast("double")
    return df.where(F.col(features).isNotNull() & (F.abs(y) < float("inf")) & (d > 0)).select(F.col(key).cast("string").alias("key"), F.col(features).cast("array<double>").alias("x"), y.alias("y"), d.alias("d"))


def _unpacked(batch: pa.RecordBatch, z: np.ndarray):
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    y, d = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
    return np.array(batch.column(0).to_pylist(), object), similarities(x, z), y, 1 / d


def _sums(rows: DataFrame, marks: Landmarks, anchors: list[int], least: float) -> dict[int, _Sums]:
    """Sums over all rows (key -1), and over the neighbourhood of each anchor: rows alike enough, without itself."""
    z, names = marks.vectors, marks.keys

    def part(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        keys, k, y, w = _unpacked(batch, z)
        out = {}
        for f, at in [(-1, np.ones(len(y), bool)), *((a, (k[:, a] >= least) & (keys != names[a])) for a in anchors)]:
            kk, yy, ww = k[at], y[at], w[at]
            if len(yy):
                kw = kk * ww[:, None]
                out[f] = np.concatenate([[len(yy), ww.sum(), (ww * yy).sum()], kw.sum(0), kw.T @ yy, (kw.T @ kk).ravel()])
        return out

    return {f: _Sums(s) for f, s in _summed(rows, part).items()}


def kernel_ridge(df: DataFrame, key: str, features: str, target: str, noise: str, penalty: float, marks: Landmarks) -> KernelRidge:
    """Fits on the rows with features, a finite target and noise above 0; a row's noise multiplies the penalty, its inverse weighs the mean."""
    found = _sums(_training(df, key, features, target, noise), marks, [], 1.0)
    if -1 not in found:
        raise ValueError("no row to fit on")
    mean, alpha = found[-1].solved(_basis(marks.vectors), penalty)
    return KernelRidge(marks.vectors, mean, alpha)


def predicted(features: Column, model: KernelRidge, low: float | None = None, high: float | None = None) -> Column:
    """The model's prediction, clipped to [low, high] where given; null without features."""
    z, mean, alpha = model.vectors, model.mean, model.alpha

    @F.pandas_udf("double")
    def predict(x: pd.Series) -> pd.Series:
        there = x.notna()
        out = pd.Series(np.nan, index=x.index)
        if there.any():
            out[there] = np.clip(similarities(np.stack(x[there].to_numpy()), z) @ alpha + mean, low, high)
        return out

    return F.nanvl(predict(features.cast("array<double>")), F.lit(None).cast("double"))


def neighbourhood_cv(df: DataFrame, key: str, features: str, target: str, noise: str, penalties: list[float], marks: Landmarks, anchors: list[str], least: float = 0.4, hood: int = 3) -> list[tuple[float, float, float, int]]:
    """(penalty, mean MAE, worst MAE, folds), best mean first, in the order given on ties.

    Each anchor (keys of landmarks) makes a fold: rows as alike as `least` to it, without itself, are held out and
    predicted by a model of all others; folds of fewer than `hood` rows don't count. Two passes, whatever the number of
    folds and penalties: sums of all rows less those of the neighbourhood give the model, then errors are added up.
    """
    rows = _training(df, key, features, target, noise)
    places = [marks.keys.index(a) for a in anchors]
    sums = _sums(rows, marks, places, least)
    folds = [a for a in places if a in sums and sums[a].flat[0] >= hood and sums[-1].flat[0] > sums[a].flat[0]]
    if not folds:
        return []
    z, names, basis = marks.vectors, marks.keys, _basis(marks.vectors)
    models = {a: [_Sums(sums[-1].flat - sums[a].flat).solved(basis, p) for p in penalties] for a in folds}

    def part(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        keys, k, y, _ = _unpacked(batch, z)
        out = {}
        for a in folds:
            at = (k[:, a] >= least) & (keys != names[a])
            if at.any():
                out[a] = np.array([np.abs(k[at] @ alpha + mean - y[at]).sum() for mean, alpha in models[a]])
        return out

    errors = {a: s / sums[a].flat[0] for a, s in _summed(rows, part).items()}
    out = [(p, float(np.mean([e[i] for e in errors.values()])), float(max(e[i] for e in errors.values())), len(errors)) for i, p in enumerate(penalties)]
    return sorted(out, key=lambda r: r[1])


def cluster_offsets(df: DataFrame, features: str, residual: str, anchors: Landmarks, least: float, shrink: float) -> dict[str, tuple[int, float]]:
    """anchor -> (rows, offset): the median residual of the rows as alike as `least`, times n / (n + shrink); anchors with two rows or more.

    A row becomes one for each anchor that it is like; medians come from counts by ranges of values, so an anchor that
    most rows are like is spread over tasks. Anchors are a stated set.
    """
    z, names = anchors.vectors, anchors.keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            i, a = np.nonzero(similarities(x, z) >= least)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(a, pa.int32()), "r": batch.column(1).take(pa.array(i))})

    r = F.col(residual).cast("double")
    near = df.where(F.col(features).isNotNull() & (F.abs(r) < float("inf"))).select(F.col(features).cast("array<double>").alias("x"), r.alias("r")).mapInArrow(run, "anchor int, r double")
    found = exact_quantiles(near, ["anchor"], "r", [0.5]).collect()
    return {names[q["anchor"]]: (q["n"], q["n"] / (q["n"] + shrink) * q["quantiles"][0]) for q in found if q["n"] >= 2}


def with_offsets(prediction: Column, features: Column, anchors: Landmarks, offsets: dict[str, tuple[int, float]], smallest: float) -> Column:
    """The prediction and the mean of the anchors' offsets weighed by similarity; offsets smaller than `smallest` count as 0."""
    z = anchors.vectors
    given = [offsets.get(k, (0, 0.0))[1] for k in anchors.keys]
    shift = np.array([o if abs(o) >= smallest else 0.0 for o in given])

    @F.pandas_udf("double")
    def add(p: pd.Series, x: pd.Series) -> pd.Series:
        out, there = p.astype(float).copy(), x.notna()
        if there.any() and shift.any():
            k = similarities(np.stack(x[there].to_numpy()), z)
            total = k.sum(1)
            out[there] += np.divide(k @ shift, total, out=np.zeros(len(k)), where=total > 0)
        return out

    return add(prediction, features.cast("array<double>"))


def blend_errors(df: DataFrame, a: Column, b: Column, target: Column, weights: list[float]) -> DataFrame:
    """(weight, mae) of weight * a + (1 - weight) * b, in one pass over the rows where all three are there."""
    error = [F.avg(F.abs(w * a + (1 - w) * b - target)).alias(f"e{i}") for i, w in enumerate(weights)]
    one = df.where(a.isNotNull() & b.isNotNull() & target.isNotNull()).agg(*error)
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.col(f"e{i}").alias("mae")) for i, w in enumerate(weights)])).alias("x")).select("x.*")


@dataclass
class Huber:
    slope: float
    intercept: float
    scale: float
    rounds: int


def huber_line(df: DataFrame, x: Column, y: Column, epsilon: float = 1.35, tolerance: float = 1e-10, most: int = 200) -> Huber:
    """The robust line y = slope x + intercept: squared loss up to epsilon scales, linear beyond, the scale fitted along.

    Each round adds up rows inside and outside by the line so far: weighted least squares gives the next line, and the
    squared errors inside by the rows left, n - epsilon^2 times those outside, the next scale.
    """
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    first = rows.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("c"), F.var_pop("y").alias("vy")).first()
    if not first["n"] or not first["vx"]:
        raise ValueError("a line needs rows with different x")
    mx, my = first["mx"], first["my"]
    slope, level = first["c"] / first["vx"], 0.0  # about the means
    scale = max(first["vy"] - slope * first["c"], 0.0) ** 0.5
    for k in range(most):
        if scale <= tolerance * first["vy"] ** 0.5:
            return Huber(slope, my + level - slope * mx, scale, k)
        dx, dy = F.col("x") - mx, F.col("y") - my
        r = F.abs(dy - slope * dx - level)
        inside = r <= epsilon * scale
        w = F.when(inside, 1.0).otherwise(epsilon * scale / r)
        s = rows.agg(F.sum(w).alias("w"), F.sum(w * dx).alias("x"), F.sum(w * dy).alias("y"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dx * dy).alias("xy"), F.sum((~inside).cast("long")).alias("out"), F.sum(F.when(inside, r * r).otherwise(0.0)).alias("rr")).first()
        down = s["xx"] - s["x"] ** 2 / s["w"]
        new_slope = (s["xy"] - s["x"] * s["y"] / s["w"]) / down if down > 0 else slope
        new_level = (s["y"] - new_slope * s["x"]) / s["w"]
        left = first["n"] - epsilon**2 * s["out"]
        new_scale = (s["rr"] / left) ** 0.5 if left > 0 else scale / 2
        change = max(abs(new_slope - slope) * first["vx"] ** 0.5, abs(new_level - level), abs(new_scale - scale))
        slope, level, scale = new_slope, new_level, new_scale
        if change <= tolerance * first["vy"] ** 0.5:
            break
    return Huber(slope, my + level - slope * mx, scale, k + 1)

"""Evaluation metrics over long tables of (endpoint, y_true, y_score), without collecting a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.order import running_by_value


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def _by_score(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of positives and negatives at each distinct score: what ranks need, and no more rows than scores."""
    rows = df.where(finite(F.col("y_true").cast("double")) & finite(F.col("y_score").cast("double")))
    return rows.groupBy(*by, "y_score").agg(F.sum((F.col("y_true") > 0).cast("long")).alias("pos"), F.sum((F.col("y_true") <= 0).cast("long")).alias("neg"))


def auroc(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, auroc): rank-sum with shared ranks for ties; groups with one class give no row."""
    s = running_by_value(_by_score(df, by), by, "y_score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return s.groupBy(*by).agg(wins.alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).where("p > 0 AND n > 0").select(*by, (F.col("w") / F.col("p") / F.col("n")).alias("auroc"))


def mean_auroc(df: DataFrame, endpoint: str) -> DataFrame:
    """The unweighted mean over endpoints that have both classes; null if there is none."""
    return auroc(df, [endpoint]).agg(F.avg("auroc").alias("mean_auroc"), F.count("*").alias("n_endpoints"))


def _falling(df: DataFrame, by: list[str]) -> DataFrame:
    """Per distinct threshold, scores falling: pos and neg at it, tp and fp from the highest on, p and n of all; groups with both classes."""
    s = running_by_value(_by_score(df, by), by, "y_score", ["pos", "neg"]).where("pos_all > 0 AND neg_all > 0")
    tp, fp = (F.col(f"{m}_all") - F.col(f"{m}_upto") + F.col(m) for m in ("pos", "neg"))
    return s.select(*by, F.col("y_score").alias("threshold"), "pos", "neg", tp.alias("tp"), fp.alias("fp"), F.col("pos_all").alias("p"), F.col("neg_all").alias("n"))


def curve(df: DataFrame, by: list[str]) -> DataFrame:
    """Per distinct threshold, scores falling: threshold, tp, fp, tpr, fpr, precision, recall."""
    return _falling(df, by).select(*by, "threshold", "tp", "fp", (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def pr_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Area under precision over recall by trapezoids, from the anchor (recall 0, precision 1). A threshold knows what stood before it by its own counts."""
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 > 0, tp0 / F.nullif(tp0 + fp0, F.lit(0))).otherwise(1.0)
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    return _falling(df, by).groupBy(*by).agg(F.sum(F.col("pos") / F.col("p") * (now + before) / 2).alias("pr_auc"))


def absolute_errors(df: DataFrame, by: list[str]) -> DataFrame:
    """mae, and rae: the errors' sum by that of always saying the mean; over pairs that are finite."""
    rows = df.where(finite(F.col("y_true").cast("double")) & finite(F.col("y_score").cast("double")))
    # the means are one row a group
    means = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.avg("y_true").alias("__mean"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    e = F.abs(F.col("y_true") - F.col("y_score"))
    return rows.join(means, on).groupBy(*by).agg(F.avg(e).alias("mae"), (F.sum(e) / F.sum(F.abs(F.col("y_true") - F.col("__mean")))).alias("rae"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, spearman): the correlation of ranks, equal values sharing the mean of theirs; pairs that lack one are left out."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).agg(F.count("*").alias("__n"))

    def ranks(c: str) -> DataFrame:
        counts = both.groupBy(*by, c).agg(F.sum("__n").alias("t"))
        rank = F.col("t_upto") - (F.col("t") - 1) / 2
        return running_by_value(counts, by, c, ["t"]).select(*[F.col(b).alias(f"{c}_{b}") for b in by], F.col(c).alias(f"{c}_v"), rank.alias(f"{c}_r"))

    def on(c: str) -> Column:
        out = F.col(c) == F.col(f"{c}_v")
        for b in by:
            out = out & F.col(b).eqNullSafe(F.col(f"{c}_{b}"))
        return out

    r = both.join(ranks("__x"), on("__x")).join(ranks("__y"), on("__y"))
    # distinct pairs count as often as they occur
    n, a, b = (F.col(c).cast("double") for c in ("__n", "__x_r", "__y_r"))
    m = r.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"), F.sum(n * a * b).alias("ab"))
    spread = F.sqrt((F.col("aa") - F.col("a") * F.col("a") / F.col("n")) * (F.col("bb") - F.col("b") * F.col("b") / F.col("n")))
    return m.select(*by, ((F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.nullif(spread, F.lit(0.0))).alias("spearman"))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the running weight reaches half of all."""
    summed = df.where(f"{value} IS NOT NULL AND {weight} > 0").groupBy(*by, value).agg(F.sum(weight).alias("w"))
    run = running_by_value(summed, by, value, ["w"])
    return run.where("w_upto * 2 >= w_all").groupBy(*by).agg(F.min(value).alias("weighted_median"))


def noise(se: Column, delta: Column, has_counter: Column, emax: Column, default: float, floor: float) -> Column:
    """A measurement's noise: its squared error, `default` where unknown and `floor` at least, and the squared floor, by its reliability.

    Reliability is the product of two steps, of the difference to the counter assay and of the efficacy.
    """
    # fixed values: the steps and what stands for nothing known
    selective = F.when(~has_counter | delta.isNull() | F.isnan(delta), 0.75).when(delta >= 1.5, 1.0).when(delta >= 0.5, 0.6).otherwise(0.3)
    effective = F.when(emax.isNull() | F.isnan(emax), 0.85).when(emax >= 0.7, 1.0).when(emax >= 0.4, 0.85).otherwise(0.7)
    sigma = F.greatest(F.coalesce(se, F.lit(default)), F.lit(floor))
    return (sigma * sigma + floor * floor) / (selective * effective)


def scorer(name: str):
    """(score, direction) of a metric by its name: score(df, by) gives (by, score) over (y_true, y_score); direction is 1 or -1. Unknown names are an error."""

    def of(column: str, f):
        return lambda df, by: f(df, by).select(*by, F.col(column).cast("double").alias("score"))

    known = {
        "roc_auc": (of("auroc", auroc), 1),
        "pr_auc_score": (of("pr_auc", pr_auc), 1),
        "spearmancorr": (of("spearman", lambda df, by: spearman(df, by, "y_true", "y_score")), 1),
        "mae": (of("mae", absolute_errors), -1),
        "rae": (of("rae", absolute_errors), -1),
    }
    if name not in known:
        raise ValueError(f"unknown metric: {name}")
    return known[name]


def masked_accuracy(df: DataFrame, by: list[str], label: str, predicted: str, ignored: int = -100) -> DataFrame:
    """(by, n, accuracy) over places whose label isn't `ignored` or null; a place without a prediction is wrong. Groups without such a place have n 0 and no accuracy."""
    counts = F.col(label).isNotNull() & (F.col(label) != ignored)
    right = F.coalesce(F.col(label) == F.col(predicted), F.lit(False))
    n, hit = F.sum(F.coalesce(counts, F.lit(False)).cast("long")), F.sum((F.coalesce(counts, F.lit(False)) & right).cast("long"))
    return df.groupBy(*by).agg(n.alias("n"), (hit / F.nullif(n, F.lit(0))).alias("accuracy"))


def perplexity(loss: Column) -> Column:
    """exp(loss); infinite where that overflows, null for null."""
    return F.when(loss > 700, F.lit(float("inf"))).otherwise(F.exp(loss))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """(by, weighted_mean) over rows with both; null without weight."""
    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("weighted_mean"))


def averaged_auroc(df: DataFrame, endpoint: str) -> DataFrame:
    """One row: micro, the AUROC over the pairs of all endpoints as one, and macro, the mean over endpoints with both classes."""
    micro = auroc(df.withColumn("__all", F.lit(0)), ["__all"]).agg(F.first("auroc").alias("micro"))
    return micro.join(mean_auroc(df, endpoint).select(F.col("mean_auroc").alias("macro"), "n_endpoints"))

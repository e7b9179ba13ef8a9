"""Queries of heads, their folds and splits, resampling and rank tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions.hashing import draw, draw_sql
from lodeweave.operators import heads as H
from lodeweave.operators import kernels as K
from lodeweave.operators import reporting as R
from lodeweave.operators import splits as Sp
from lodeweave.operators import statistics as St
from lodeweave.plans import report

QUERIES: dict = {}


def _add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


# endpoints over vectors: two with gaps, one of a single class, one without labels
_ENDPOINTS = ["y_even", "y_low", "y_one", "y_none"]
_Y = {
    "y_even": "CASE WHEN vec_id % 5 <> 0 THEN CAST(label % 2 AS DOUBLE) END",
    "y_low": "CASE WHEN vec_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(CASE WHEN label < 3 THEN 1 ELSE 0 END AS DOUBLE) END",
    "y_one": "CASE WHEN vec_id % 3 = 0 THEN CAST(1 AS DOUBLE) END",
    "y_none": "CAST(NULL AS DOUBLE)",
}
_YSQL = "WITH y AS (SELECT vec_id, " + ", ".join(f"{e} AS {k}" for k, e in _Y.items()) + " FROM embeddings)"


def _labelled(s, d):
    return _t(s, d, "embeddings").select("vec_id", "embedding", "label", *[F.expr(e).alias(k) for k, e in _Y.items()])


def _folds(s, d, n=5):
    return H.stratified_folds(_labelled(s, d), _ENDPOINTS[:2], n, draw(7, "fold", "vec_id"), ["vec_id"])


@_add("h08_stratified_folds", f"{_YSQL} SELECT vec_id, ((row_number() OVER (PARTITION BY coalesce(y_even, 0) > 0 OR (NOT isnan(y_low) AND y_low > 0) ORDER BY {draw_sql(7, 'fold', 'vec_id')}, vec_id) - 1) % 5)::INT AS fold FROM y")
def _(s, d):
    return _folds(s, d).select("vec_id", "fold")


@_add("h07_endpoint_predictors", _YSQL + ", e AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS endpoint, {k} AS v FROM y" for k in _ENDPOINTS) + ")) SELECT endpoint, count(*) FILTER (v IS NOT NULL AND NOT isnan(v)) AS n, CASE WHEN count(*) FILTER (v IS NOT NULL AND NOT isnan(v)) = 0 THEN 0.5e0 WHEN count(*) FILTER (v > 0 AND NOT isnan(v)) = 0 THEN 0e0 WHEN count(*) FILTER (v <= 0) = 0 THEN 1e0 END AS constant FROM e GROUP BY 1")
def _(s, d):
    return H.endpoint_constants(_labelled(s, d), _ENDPOINTS)


@_add("h03_logistic_head", None)
def _(s, d):
    df = _folds(s, d)
    model = H.logistic_grid(df, "embedding", _ENDPOINTS, [0.01, 0.1, 1.0], "fold")
    out = H.predicted(df, "embedding", model, _ENDPOINTS)
    return out.select("vec_id", F.lit(model.penalty).alias("strength"), *[F.round(f"p_{y}", 5).alias(f"p_{y}") for y in _ENDPOINTS])


@_add("h02_forest_head", None)
def _(s, d):
    leaf, score, models = H.forest_grid(_folds(s, d, 3), "embedding", ["y_even", "y_one"], [1, 4], "fold", trees=20, depth=5)
    facts = [(y, leaf, None if isinstance(m, float) else m.getNumTrees, m if isinstance(m, float) else None, round(score, 6)) for y, m in models.items()]
    return s.createDataFrame(facts, "endpoint string, least_rows_of_leaf int, trees int, constant double, score double")


@_add("h04_ridge_head", None)
def _(s, d):
    df = _folds(s, d)
    model = H.ridge_grid(df, "embedding", "label", [0.01, 0.1, 1.0, 10.0], "fold")
    parts = F.zip_with(F.col("embedding").cast("array<double>"), F.array(*[F.lit(float(v)) for v in model.weights[1:]]), lambda a, b: a * b)
    return df.select("vec_id", F.lit(model.alpha).alias("alpha"), F.round(F.aggregate(parts, F.lit(float(model.weights[0])), lambda a, b: a + b), 6).alias("predicted"))


_ALPHAS = [1.0, 1e4, 1e6, 1e8]
# one feature: the model of a fold is a ratio of sums over the other folds
_GRID = """
WITH r AS (SELECT (l_orderkey % 5)::INT AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
f AS (SELECT fold, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM r GROUP BY 1),
o AS (SELECT f.*, sum(n) OVER () - n AS tn, sum(sx) OVER () - sx AS tx, sum(sy) OVER () - sy AS ty, sum(sxx) OVER () - sxx AS txx, sum(sxy) OVER () - sxy AS txy FROM f),
w AS (SELECT o.*, a AS alpha, (txy - tx * ty / tn) / (txx - tx * tx / tn + a) AS w FROM o, (VALUES (1e0), (1e4), (1e6), (1e8)) t(a)),
b AS (SELECT *, (ty - w * tx) / tn AS b FROM w)
SELECT alpha, round(avg(1 - (syy - 2 * b * sy - 2 * w * sxy + n * b * b + 2 * b * w * sx + w * w * sxx) / (syy - sy * sy / n)), 6) AS mean_r2 FROM b GROUP BY 1"""


@_add("h06_grid_search", _GRID)
def _(s, d):
    rows = _t(s, d, "lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("fold"), F.array("l_quantity").alias("x"), "l_extendedprice")
    model = H.ridge_grid(rows, "x", "l_extendedprice", _ALPHAS, "fold")
    return s.createDataFrame([(a, round(r, 6)) for a, r in model.scores.items()], "alpha double, mean_r2 double")


# two features: normal equations by Cramer's rule, on training rows; R² on the others
_RIDGE = f"""
WITH r AS (
  SELECT {draw_sql(42, "test", "l_orderkey", "l_linenumber")} < 0.2 AS test, l_quantity AS p, l_discount AS q, unnest(['l_extendedprice', 'l_tax', 'l_suppkey']) AS descriptor,
         unnest([l_extendedprice, l_tax, l_suppkey::DOUBLE]) AS y FROM lineitem),
m AS (SELECT descriptor, avg(p) AS mp, avg(q) AS mq, avg(y) AS my FROM r WHERE NOT test GROUP BY 1),
c AS (SELECT *, p - mp AS cp, q - mq AS cq, y - my AS cy FROM r JOIN m USING (descriptor)),
s AS (SELECT descriptor, sum(cp * cp) + 1 AS pp, sum(cp * cq) AS pq, sum(cq * cq) + 1 AS qq, sum(cp * cy) AS py, sum(cq * cy) AS qy FROM c WHERE NOT test GROUP BY 1),
w AS (SELECT descriptor, (py * qq - qy * pq) / (pp * qq - pq * pq) AS wp, (qy * pp - py * pq) / (pp * qq - pq * pq) AS wq FROM s)
SELECT descriptor, count(*) AS n_test, round(1 - sum((cy - wp * cp - wq * cq) * (cy - wp * cp - wq * cq)) / (count(*) * var_pop(y)), 6) AS r2 FROM c JOIN w USING (descriptor) WHERE test GROUP BY 1"""


@_add("g49_ridge_r2", _RIDGE)
def _(s, d):
    rows = _t(s, d, "lineitem").withColumn("x", F.array("l_quantity", "l_discount"))
    found = H.ridge_r2(rows, "x", ["l_extendedprice", "l_tax", "l_suppkey"], draw(42, "test", "l_orderkey", "l_linenumber") < 0.2)
    return s.createDataFrame([(y, n, round(r, 6)) for y, n, r in found], "descriptor string, n_test long, r2 double")


# groups in order, one after the other
_FILL = f"""
WITH RECURSIVE g AS (SELECT l_partkey::VARCHAR AS key, count(*) AS size FROM lineitem GROUP BY 1),
n AS (SELECT sum(size) AS n, floor(sum(size) * 0.7e0)::BIGINT AS t, floor(sum(size) * 0.1e0)::BIGINT AS v FROM g),
o AS (SELECT key, size, row_number() OVER (ORDER BY size <= v / 2e0 AND size <= (n - t - v) / 2e0, {draw_sql(11, "group", "key")}, key) AS k, t, v FROM g, n),
f(k, a, b, split) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, ''
  UNION ALL
  SELECT o.k, CASE WHEN a + size <= t THEN a + size ELSE a END, CASE WHEN a + size > t AND b + size <= v THEN b + size ELSE b END,
         CASE WHEN a + size <= t THEN 'train' WHEN b + size <= v THEN 'valid' ELSE 'test' END
  FROM f JOIN o ON o.k = f.k + 1)
SELECT key::BIGINT AS l_partkey, split, size AS n FROM f JOIN o USING (k)"""


@_add("h10_group_split", _FILL)
def _(s, d):
    out = Sp.group_split(_t(s, d, "lineitem").select("l_partkey"), "l_partkey", 11)
    return out.groupBy("l_partkey", "split").agg(F.count("*").alias("n"))


_REPLICATES = 200
_TIMES = " + ".join(f"(u > {x!r}e0)::INT" if "e" not in repr(x) else f"(u > {x!r})::INT" for x in St.poisson_steps())
#: Per group of g and replicate the mean of v over resampled items.
_BOOT = f"""
draws AS (
  SELECT item, b, (('0x' || substr(sha1(concat_ws(':', '3', 'boot', item, b // 8)), 5 * (b % 8) + 1, 5))::BIGINT + 0.5e0) / 1048576e0 AS u
  FROM (SELECT DISTINCT item FROM vals), range({_REPLICATES}) t(b)),
times AS (SELECT item, b, {_TIMES} AS n FROM draws),
means AS (SELECT g, b, sum(v * n) / nullif(sum(n), 0) AS m FROM vals JOIN times USING (item) GROUP BY 1, 2),
cis AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY 1)"""


@_add("g45_bootstrap_mean", f"WITH vals AS (SELECT event_id AS item, 0 AS g, value AS v FROM events WHERE value IS NOT NULL), {_BOOT} SELECT round((SELECT avg(v) FROM vals), 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM cis")
def _(s, d):
    out = St.bootstrap_mean(_t(s, d, "events").select("event_id", "value"), "event_id", "value", _REPLICATES, 3)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@_add("g45_paired_bootstrap", report._WITH + f", pairs AS (SELECT a.dataset, a.embedder AS model_a, b.embedder AS model_b, a.merit - b.merit AS delta FROM best a JOIN best b ON a.dataset = b.dataset AND a.embedder < b.embedder), vals AS (SELECT dataset AS item, [model_a, model_b] AS g, delta AS v FROM pairs), {_BOOT} SELECT g[1] AS model_a, g[2] AS model_b, count(*) AS n_tasks, count(*) FILTER (v > 0) AS wins, count(*) FILTER (v = 0) AS ties, count(*) FILTER (v < 0) AS losses, round(100 * avg(v), 5) AS mean_delta, round(100 * any_value(low), 5) AS ci_low, round(100 * any_value(high), 5) AS ci_high FROM vals JOIN cis USING (g) GROUP BY g")
def _(s, d):
    pairs = R.model_pairs(report.best(s, d), "dataset", "embedder", "merit").where("model_a < model_b").withColumn("delta", F.col("value_a") - F.col("value_b"))
    v = F.col("delta")
    n = pairs.groupBy("model_a", "model_b").agg(F.sum((v > 0).cast("long")).alias("wins"), F.sum((v == 0).cast("long")).alias("ties"), F.sum((v < 0).cast("long")).alias("losses"))
    ci = St.bootstrap_means(pairs, ["model_a", "model_b"], "dataset", "delta", _REPLICATES, 3)
    out = ci.join(n, ["model_a", "model_b"])
    return out.select("model_a", "model_b", F.col("n").alias("n_tasks"), "wins", "ties", "losses", *[F.round(F.col(c) * 100, 5).alias(a) for c, a in (("mean", "mean_delta"), ("low", "ci_low"), ("high", "ci_high"))])


@_add("g46_bootstrap_rank", report._WITH + f", vals AS (SELECT dataset AS item, embedder AS g, {report._RANK} AS v FROM best), {_BOOT} SELECT g AS embedder, count(*) AS n, round(avg(v), 6) AS mean_rank, round(any_value(low), 6) AS ci_low, round(any_value(high), 6) AS ci_high FROM vals JOIN cis USING (g) GROUP BY g")
def _(s, d):
    ranked = report._ranked(report.best(s, d))
    out = St.bootstrap_means(ranked, ["embedder"], "dataset", "place", _REPLICATES, 3)
    return out.select("embedder", "n", F.round("mean", 6).alias("mean_rank"), F.round("low", 6).alias("ci_low"), F.round("high", 6).alias("ci_high"))


# sign patterns with each sum, one rank more a step; the normal law by Simpson's rule
_WILCOXON = """
WITH RECURSIVE b AS (SELECT c_nationkey, c_mktsegment, round(c_acctbal * 100)::BIGINT - 450000 AS delta FROM customer),
e AS (SELECT *, rank() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, abs(delta)) - 1) / 2.0e0 AS r,
             count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, abs(delta)) AS t FROM b WHERE delta <> 0),
g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, least(sum(CASE WHEN delta > 0 THEN r ELSE 0 END), sum(CASE WHEN delta < 0 THEN r ELSE 0 END)) AS w, sum(t * t - 1)::DOUBLE AS ties FROM e GROUP BY 1, 2),
p(m, ways) AS (
  SELECT 0::BIGINT, [1e0]
  UNION ALL
  SELECT m + 1, list_transform(range(len(ways) + m + 1), lambda i: coalesce(ways[i + 1], 0e0) + CASE WHEN i > m THEN ways[i - m] ELSE 0e0 END) FROM p WHERE m < 50),
z AS (SELECT *, abs(w - n * (n + 1) / 4e0) / nullif(sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24e0 - ties / 48e0), 0) AS z FROM g)
SELECT c_nationkey, c_mktsegment, n, w AS statistic,
       round(CASE WHEN n <= 50 AND ties = 0 THEN least(1e0, 2 * list_sum(ways[1:floor(w)::BIGINT + 1]) / pow(2e0, n))
             ELSE 1 - 2 * z / 6000e0 / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(z * i / 2000e0) * (z * i / 2000e0) / 2))) END, 9) AS p_value
FROM z JOIN p ON m = least(n, 50)"""


@_add("g47_rank_test", _WILCOXON)
def _(s, d):
    by = ["c_nationkey", "c_mktsegment"]
    c = _t(s, d, "customer").select(*by, (F.round(F.col("c_acctbal") * 100).cast("long") - 450000).alias("delta"))
    return St.signed_rank_test(c, by, "delta").withColumn("p_value", F.round("p_value", 9))


# counts over vectors; the similarity of two of them
_COUNTS = "list_transform(embedding, lambda x: floor(abs(x) * 20)::DOUBLE)"
_ALIKE = "coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda p: least(p[1], p[2]))) / nullif(list_sum(list_transform(list_zip({a}, {b}), lambda p: greatest(p[1], p[2]))), 0), 0)"


def _counts(s, d):
    counts = F.transform("embedding", lambda x: F.floor(F.abs(x) * 20).cast("double"))
    return _t(s, d, "embeddings").select("vec_id", counts.alias("x"), F.col("label").cast("double").alias("y"), (1 + F.col("vec_id") % 3).alias("noise"))


@_add("h11_kernel_ridge", None)
def _(s, d):
    rows = _counts(s, d)
    train = rows.where("vec_id % 10 <> 0")
    marks = K.landmarks(train, "vec_id", "x", draw(3, "landmark", "vec_id"), 256)
    model = K.kernel_ridge(train, "vec_id", "x", "y", "noise", 2.0, marks)
    return rows.where("vec_id % 10 = 0").select("vec_id", F.round(K.predicted(F.col("x"), model, 0.0, 9.0), 6).alias("predicted"))


@_add("h13_neighbourhood_cv", None)
def _(s, d):
    rows = _counts(s, d)
    marks = K.landmarks(rows, "vec_id", "x", draw(3, "landmark", "vec_id"), 128)
    found = K.neighbourhood_cv(rows, "vec_id", "x", "y", "noise", [0.5, 2.0, 8.0], marks, marks.keys[:16], 0.45)
    return s.createDataFrame([(p, round(a, 6), round(b, 6), n) for p, a, b, n in found], "penalty double, mean_mae double, worst_mae double, n_folds int")


_OFFSETS = f"""
WITH e AS (SELECT vec_id, {_COUNTS} AS x, label - 4.5e0 AS r FROM embeddings),
a AS (SELECT vec_id AS anchor, x AS z FROM e ORDER BY {draw_sql(9, "anchor", "vec_id")}, vec_id::VARCHAR LIMIT 8),
n AS (SELECT anchor, r FROM e, a WHERE {_ALIKE.format(a="x", b="z")} >= 0.45)
SELECT anchor, count(*) AS n, round(count(*) / (count(*) + 5e0) * median(r), 6) AS "offset" FROM n GROUP BY 1 HAVING count(*) >= 2"""


@_add("h15_cluster_offsets", _OFFSETS)
def _(s, d):
    rows = _counts(s, d).withColumn("r", F.col("y") - 4.5)
    anchors = K.landmarks(rows, "vec_id", "x", draw(9, "anchor", "vec_id"), 8)
    found = K.cluster_offsets(rows, "x", "r", anchors, 0.45, 5.0)
    return s.createDataFrame([(int(k), n, round(o, 6)) for k, (n, o) in found.items()], "anchor long, n long, offset double")


_WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]


@_add("h14_blend_weights", "SELECT weight, round(avg(abs(weight * l_quantity * 1500 + (1 - weight) * (30000 + l_tax * 100000) - l_extendedprice)), 4) AS mae FROM lineitem, (VALUES (0e0), (0.25e0), (0.5e0), (0.75e0), (1e0)) t(weight) GROUP BY 1")
def _(s, d):
    out = K.blend_errors(_t(s, d, "lineitem"), F.col("l_quantity") * 1500, 30000 + F.col("l_tax") * 100000, F.col("l_extendedprice"), _WEIGHTS)
    return out.select("weight", F.round("mae", 4).alias("mae"))


@_add("h14_huber_calibration", None)
def _(s, d):
    line = K.huber_line(_t(s, d, "events"), F.col("user_id"), F.col("value"))
    return s.createDataFrame([(round(line.slope, 6), round(line.intercept, 5), round(line.scale, 5))], "slope double, intercept double, scale double")

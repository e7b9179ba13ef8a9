"""Queries over benchmark results: one row per dataset, embedder and head, derived from the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.operators import corpus as C
from lodeweave.operators import reporting as R

#: Both engines read this: sums of whole hundredths, so that every quotient is the same double.
RESULTS = """
SELECT concat('ds', l_suppkey % 25) AS dataset,
       CASE WHEN l_suppkey % 5 = 0 THEN 'regression' ELSE 'classification' END AS task,
       concat('emb', l_partkey % 6) AS embedder,
       CASE l_linenumber % 4 WHEN 0 THEN 'ridge' WHEN 1 THEN 'rf' WHEN 2 THEN 'knn' ELSE 'svm' END AS model,
       CASE WHEN l_suppkey % 5 = 0 THEN 'rmse' ELSE 'roc_auc' END AS cv_metric_name,
       sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 1e1) AS cv_metric,
       CASE WHEN l_suppkey % 5 = 0 THEN 'rmse' ELSE 'roc_auc' END AS test_metric_name,
       sum(CAST(round(l_tax * 100) AS BIGINT)) / (count(*) * 8e0) AS test_metric
FROM lineitem GROUP BY 1, 2, 3, 4, 5, 7
"""
_WITH = f"WITH results AS ({RESULTS}), best AS (SELECT dataset, embedder, abs(merit) AS score, merit FROM (SELECT dataset, embedder, max(CASE WHEN test_metric_name = 'rmse' THEN -test_metric ELSE test_metric END) AS merit FROM results GROUP BY 1, 2)) "


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(RESULTS.replace("FROM lineitem", "FROM {lines}"), lines=lines)


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedder's best head on each dataset by the direction of its metric: score as it is, merit larger if better."""
    merit = F.max(R.direction(F.col("test_metric_name")) * F.col("test_metric")).alias("merit")
    # all scores are 0 or above
    return results(spark, sf_dir).groupBy("dataset", "embedder").agg(merit).select("dataset", "embedder", F.abs("merit").alias("score"), "merit")


def _ranked(df: DataFrame, value: str = "merit") -> DataFrame:
    return df.withColumn("place", R.average_rank(F.col(value), "dataset"))


_RANK = "rank() OVER (PARTITION BY dataset ORDER BY merit DESC) + (count(*) OVER (PARTITION BY dataset, merit) - 1) / 2.0e0"


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _leader(s, d):
    """Mean rank, mean score and coverage of each embedder, by its best head on each dataset: the flagship report."""
    out = _ranked(best(s, d)).groupBy("embedder").agg(F.avg("place").alias("mean_rank"), F.avg("score").alias("mean_score"), F.countDistinct("dataset").alias("n_datasets"))
    return out.select("embedder", _r("mean_rank"), _r("mean_score"), "n_datasets").orderBy("mean_rank", "embedder")


def _pairs(s, d):
    return R.model_pairs(best(s, d), "dataset", "embedder", "merit")


_PAIRS = ", pairs AS (SELECT a.dataset, a.embedder AS model_a, b.embedder AS model_b, a.merit AS value_a, b.merit AS value_b FROM best a JOIN best b USING (dataset) WHERE a.embedder <> b.embedder) "
_OUT = "count(*) AS n, sum((value_a - value_b > {t})::BIGINT)::BIGINT AS wins, sum((value_a - value_b < -{t})::BIGINT)::BIGINT AS losses, sum((abs(value_a - value_b) <= {t})::BIGINT)::BIGINT AS ties"

#: name: (query, SQL)
QUERIES: dict = {}


def _add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


_add("g03_embedder_leaderboard", _WITH + f"SELECT embedder, round(avg(place), 6) AS mean_rank, round(avg(score), 6) AS mean_score, count(DISTINCT dataset) AS n_datasets FROM (SELECT *, {_RANK} AS place FROM best) GROUP BY 1")(_leader)


@_add("f05_numeric_coercion", "SELECT event_id, TRY_CAST(trim(replace(event_type, 'click', '12.5')) AS DOUBLE) AS number FROM events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    x = F.expr("try_cast(trim(replace(event_type, 'click', '12.5')) AS double)")
    return e.select("event_id", F.when(~F.isnan(x), x).alias("number"))


@_add("f06_membership", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_type NOT IN ('ECONOMY')")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3") & ~F.col("p_type").isin("ECONOMY")).select("p_partkey", "p_brand")


@_add("f22_display_scale", _WITH + "SELECT dataset, embedder, model, round(CASE WHEN test_metric_name = 'roc_auc' THEN test_metric * 100 ELSE test_metric END, 6) AS shown FROM results")
def _(s, d):
    return results(s, d).select("dataset", "embedder", "model", F.round(R.display_scale(F.col("test_metric_name"), F.col("test_metric")), 6).alias("shown"))


@_add("f23_case_labels", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band FROM orders")
def _(s, d):
    p = F.col("o_totalprice")
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.when(p < 100000, "low").when(p < 300000, "mid").otherwise("high").alias("band"))


@_add("f24_win_tie_loss", _WITH + _PAIRS + "SELECT dataset, model_a, model_b, CASE WHEN value_a - value_b > 0.01 THEN 'win' WHEN value_a - value_b < -0.01 THEN 'loss' ELSE 'tie' END AS outcome FROM pairs")
def _(s, d):
    delta = F.col("value_a") - F.col("value_b")
    return _pairs(s, d).select("dataset", "model_a", "model_b", F.when(delta > 0.01, "win").when(delta < -0.01, "loss").otherwise("tie").alias("outcome"))


@_add("f26_metric_direction", _WITH + "SELECT test_metric_name, CASE WHEN test_metric_name = 'rmse' THEN -1 ELSE 1 END AS direction, count(*) AS n FROM results GROUP BY 1, 2")
def _(s, d):
    return results(s, d).groupBy("test_metric_name", R.direction(F.col("test_metric_name")).alias("direction")).agg(F.count("*").alias("n"))


@_add("j05_model_pairs", _WITH + _PAIRS + "SELECT dataset, model_a, model_b, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b FROM pairs")
def _(s, d):
    return _pairs(s, d).select("dataset", "model_a", "model_b", _r("value_a"), _r("value_b"))


@_add("j06_subset_pairs", _WITH + "SELECT a.dataset, a.model AS model_a, b.model AS model_b, round(a.cv_metric - b.cv_metric, 6) AS delta FROM results a JOIN results b ON a.dataset = b.dataset WHERE a.embedder = 'emb0' AND b.embedder = 'emb1'")
def _(s, d):
    r = results(s, d)
    a = r.where("embedder = 'emb0'").select("dataset", F.col("model").alias("model_a"), F.col("cv_metric").alias("a"))
    b = r.where("embedder = 'emb1'").select("dataset", F.col("model").alias("model_b"), F.col("cv_metric").alias("b"))
    return a.join(b, "dataset").select("dataset", "model_a", "model_b", F.round(F.col("a") - F.col("b"), 6).alias("delta"))


@_add("j07_baseline_delta", _WITH + "SELECT b.dataset, b.embedder, round(b.score - z.score, 6) AS over_baseline FROM best b JOIN best z ON z.dataset = b.dataset AND z.embedder = 'emb0'")
def _(s, d):
    # one pass: the baseline's score comes back to its dataset's rows over a window
    base = F.max(F.when(F.col("embedder") == "emb0", F.col("score"))).over(Window.partitionBy("dataset"))
    return best(s, d).withColumn("base", base).where("base IS NOT NULL").select("dataset", "embedder", F.round(F.col("score") - F.col("base"), 6).alias("over_baseline"))


@_add("j08_near_wins", _WITH + "SELECT dataset, embedder, round(top - merit, 6) AS gap FROM (SELECT *, max(merit) OVER (PARTITION BY dataset) AS top FROM best) WHERE top - merit <= 0.02")
def _(s, d):
    return R.with_group_max(best(s, d), ["dataset"], "merit", "top").where("top - merit <= 0.02").select("dataset", "embedder", F.round(F.col("top") - F.col("merit"), 6).alias("gap"))


@_add("j09_key_merge", "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def _(s, d):
    return s.read.parquet(f"{d}/customer.parquet").join(s.read.parquet(f"{d}/orders.parquet"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey")


@_add("j14_model_grid", _WITH + "SELECT a.embedder AS model_a, b.embedder AS model_b FROM (SELECT DISTINCT embedder FROM best) a CROSS JOIN (SELECT DISTINCT embedder FROM best) b")
def _(s, d):
    e = best(s, d).select("embedder").distinct()
    # the product of two short lists of names is the operator
    return e.select(F.col("embedder").alias("model_a")).crossJoin(e.select(F.col("embedder").alias("model_b")))


_FAMILY = {"emb0": "count", "emb1": "count", "emb2": "graph", "emb3": "graph", "emb4": "sequence"}


@_add("j19_family_lookup", _WITH + "SELECT dataset, embedder, CASE embedder WHEN 'emb0' THEN 'count' WHEN 'emb1' THEN 'count' WHEN 'emb2' THEN 'graph' WHEN 'emb3' THEN 'graph' WHEN 'emb4' THEN 'sequence' ELSE 'other' END AS family FROM best")
def _(s, d):
    table = F.create_map(*[F.lit(x) for kv in _FAMILY.items() for x in kv])
    return best(s, d).select("dataset", "embedder", F.coalesce(F.try_element_at(table, F.col("embedder")), F.lit("other")).alias("family"))


@_add("j20_complete_pairs", _WITH + "SELECT a.dataset, round(a.score, 6) AS a, round(b.score, 6) AS b FROM best a JOIN best b ON a.dataset = b.dataset WHERE a.embedder = 'emb2' AND b.embedder = 'emb3' AND a.score IS NOT NULL AND b.score IS NOT NULL")
def _(s, d):
    wide = best(s, d).groupBy("dataset").pivot("embedder", ["emb2", "emb3"]).agg(F.first("score"))
    return wide.dropna(subset=["emb2", "emb3"]).select("dataset", F.round("emb2", 6).alias("a"), F.round("emb3", 6).alias("b"))


@_add("j21_reindex", _WITH + "SELECT o.ordinal, o.name AS dataset, round(b.score, 6) AS score FROM (SELECT range AS ordinal, concat('ds', range * 2) AS name FROM range(20)) o LEFT JOIN (SELECT * FROM best WHERE embedder = 'emb1') b ON b.dataset = o.name")
def _(s, d):
    order = s.range(20).select(F.col("id").alias("ordinal"), F.concat(F.lit("ds"), F.col("id") * 2).alias("dataset"))
    return order.join(best(s, d).where("embedder = 'emb1'").select("dataset", _r("score")), "dataset", "left").select("ordinal", "dataset", "score")


@_add("g04_mean_median", _WITH + "SELECT embedder, task, count(DISTINCT dataset) AS n, round(avg(test_metric), 6) AS mean, round(median(test_metric), 6) AS median FROM results GROUP BY 1, 2")
def _(s, d):
    return results(s, d).groupBy("embedder", "task").agg(F.countDistinct("dataset").alias("n"), F.round(F.avg("test_metric"), 6).alias("mean"), F.round(F.median("test_metric"), 6).alias("median"))


@_add("g05_rank_summary", _WITH + f"SELECT embedder, count(*) AS n, round(avg(place), 6) AS mean, round(median(place), 6) AS median, round(stddev_samp(place), 6) AS sd, round(quantile_cont(place, 0.75) - quantile_cont(place, 0.25), 6) AS iqr, count(*) FILTER (place = 1) AS firsts, count(*) FILTER (place <= 3) AS top3, count(*) FILTER (place >= n_models - 2) AS bottom FROM (SELECT *, {_RANK} AS place, count(*) OVER (PARTITION BY dataset) AS n_models FROM best) GROUP BY 1")
def _(s, d):
    r = _ranked(best(s, d)).withColumn("n_models", F.count("*").over(Window.partitionBy("dataset")))
    n = lambda c: F.sum(F.expr(c).cast("long"))
    q = F.percentile("place", F.array(F.lit(0.25), F.lit(0.75)))
    return r.groupBy("embedder").agg(
        F.count("*").alias("n"), F.round(F.avg("place"), 6).alias("mean"), F.round(F.median("place"), 6).alias("median"), F.round(F.stddev_samp("place"), 6).alias("sd"),
        F.round(q[1] - q[0], 6).alias("iqr"), n("place = 1").alias("firsts"), n("place <= 3").alias("top3"), n("place >= n_models - 2").alias("bottom"),
    )


@_add("g06_describe", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY 1")
def _(s, d):
    out = R.describe(s.read.parquet(f"{d}/events.parquet"), ["event_type"], "value")
    return out.select("event_type", "n", *[_r(c) for c in ("mean", "median", "sd", "q1", "q3", "iqr")])


@_add("g07_group_max", _WITH + "SELECT dataset, embedder, round(score, 6) AS score FROM best")
def _(s, d):
    return best(s, d).select("dataset", "embedder", _r("score"))


@_add("g08_columnwise_max", _WITH + "SELECT dataset, embedder, max(model) AS model, max(task) AS task, round(max(cv_metric), 6) AS cv_metric, round(max(test_metric), 6) AS test_metric FROM results GROUP BY 1, 2")
def _(s, d):
    return results(s, d).groupBy("dataset", "embedder").agg(F.max("model").alias("model"), F.max("task").alias("task"), F.round(F.max("cv_metric"), 6).alias("cv_metric"), F.round(F.max("test_metric"), 6).alias("test_metric"))


@_add("g09_wrangle_mean_complete", _WITH + "SELECT dataset, embedder, round(avg(test_metric), 6) AS score FROM results WHERE dataset IN (SELECT dataset FROM results GROUP BY 1 HAVING count(DISTINCT embedder) = (SELECT count(DISTINCT embedder) FROM results)) GROUP BY 1, 2")
def _(s, d):
    return R.complete_groups(results(s, d), "dataset", "embedder").groupBy("dataset", "embedder").agg(F.round(F.avg("test_metric"), 6).alias("score"))


@_add("g10_best_by_cv", _WITH + "SELECT dataset, embedder, model, round(cv_metric, 6) AS cv_metric, round(test_metric, 6) AS test_metric FROM (SELECT *, row_number() OVER (PARTITION BY dataset, cv_metric_name, embedder ORDER BY (CASE WHEN cv_metric_name = 'rmse' THEN -1 ELSE 1 END) * cv_metric DESC NULLS LAST, model) AS k FROM results) WHERE k = 1")
def _(s, d):
    return R.best_by_cv(results(s, d)).select("dataset", "embedder", "model", _r("cv_metric"), _r("test_metric"))


@_add("g11_best_by_test", _WITH + "SELECT dataset, embedder, model, round(test_metric, 6) AS test_metric FROM (SELECT *, row_number() OVER (PARTITION BY dataset, embedder, test_metric_name ORDER BY test_metric DESC NULLS LAST, model) AS k FROM results) WHERE k = 1")
def _(s, d):
    return R.best_by_test(results(s, d)).select("dataset", "embedder", "model", _r("test_metric"))


@_add("g12_collapse_variants", _WITH + "SELECT dataset, base, round(abs(max(merit)), 6) AS score FROM (SELECT dataset, merit, regexp_replace(concat(CASE WHEN embedder < 'emb3' THEN 'small' ELSE 'base' END, '_[', embedder, ']'), '_?\\[[^\\]]+\\]', '', 'g') AS base FROM best) GROUP BY 1, 2")
def _(s, d):
    named = best(s, d).withColumn("base", F.concat(F.when(F.col("embedder") < "emb3", "small").otherwise("base"), F.lit("_["), "embedder", F.lit("]")))
    return R.collapse_variants(named, "base", ["dataset"], "merit").select("dataset", "base", F.round(F.abs("merit"), 6).alias("score"))


@_add("g13_dataset_winner", _WITH + "SELECT dataset, arg_max(embedder, (merit, embedder)) AS winner, count(DISTINCT embedder) AS competitors FROM best GROUP BY 1")
def _(s, d):
    return best(s, d).groupBy("dataset").agg(F.max_by("embedder", F.struct("merit", "embedder")).alias("winner"), F.countDistinct("embedder").alias("competitors"))


@_add("g14_group_argmin", _WITH + "SELECT embedder, model, arg_min(dataset, (test_metric, dataset)) AS lowest FROM results GROUP BY 1, 2")
def _(s, d):
    return results(s, d).groupBy("embedder", "model").agg(F.min_by("dataset", F.struct("test_metric", "dataset")).alias("lowest"))


@_add("g16_pivot", _WITH + "SELECT dataset, " + ", ".join(f"round(max(score) FILTER (embedder = 'emb{k}'), 6) AS emb{k}" for k in range(6)) + " FROM best GROUP BY 1")
def _(s, d):
    wide = best(s, d).groupBy("dataset").pivot("embedder", [f"emb{k}" for k in range(6)]).agg(F.first("score"))
    return wide.select("dataset", *[_r(f"emb{k}") for k in range(6)])


@_add("g17_two_level_pivot", _WITH + "SELECT dataset, " + ", ".join(f"round(avg({m}) FILTER (model = '{h}'), 9) AS {m}_{h}" for m in ("cv_metric", "test_metric") for h in ("ridge", "rf")) + " FROM results WHERE model IN ('ridge', 'rf') GROUP BY 1")
def _(s, d):
    names = [f"{m}_{h}" for m in ("cv_metric", "test_metric") for h in ("ridge", "rf")]
    long = results(s, d).where("model IN ('ridge', 'rf')").unpivot(["dataset", "model"], ["cv_metric", "test_metric"], "metric", "value")
    wide = long.withColumn("cell", F.concat_ws("_", "metric", "model")).groupBy("dataset").pivot("cell", names).agg(F.avg("value"))
    return wide.select("dataset", *[_r(c, 9) for c in names])


@_add("g18_unpivot", "SELECT p_partkey, measure, value FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR measure IN (size, price))")
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot(["p_partkey"], ["size", "price"], "measure", "value")


@_add("g19_crosstab", "SELECT event_type, " + ", ".join(f"count(*) FILTER (user_id % 3 = {k}) AS u{k}" for k in range(3)) + " FROM events GROUP BY 1")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_type", F.concat(F.lit("u"), F.col("user_id") % 3).alias("u"))
    return R.crosstab(e, "event_type", "u", ["u0", "u1", "u2"])


@_add("g20_outcomes_vs_model", _WITH + _PAIRS + "SELECT model_b, " + _OUT.format(t="0") + ", round(count(*) FILTER (value_a > value_b) / count(*), 6) AS win_rate, round(avg(value_a - value_b), 6) AS mean_delta, round(median(value_a - value_b), 6) AS median_delta FROM pairs WHERE model_a = 'emb0' GROUP BY 1")
def _(s, d):
    out = R.outcomes(_pairs(s, d).where("model_a = 'emb0'"), 0.0, "model_b")
    return out.select("model_b", "n", "wins", "losses", "ties", _r("win_rate"), _r("mean_delta"), _r("median_delta"))


@_add("g21_pairwise_matrix", _WITH + _PAIRS + "SELECT model_a, model_b, " + _OUT.format(t="0.001") + ", (sum((value_a - value_b > 0.001)::BIGINT) + 0.5 * sum((abs(value_a - value_b) <= 0.001)::BIGINT))::DOUBLE AS score FROM pairs GROUP BY 1, 2")
def _(s, d):
    out = R.outcomes(_pairs(s, d), 0.001)
    return out.select("model_a", "model_b", "n", "wins", "losses", "ties", (F.col("wins") + F.lit(0.5) * F.col("ties")).cast("double").alias("score"))


@_add("g22_rank_difference", _WITH + f", r AS (SELECT *, {_RANK} AS place FROM best) SELECT a.embedder AS model_a, b.embedder AS model_b, round(avg(a.place - b.place), 6) AS mean_rank_difference FROM r a JOIN r b USING (dataset) WHERE a.embedder <> b.embedder GROUP BY 1, 2")
def _(s, d):
    pairs = R.model_pairs(_ranked(best(s, d)), "dataset", "embedder", "place")
    return pairs.groupBy("model_a", "model_b").agg(F.round(F.avg(F.col("value_a") - F.col("value_b")), 6).alias("mean_rank_difference"))


@_add("g23_cross_win_rate", _WITH + _PAIRS + "SELECT model_a, model_b, round(avg(sign(value_a - value_b)), 6) AS rate FROM pairs GROUP BY 1, 2")
def _(s, d):
    return _pairs(s, d).groupBy("model_a", "model_b").agg(F.round(F.avg(F.signum(F.col("value_a") - F.col("value_b"))), 6).alias("rate"))


@_add("g24_overperformance", _WITH + "SELECT b.dataset, round(count(*) FILTER (b.merit > z.merit) / (SELECT count(DISTINCT embedder) FROM best), 6) AS share FROM best b JOIN best z ON z.dataset = b.dataset AND z.embedder = 'emb0' GROUP BY 1")
def _(s, d):
    b = best(s, d)
    base = F.max(F.when(F.col("embedder") == "emb0", F.col("merit"))).over(Window.partitionBy("dataset"))
    n = b.agg(F.countDistinct("embedder").alias("models"))
    over = b.withColumn("base", base).where("base IS NOT NULL").groupBy("dataset").agg(F.sum((F.col("merit") > F.col("base")).cast("long")).alias("n"))
    return over.crossJoin(F.broadcast(n)).select("dataset", F.round(F.col("n") / F.col("models"), 6).alias("share"))


@_add("g25_group_lists", _WITH + "SELECT dataset, count(*) AS n, string_agg(embedder, ',' ORDER BY embedder) AS embedders FROM best GROUP BY 1")
def _(s, d):
    return best(s, d).groupBy("dataset").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("embedder")), ",").alias("embedders"))


@_add("g26_complete_coverage", _WITH + "SELECT dataset, embedder FROM best WHERE dataset IN (SELECT dataset FROM best GROUP BY 1 HAVING count(DISTINCT embedder) = (SELECT count(DISTINCT embedder) FROM best))")
def _(s, d):
    return R.complete_groups(best(s, d), "dataset", "embedder").select("dataset", "embedder")


@_add("g27_coverage_count", _WITH + "SELECT count(DISTINCT dataset) AS complete FROM best WHERE dataset IN (SELECT dataset FROM best GROUP BY 1 HAVING count(DISTINCT embedder) = (SELECT count(DISTINCT embedder) FROM best))")
def _(s, d):
    return R.complete_groups(best(s, d), "dataset", "embedder").agg(F.countDistinct("dataset").alias("complete"))


@_add("g28_group_means", _WITH + "SELECT embedder, coalesce(task, 'overall') AS task, round(avg(test_metric), 6) AS mean, count(*) AS n FROM results GROUP BY ROLLUP (embedder, task) HAVING embedder IS NOT NULL")
def _(s, d):
    out = results(s, d).rollup("embedder", "task").agg(F.round(F.avg("test_metric"), 6).alias("mean"), F.count("*").alias("n"))
    return out.where("embedder IS NOT NULL").select("embedder", F.coalesce("task", F.lit("overall")).alias("task"), "mean", "n")


@_add("g29_class_balance", "SELECT label, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y), 6) AS share FROM (SELECT doc_id, quality, toxic FROM labels) UNPIVOT (y FOR label IN (quality, toxic)) GROUP BY 1")
def _(s, d):
    y = s.read.parquet(f"{d}/labels.parquet").unpivot(["doc_id"], ["quality", "toxic"], "label", "y").where("y IS NOT NULL")
    return y.groupBy("label").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.round(F.avg("y"), 6).alias("share"))


@_add("w01_average_rank", _WITH + f"SELECT dataset, embedder, {_RANK} AS place FROM best")
def _(s, d):
    return _ranked(best(s, d)).select("dataset", "embedder", "place")


@_add("w02_rank_by_head", _WITH + "SELECT dataset, model, embedder, rank() OVER (PARTITION BY dataset, model ORDER BY test_metric DESC) + (count(*) OVER (PARTITION BY dataset, model, test_metric) - 1) / 2.0e0 AS place FROM results")
def _(s, d):
    return results(s, d).select("dataset", "model", "embedder", R.average_rank(F.col("test_metric"), "dataset", "model").alias("place"))


@_add("w03_dense_ordinal", _WITH + "SELECT dataset, embedder, row_number() OVER (PARTITION BY dataset ORDER BY merit DESC, embedder) AS ordinal FROM best")
def _(s, d):
    return best(s, d).select("dataset", "embedder", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("merit"), "embedder")).cast("long").alias("ordinal"))


@_add("w04_equal_to_group_max", _WITH + "SELECT dataset, embedder, model FROM (SELECT *, max(test_metric) OVER (PARTITION BY dataset) AS top FROM results) WHERE test_metric = top")
def _(s, d):
    return R.with_group_max(results(s, d), ["dataset"], "test_metric", "top").where("test_metric = top").select("dataset", "embedder", "model")


@_add("w05_first_non_null", "SELECT DISTINCT user_id, first_value(error_value IGNORE NULLS) OVER w AS error_value, first_value(click_value IGNORE NULLS) OVER w AS click_value FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN value END AS error_value, CASE WHEN event_type = 'click' THEN value END AS click_value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    e = e.select("user_id", "event_id", *[F.when(F.col("event_type") == k, F.col("value")).alias(f"{k}_value") for k in ("error", "click")])
    return R.first_non_null(e, ["user_id"], [F.col("event_id")], ["error_value", "click_value"])


@_add("w10_last_row", "SELECT user_id, arg_max(event_type, event_id) AS last_type, arg_min(event_type, event_id) AS first_type FROM events GROUP BY 1")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.min_by("event_type", "event_id").alias("first_type"))


@_add("o01_sorted_nulls_last", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS LAST, c_custkey")
def _(s, d):
    return s.read.parquet(f"{d}/customer.parquet").orderBy(F.col("c_acctbal").asc_nulls_last(), "c_custkey").select("c_custkey", "c_acctbal")


@_add("o02_mixed_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def _(s, d):
    return s.read.parquet(f"{d}/orders.parquet").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderpriority", "o_totalprice")


@_add("o03_heterogeneous_sort", "SELECT v, row_number() OVER (ORDER BY TRY_CAST(v AS DOUBLE) IS NULL, TRY_CAST(v AS DOUBLE), v) AS place FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_type END AS v FROM part)")
def _(s, d):
    v = s.read.parquet(f"{d}/part.parquet").select(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_type")).alias("v")).distinct()
    n = F.expr("try_cast(v AS double)")
    return C.numbered(v, [n.isNull(), n, F.col("v")])


@_add("o04_count_then_name", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type")


@_add("o05_most_common", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(10)


@_add("o11_group_order", "SELECT o_orderpriority, row_number() OVER (ORDER BY sum(cents) DESC, o_orderpriority) AS ordinal FROM (SELECT o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) GROUP BY 1")
def _(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").groupBy("o_orderpriority").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return o.select("o_orderpriority", F.row_number().over(Window.orderBy(F.desc("cents"), "o_orderpriority")).cast("long").alias("ordinal"))


@_add("u01_union_by_name", "SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def _(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    x = s.read.parquet(f"{d}/supplier.parquet").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(x, allowMissingColumns=True)


@_add("u03_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_brand", "p_type").distinct()


@_add("u04_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("nation")).intersect(s.read.parquet(f"{d}/supplier.parquet").select("s_nationkey"))


@_add("u05_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id")).subtract(s.read.parquet(f"{d}/orders.parquet").select("o_custkey"))


@_add("u06_coverage_union", _WITH + "SELECT dataset FROM results WHERE embedder = 'emb0' UNION SELECT dataset FROM results WHERE model = 'rf'")
def _(s, d):
    r = results(s, d)
    return r.where("embedder = 'emb0'").select("dataset").union(r.where("model = 'rf'").select("dataset")).distinct()

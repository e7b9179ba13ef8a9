"""Queries of metrics, similarity, tokens and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.functions import text
from lodeweave.functions.hashing import draw, draw_sql
from lodeweave.operators import metrics as M
from lodeweave.operators import similarity as S
from lodeweave.operators import splits as Sp
from lodeweave.operators import statistics as St
from lodeweave.operators import tokens as T
from lodeweave.operators.order import placed

QUERIES: dict = {}


def _add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


_Y = "WITH y AS (SELECT d.lang, l.doc_id, e.endpoint, e.y_true, (d.n_chars % 97) / 97e0 AS y_score FROM (SELECT doc_id, endpoint, y_true FROM (SELECT doc_id, quality, toxic FROM labels) UNPIVOT (y_true FOR endpoint IN (quality, toxic))) e JOIN labels l USING (doc_id) JOIN documents d USING (doc_id)) "


def _y(s, d):
    y = _t(s, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "endpoint", "y_true").where("y_true IS NOT NULL")
    return y.join(_t(s, d, "documents").select("doc_id", "lang", ((F.col("n_chars") % 97) / F.lit(97.0)).alias("y_score")), "doc_id")


_AUROC = "SELECT {by}, (sum(CASE WHEN y_true > 0 THEN r END) - sum((y_true > 0)::INT) * (sum((y_true > 0)::INT) + 1) / 2.0e0) / (sum((y_true > 0)::INT) * sum((y_true <= 0)::INT)) AS auroc FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY y_score) + (count(*) OVER (PARTITION BY {by}, y_score) - 1) / 2.0e0 AS r FROM y) GROUP BY {by} HAVING sum((y_true > 0)::INT) > 0 AND sum((y_true <= 0)::INT) > 0"


@_add("g34_auroc", _Y + "SELECT lang, round(auroc, 6) AS auroc FROM (" + _AUROC.format(by="lang") + ")")
def _(s, d):
    return M.auroc(_y(s, d), ["lang"]).select("lang", F.round("auroc", 6).alias("auroc"))


@_add("g35_mean_auroc", _Y + "SELECT round(avg(auroc), 6) AS mean_auroc, count(*) AS n_endpoints FROM (" + _AUROC.format(by="endpoint") + ")")
def _(s, d):
    return M.mean_auroc(_y(s, d), "endpoint").select(F.round("mean_auroc", 6).alias("mean_auroc"), "n_endpoints")


_CURVE = "c AS (SELECT endpoint, y_score AS threshold, sum(sum((y_true > 0)::INT)) OVER w AS tp, sum(sum((y_true <= 0)::INT)) OVER w AS fp, sum(sum((y_true > 0)::INT)) OVER (PARTITION BY endpoint) AS p, sum(sum((y_true <= 0)::INT)) OVER (PARTITION BY endpoint) AS n FROM y GROUP BY endpoint, y_score WINDOW w AS (PARTITION BY endpoint ORDER BY y_score DESC)) "


@_add("g30_roc_points", _Y + ", " + _CURVE + "SELECT endpoint, round(threshold, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr FROM c")
def _(s, d):
    return M.curve(_y(s, d), ["endpoint"]).select("endpoint", F.round("threshold", 6).alias("threshold"), "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@_add("g31_pr_points", _Y + ", " + _CURVE + "SELECT endpoint, round(threshold, 6) AS threshold, round(tp / p, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM c")
def _(s, d):
    return M.curve(_y(s, d), ["endpoint"]).select("endpoint", F.round("threshold", 6).alias("threshold"), F.round("tpr", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@_add("g37_pr_auc", _Y + ", " + _CURVE + "SELECT endpoint, round(sum((r - r0) * (q + q0) / 2), 6) AS pr_auc FROM (SELECT endpoint, tp / p AS r, tp / (tp + fp) AS q, coalesce(lag(tp / p) OVER v, 0) AS r0, coalesce(lag(tp / (tp + fp)) OVER v, 1) AS q0 FROM c WINDOW v AS (PARTITION BY endpoint ORDER BY threshold DESC)) GROUP BY 1")
def _(s, d):
    return M.pr_auc(_y(s, d), ["endpoint"]).select("endpoint", F.round("pr_auc", 6).alias("pr_auc"))


@_add("g38_absolute_errors", "SELECT event_type, round(avg(abs(value - g)), 6) AS mae, round(sum(abs(value - g)) / sum(abs(value - m)), 6) AS rae FROM (SELECT *, user_id % 50 AS g, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1")
def _(s, d):
    e = _t(s, d, "events").select("event_type", F.col("value").alias("y_true"), (F.col("user_id") % 50).alias("y_score"))
    out = M.absolute_errors(e, ["event_type"])
    return out.select("event_type", F.round("mae", 6).alias("mae"), F.round("rae", 6).alias("rae"))


@_add("g39_spearman", "SELECT p_brand, round(corr(x, y), 6) AS spearman FROM (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0e0 AS x, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0e0 AS y FROM part) GROUP BY 1")
def _(s, d):
    return M.spearman(_t(s, d, "part"), ["p_brand"], "p_size", "p_retailprice").select("p_brand", F.round("spearman", 6).alias("spearman"))


@_add("g40_weighted_loss", "SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS loss, round(exp(sum(value * user_id) / sum(user_id) / 100), 6) AS perplexity FROM events GROUP BY 1")
def _(s, d):
    loss = F.sum(F.col("value") * F.col("user_id")) / F.sum("user_id")
    return _t(s, d, "events").groupBy("event_type").agg(F.round(loss, 6).alias("loss"), F.round(F.exp(loss / 100), 6).alias("perplexity"))


@_add("g48_weighted_median", "SELECT event_type, min(v) AS weighted_median FROM (SELECT event_type, v, sum(w) OVER (PARTITION BY event_type ORDER BY v) AS run, sum(w) OVER (PARTITION BY event_type) AS every FROM (SELECT event_type, value AS v, sum(user_id)::BIGINT AS w FROM events WHERE user_id > 0 GROUP BY 1, 2)) WHERE run * 2 >= every GROUP BY 1")
def _(s, d):
    return M.weighted_median(_t(s, d, "events"), ["event_type"], "value", "user_id")


@_add("w08_running_weight", "SELECT user_id, event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS running FROM events")
def _(s, d):
    return _t(s, d, "events").select("user_id", "event_id", F.sum("event_id").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


_COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_KNN = f"SELECT query, target, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, target) AS place FROM (SELECT a.vec_id AS query, b.vec_id AS target, round({_COS}, 9) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE place <= 5"


def _knn(s, d, k=5):
    e = _t(s, d, "embeddings")
    return S.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("target"), F.col("embedding").alias("vector")), k)


@_add("j18_nearest_neighbours", f"SELECT query, target, round(similarity, 6) AS similarity, place FROM ({_KNN})")
def _(s, d):
    return _knn(s, d).select("query", "target", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@_add("w09_top_k", f"SELECT query, count(*) AS n, min(target) AS least_target FROM ({_KNN}) GROUP BY 1")
def _(s, d):
    return _knn(s, d).groupBy("query").agg(F.count("*").alias("n"), F.min("target").alias("least_target"))


@_add("h05_knn_vote", f"SELECT query, arg_max(label, (n, -label)) AS label FROM (SELECT query, label, count(*) AS n FROM ({_KNN}) JOIN embeddings ON vec_id = target GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    votes = _knn(s, d).join(_t(s, d, "embeddings").select(F.col("vec_id").alias("target"), "label"), "target").groupBy("query", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


@_add("h12_weighted_knn", f"SELECT query, round(sum((similarity + 1) * label) / sum(similarity + 1), 6) AS predicted FROM ({_KNN}) JOIN embeddings ON vec_id = target GROUP BY 1")
def _(s, d):
    k = _knn(s, d).join(_t(s, d, "embeddings").select(F.col("vec_id").alias("target"), "label"), "target")
    w = F.col("similarity") + 1
    return k.groupBy("query").agg(F.round(F.sum(w * F.col("label")) / F.sum(w), 6).alias("predicted"))


@_add("h01_train_projection", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, label FROM embeddings")
def _(s, d):
    return _t(s, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, "test").otherwise("train").alias("split"), "label")


@_add("x13_tanimoto", "SELECT vec_id, round(coalesce(sum(least(x, y)) / sum(greatest(x, y)), 0), 6) AS similarity FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: floor(abs(x) * 20)::DOUBLE)) AS x, unnest(list_reverse(list_transform(embedding, lambda x: floor(abs(x) * 20)::DOUBLE))) AS y FROM embeddings) GROUP BY 1")
def _(s, d):
    c = F.transform("embedding", lambda x: F.floor(F.abs(x) * 20).cast("double"))
    return _t(s, d, "embeddings").select("vec_id", F.round(S.tanimoto(c, F.reverse(c)), 6).alias("similarity"))


@_add("x14_cosine", f"SELECT a.vec_id AS a, b.vec_id AS b, round(1 - {_COS}, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    e = _t(s, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(1 - S.cosine(F.col("x"), F.col("y")), 6).alias("distance"))


@_add("x15_standard_scale", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS scaled FROM customer")
def _(s, d):
    c = _t(s, d, "customer")
    m = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("sd"))
    return c.crossJoin(F.broadcast(m)).select("c_custkey", F.round((F.col("c_acctbal") - F.col("m")) / F.col("sd"), 6).alias("scaled"))


@_add("j17_similarity_join", "WITH w AS (SELECT page_id AS id, list_distinct(regexp_extract_all(url, '[a-z0-9]+')) AS items FROM pages) SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items))), 6) AS similarity FROM w a JOIN w b ON a.id < b.id WHERE len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items))) >= 0.8")
def _(s, d):
    w = _t(s, d, "pages").select(F.col("page_id").alias("id"), F.array_distinct(F.regexp_extract_all("url", F.lit("[a-z0-9]+"), F.lit(0))).alias("items"))
    return S.set_join(w, 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


_WORDS = "regexp_extract_all(p_name, '[a-z]+')"


def _brackets(s, d):
    words = F.regexp_extract_all("p_name", F.lit("[a-z]+"), F.lit(0))
    return _t(s, d, "part").select("p_partkey", F.array_join(F.transform(words, lambda w: F.concat(F.lit("["), w, F.lit("]"))), "").alias("sequence"))


_BR = "WITH b AS (SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^a-z]+', '][', 'g'), '^(.*)$', '[\\1]') AS sequence FROM part) "


@_add("x05_bracket_pieces", _BR + "SELECT p_partkey, len(regexp_extract_all(sequence, '\\[[^\\]]+\\]')) AS n_pieces, list_aggregate(regexp_extract_all(sequence, '\\[[^\\]]+\\]'), 'string_agg', '') = sequence AS strict FROM b")
def _(s, d):
    return _brackets(s, d).select("p_partkey", F.size(text.pieces(F.col("sequence"), text.BRACKETED)).cast("long").alias("n_pieces"), text.well_formed(F.col("sequence"), text.BRACKETED).alias("strict"))


@_add("x06_character_pieces", "SELECT s_suppkey, len(list_filter(regexp_extract_all(s_name, '\\[[^\\]]+\\]|Br|Cl|%[0-9][0-9]|[A-Za-z]|[0-9]|[^A-Za-z0-9\\[\\]%]|.'), lambda x: trim(x) <> '')) AS n_pieces FROM supplier")
def _(s, d):
    return _t(s, d, "supplier").select("s_suppkey", F.size(text.pieces(F.col("s_name"), text.SMILES_PIECE)).cast("long").alias("n_pieces"))


@_add("x07_piece_count", _BR + "SELECT max(greatest(1, len(regexp_extract_all(sequence, '\\[[^\\]]+\\]'))))::BIGINT AS max_span FROM b")
def _(s, d):
    return _brackets(s, d).agg(F.max(F.greatest(F.lit(1), F.size(text.pieces(F.col("sequence"), text.BRACKETED)))).cast("long").alias("max_span"))


@_add("x08_looks_like_smiles", "SELECT l_orderkey, l_linenumber, regexp_matches(trim(v), '^(?:\\[[0-9]*(?:Br|Cl|[HBCNOPSFIbcnops])[^\\[\\]]*\\]|Br|Cl|[BCNOPSFIbcnops]|%[0-9][0-9]|[()\\-.=#$:/\\\\+@]|[0-9])+$') AS looks FROM (SELECT *, concat(' ', l_returnflag, '=', l_linestatus, l_linenumber, ' ') AS v FROM lineitem)")
def _(s, d):
    value = F.concat(F.lit(" "), "l_returnflag", F.lit("="), "l_linestatus", F.col("l_linenumber").cast("string"), F.lit(" "))
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.looks_like_smiles(value).alias("looks"))


@_add("w07_adjacent_pairs", "WITH t AS (SELECT p_partkey, list_concat(" + _WORDS + ", " + _WORDS + ") AS toks FROM part), p AS (SELECT unnest(list_zip(toks[:-2], toks[2:])) AS z FROM t) SELECT z[1] AS \"left\", z[2] AS \"right\", count(*) AS n FROM p GROUP BY 1, 2")
def _(s, d):
    words = F.regexp_extract_all("p_name", F.lit("[a-z]+"), F.lit(0))
    return T.adjacent_pairs(_t(s, d, "part").select(F.col("p_partkey").alias("row_id"), F.concat(words, words).alias("toks"))).select("left", "right", "n")


@_add("g43_symbol_counts", _BR + "SELECT symbol, count(*) AS n FROM (SELECT unnest(regexp_extract_all(sequence, '\\[[^\\]]+\\]')) AS symbol FROM (SELECT DISTINCT sequence FROM b)) GROUP BY 1")
def _(s, d):
    one = _brackets(s, d).select("sequence").distinct()
    return one.select(F.explode(text.pieces(F.col("sequence"), text.BRACKETED)).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@_add("j13_missing_symbols", _BR + "SELECT symbol, n FROM (SELECT symbol, count(*) AS n FROM (SELECT unnest(regexp_extract_all(sequence, '\\[[^\\]]+\\]')) AS symbol FROM b) GROUP BY 1) WHERE n >= 5 AND symbol NOT IN ('[red]', '[ring]')")
def _(s, d):
    n = _brackets(s, d).select(F.explode(text.pieces(F.col("sequence"), text.BRACKETED)).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 5")
    return n.join(s.createDataFrame([("[red]",), ("[ring]",)], "symbol string"), "symbol", "left_anti")


@_add("g44_occurrences", "SELECT token, sum((length(text) - length(replace(text, token, ''))) // length(token))::BIGINT AS n FROM documents, (VALUES ('th'), ('ha'), ('haha'), ('ion')) t(token) GROUP BY 1")
def _(s, d):
    # the tokens are a stated short list: counted in one pass over the texts
    words = ["th", "ha", "haha", "ion"]
    one = _t(s, d, "documents").agg(*[F.sum(text.occurrences(F.col("text"), F.lit(w))).alias(w) for w in words])
    return one.unpivot([], words, "token", "n")


@_add("g42_length_percentiles", "SELECT lang, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.99), 6) AS p99, round(quantile_cont(n_chars, 0.999), 6) AS p999 FROM documents GROUP BY 1")
def _(s, d):
    q = St.exact_quantiles(_t(s, d, "documents"), ["lang"], "n_chars", [0.9, 0.99, 0.999]).withColumn("q", F.col("quantiles"))
    return q.select("lang", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p90", "p99", "p999"))])


@_add("g42_length_report", "WITH d AS (SELECT * FROM documents WHERE n_chars IS NOT NULL) SELECT source, count(*) AS n, max(n_chars) AS longest, " + ", ".join(f"round(quantile_cont(n_chars, {q}), 6) AS {n}" for q, n in ((0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (0.995, "p995"), (0.999, "p999"))) + ", (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY n_chars DESC, doc_id) FROM (SELECT doc_id, n_chars FROM d x WHERE x.source = d.source ORDER BY n_chars DESC, doc_id LIMIT 5)) AS worst FROM d GROUP BY 1")
def _(s, d):
    docs = _t(s, d, "documents").select("source", "doc_id", "n_chars")
    names = {"p90": 0.9, "p95": 0.95, "p99": 0.99, "p995": 0.995, "p999": 0.999}
    q = St.exact_quantiles(docs, ["source"], "n_chars", list(names.values()))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    worst = docs.withColumn("place", place).where("place <= 5").groupBy("source").agg(F.max("n_chars").alias("longest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("worst"))
    return q.join(worst, "source").select("source", "n", "longest", *[F.round(F.col("quantiles")[k], 6).alias(n) for k, n in enumerate(names)], "worst")


_ENC_VOCAB = ["[red]", "[ring]", "[widget]", "[small]", "[red][ring]", "[small][ring]", "[red][widget]"]
_ENC = _BR + ", v AS (SELECT token, (row_number() OVER () + 4)::INTEGER AS id FROM (SELECT unnest(['" + "', '".join(_ENC_VOCAB) + "']) AS token)), e AS (SELECT p_partkey, regexp_extract_all(sequence, '\\[red\\]\\[ring\\]|\\[small\\]\\[ring\\]|\\[red\\]\\[widget\\]|\\[[a-z]+\\]') AS toks FROM b), i AS (SELECT p_partkey, list_transform(toks, lambda t: coalesce(list_position(['" + "', '".join(_ENC_VOCAB) + "'], t) + 4, 3)) AS ids FROM e) "


def _enc(s, d):
    vocab = {t: i for i, t in enumerate([*T.SPECIALS, *_ENC_VOCAB])}
    return _brackets(s, d).select("p_partkey", T.encode(F.col("sequence"), vocab, 2).alias("ids"))


_J = "array_to_string({}, ',')"


def _join(c):
    return F.array_join(c.cast("array<string>"), ",")


@_add("t09_longest_match", _ENC + f"SELECT p_partkey, {_J.format('ids')} AS ids FROM i")
def _(s, d):
    return _enc(s, d).select("p_partkey", _join(F.col("ids")).alias("ids"))


@_add("t10_unknown_ids", _ENC + "SELECT p_partkey, len(list_filter(ids, lambda x: x = 3)) AS unknown FROM i")
def _(s, d):
    return _enc(s, d).select("p_partkey", F.size(F.filter("ids", lambda x: x == 3)).cast("long").alias("unknown"))


@_add("t11_framed", _ENC + f"SELECT p_partkey, {_J.format('list_concat([0], list_concat(ids, [2]))')} AS ids FROM i")
def _(s, d):
    return _enc(s, d).select("p_partkey", _join(T.framed(F.col("ids"))).alias("ids"))


@_add("t12_truncated", _ENC + f"SELECT p_partkey, {_J.format('list_concat([0], list_concat(ids, [2]))[1:3]')} AS cut, {_J.format('list_concat([0], list_concat(ids[1:1], [2]))')} AS content FROM i")
def _(s, d):
    return _enc(s, d).select("p_partkey", _join(T.truncated(F.col("ids"), 3, "cut")).alias("cut"), _join(T.truncated(F.col("ids"), 3, "content")).alias("content"))


@_add("t13_padded", _ENC + f"SELECT p_partkey, {_J.format('list_concat(ids, list_transform(range(6 - len(ids)), lambda x: 1))')} AS ids FROM i")
def _(s, d):
    return _enc(s, d).select("p_partkey", _join(T.padded(F.col("ids"), F.lit(6))).alias("ids"))


@_add("t14_eligible", _ENC + "SELECT p_partkey, len(list_filter(list_concat([0], list_concat(ids, [2, 1, 4])), lambda x: x NOT IN (0, 1, 2, 4))) AS n FROM i")
def _(s, d):
    framed = F.concat(T.framed(F.col("ids")), F.array(F.lit(1), F.lit(4)))
    return _enc(s, d).select("p_partkey", F.size(T.eligible(framed)).cast("long").alias("n"))


@_add("t16_unknown_examples", _ENC + "SELECT p_partkey FROM i WHERE list_contains(ids, 3) ORDER BY 1 LIMIT 20")
def _(s, d):
    return _enc(s, d).where(F.array_contains("ids", 3)).orderBy("p_partkey").limit(20).select("p_partkey")


@_add("t01_merge_vocabulary", None)
def _(s, d):
    seqs = _brackets(s, d).select(F.col("p_partkey").alias("row_id"), text.pieces(F.concat("sequence", "sequence"), text.BRACKETED).alias("toks"))
    return T.vocabulary(s, T.train_merges(seqs, 40, 20, 4))


@_add("t05_merge_frequencies", None)
def _(s, d):
    seqs = _brackets(s, d).select(F.col("p_partkey").alias("row_id"), text.pieces(F.concat("sequence", "sequence"), text.BRACKETED).alias("toks"))
    return s.createDataFrame(list(T.train_merges_counted(seqs, 40, 20, 4).items()), "token string, frequency long")


@_add("g41_token_stats", _ENC + "SELECT count(*) AS n, round(avg(len(ids)), 6) AS mean_len, max(len(ids)) AS max_len, round(count(*) FILTER (list_contains(ids, 3)) / count(*), 6) AS unk_rate FROM i")
def _(s, d):
    n = F.size("ids")
    return _enc(s, d).agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_len"), F.max(n).cast("long").alias("max_len"), F.round(F.avg(F.array_contains("ids", 3).cast("int")), 6).alias("unk_rate"))


_STATS = _ENC.rstrip() + """, f AS (
  SELECT p_partkey, list_concat([0], list_concat(ids, [2])) AS ids FROM i),
r AS (SELECT len(ids) AS n, least(len(ids), 6) AS l, list_filter(CASE WHEN len(ids) > 6 THEN list_concat(ids[1:5], ids[-1:]) ELSE ids END, lambda x: x NOT IN (0, 1, 2, 4)) AS e FROM f),
s AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS k, count(*) OVER () AS m FROM r)"""


def _framed(s, d):
    return _enc(s, d).select("p_partkey", T.framed(F.col("ids")).alias("ids"))


@_add("g41_tokenization_stats", _STATS + " SELECT count(*) AS sample_size, round(avg(l), 6) AS mean_len, (SELECT l::DOUBLE FROM s WHERE k = round_even((m - 1) * 0.5, 0)) AS p50_len, (SELECT l::DOUBLE FROM s WHERE k = round_even((m - 1) * 0.95, 0)) AS p95_len, (SELECT l::DOUBLE FROM s WHERE k = round_even((m - 1) * 0.99, 0)) AS p99_len, max(l)::DOUBLE AS max_len, round(avg((n > 6)::INT), 6) AS truncation_rate, round(sum(len(list_filter(e, lambda x: x = 3))) / sum(len(e)), 6) AS unk_rate, 0e0 AS empty_sequence_rate, round(avg((len(list_filter(e, lambda x: x = 3)) > 0.8 * len(e))::INT), 6) AS mostly_unknown_rate FROM r")
def _(s, d):
    out = T.token_statistics(_framed(s, d), "ids", 6)
    rates = ("mean_len", "truncation_rate", "unk_rate", "empty_sequence_rate", "mostly_unknown_rate")
    return out.select(*[F.round(c, 6).alias(c) if c in rates else F.col(c) for c in out.columns])


@_add("t15_quality_gates", _STATS + ", u AS (SELECT sum(len(list_filter(e, lambda x: x = 3))) / sum(len(e)) AS unk, avg((n > 6)::INT) AS cut, avg((len(list_filter(e, lambda x: x = 3)) > 0.8 * len(e))::INT) AS mostly FROM r) SELECT * FROM (SELECT 'vocabulary_size' AS gate, 12e0 AS value, 100e0 AS allowed, 'error' AS severity, false AS passed UNION ALL SELECT 'special_ids', 0e0, 0e0, 'error', true UNION ALL SELECT 'sha256', 1e0, 0e0, 'error', false UNION ALL SELECT 'bracketed', 1e0, 0.95e0, 'error', true UNION ALL SELECT 'unk_rate', round(unk, 6), 0.001e0, 'error', unk <= 0.001 FROM u UNION ALL SELECT 'empty_sequence_rate', 0e0, 0e0, 'error', true UNION ALL SELECT 'mostly_unknown_rate', round(mostly, 6), 0.01e0, 'error', mostly <= 0.01 FROM u UNION ALL SELECT 'truncation_rate', round(cut, 6), 0.05e0, 'warning', cut <= 0.05 FROM u)")
def _(s, d):
    vocab = T.vocabulary(s, _ENC_VOCAB)
    gates = T.quality_gates(T.token_statistics(_framed(s, d), "ids", 6), vocab, _brackets(s, d), "sequence", "0a", "0b")
    return gates.withColumn("value", F.round("value", 6))


@_add("t08_patched_vocabulary", _BR + ", v AS (SELECT token, (row_number() OVER () + 4)::INTEGER AS id FROM (SELECT unnest(['" + "', '".join(_ENC_VOCAB) + "']) AS token)), old AS (SELECT * FROM v UNION ALL SELECT * FROM (VALUES ('<s>', 0), ('<pad>', 1), ('</s>', 2), ('<unk>', 3), ('<mask>', 4))), n AS (SELECT DISTINCT unnest(regexp_extract_all(sequence, '\\[[^\\]]+\\]')) AS token FROM b) SELECT token, id, false AS added FROM old UNION ALL SELECT token, (11 + row_number() OVER (ORDER BY token))::INT, true FROM n WHERE token NOT IN (SELECT token FROM old)")
def _(s, d):
    symbols = _brackets(s, d).select(F.explode(text.pieces(F.col("sequence"), text.BRACKETED)).alias("token"))
    return T.patched(T.vocabulary(s, _ENC_VOCAB), symbols)


@_add("t18_compared_vocabularies", "WITH a AS (SELECT p_brand AS token, min(p_size) AS id FROM part GROUP BY 1), b AS (SELECT p_brand AS token, min(p_size) AS id FROM part WHERE p_size > 1 AND p_brand <> 'Brand#11' GROUP BY 1 UNION ALL SELECT p_type, min(p_size) FROM part GROUP BY 1) SELECT token, a.id AS id_a, b.id AS id_b, CASE WHEN b.token IS NULL THEN 'only_a' WHEN a.token IS NULL THEN 'only_b' ELSE 'other_id' END AS status FROM a FULL JOIN b USING (token) WHERE a.token IS NULL OR b.token IS NULL OR a.id <> b.id")
def _(s, d):
    p = _t(s, d, "part")
    a = p.groupBy(F.col("p_brand").alias("token")).agg(F.min("p_size").alias("id"))
    b = p.where("p_size > 1 AND p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("token")).agg(F.min("p_size").alias("id"))
    return T.compared(a, b.unionByName(p.groupBy(F.col("p_type").alias("token")).agg(F.min("p_size").alias("id"))))


@_add("t10_detokenised", _ENC + "SELECT p_partkey, coalesce(list_aggregate(list_transform(list_filter(ids, lambda x: x <> 3), lambda x: (['" + "', '".join(_ENC_VOCAB) + "'])[x - 4]), 'string_agg', ''), '') AS sequence FROM i")
def _(s, d):
    vocab = {t: i for i, t in enumerate([*T.SPECIALS, *_ENC_VOCAB])}
    return _enc(s, d).select("p_partkey", T.detokenised(F.col("ids"), vocab).alias("sequence"))


@_add("t13_padded_batches", _ENC + ", f AS (SELECT p_partkey, p_partkey // 10 AS batch, list_concat([0], list_concat(ids, list_concat([2], list_concat(ids[1:1], [2])))) AS ids FROM i), m AS (SELECT batch, ceil(max(len(ids)) / 4) * 4 AS target FROM f GROUP BY 1) SELECT p_partkey, array_to_string(list_concat(list_transform(range((target - len(ids))::BIGINT), lambda x: 1), ids), ',') AS ids, array_to_string(list_concat(list_transform(range((target - len(ids))::BIGINT), lambda x: -100), ids), ',') AS labels FROM f JOIN m USING (batch)")
def _(s, d):
    pairs = _enc(s, d).select("p_partkey", F.floor(F.col("p_partkey") / 10).alias("batch"), T.framed(F.col("ids"), F.slice("ids", 1, 1)).alias("ids")).withColumn("labels", F.col("ids"))
    out = T.padded_batches(pairs, "batch", labels="labels", multiple=4, left=True)
    return out.select("p_partkey", _join(F.col("ids")).alias("ids"), _join(F.col("labels")).alias("labels"))


@_add("m05_attention_mask", _ENC + "SELECT p_partkey, len(ids) AS ones, (6 - len(ids))::BIGINT AS zeros FROM i")
def _(s, d):
    mask = F.transform(T.padded(F.col("ids"), F.lit(6)), lambda x: (x != 1).cast("int"))
    ones = F.aggregate(mask, F.lit(0), lambda a, x: a + x)
    return _enc(s, d).select("p_partkey", ones.cast("long").alias("ones"), (F.size(mask) - ones).cast("long").alias("zeros"))


@_add("t17_mean_pooling", "SELECT vec_id, round(list_avg(embedding[1:32]), 6) AS first_half, round(list_avg(embedding), 6) AS whole FROM embeddings")
def _(s, d):
    def mean(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(c)

    return _t(s, d, "embeddings").select("vec_id", F.round(mean(F.slice("embedding", 1, 32)), 6).alias("first_half"), F.round(mean(F.col("embedding")), 6).alias("whole"))


@_add("g47_signed_rank", "SELECT event_type, count(*) AS n, round(sum(CASE WHEN delta > 0 THEN r ELSE 0 END), 6) AS w_plus, round(sum(CASE WHEN delta < 0 THEN r ELSE 0 END), 6) AS w_minus FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY event_type, abs(delta)) - 1) / 2.0e0 AS r FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) - 1000 AS delta FROM events) WHERE delta <> 0) GROUP BY 1")
def _(s, d):
    e = _t(s, d, "events").select("event_type", (F.round(F.col("value") * 100).cast("long") - 1000).alias("delta"))
    out = St.signed_rank(e, ["event_type"], "delta")
    return out.select("event_type", "n", F.round("w_plus", 6).alias("w_plus"), F.round("w_minus", 6).alias("w_minus"))


@_add("g33_calibration", "WITH e AS (SELECT list_distinct([" + ", ".join(f"quantile_cont(value, 0.{k})" for k in range(1, 10)) + "]) AS edges FROM events) SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(value), 6) AS mean_predicted, round(avg(user_id), 6) AS mean_actual, round(avg(abs(value - user_id)), 6) AS mae FROM (SELECT value, user_id, len(list_filter(edges, lambda x: value > x)) AS bin FROM events, e) GROUP BY 1")
def _(s, d):
    out = St.calibration(_t(s, d, "events"), "value", "user_id")
    return out.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_predicted", "mean_actual", "mae")])


@_add("g32_raster", "SELECT least(greatest(floor((embedding[1] + 0.5) / 1.0 * 8), 0), 7)::INTEGER AS px, least(greatest(floor((embedding[2] + 0.5) / 1.0 * 8), 0), 7)::INTEGER AS py, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS mean_x FROM embeddings GROUP BY 1, 2")
def _(s, d):
    e = _t(s, d, "embeddings").select(F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    out = St.raster(e.withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double")), "x", "y", -0.5, 0.5, 8)
    return out.select("px", "py", "n", F.round("mean_x", 6).alias("mean_x"))


@_add("w11_quotas", "WITH z AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), f AS (SELECT *, 100.0e0 * size / sum(size) OVER () AS share FROM z), g AS (SELECT source, size, floor(share)::BIGINT AS whole, row_number() OVER (ORDER BY share - floor(share) DESC, source DESC) AS place, (100 - sum(floor(share)) OVER ())::BIGINT AS spare FROM f) SELECT source, size, whole + (place <= spare)::BIGINT AS quota FROM g")
def _(s, d):
    return St.quotas(_t(s, d, "documents").groupBy("source").agg(F.count("*").alias("size")), "source", "size", 100)


# a budget of 40 over the sources: one each, whole parts, the largest fractions; all have enough rows
_BUDGETS = """
z AS (SELECT source, count(*) AS size FROM documents GROUP BY 1),
o AS (SELECT *, CASE WHEN count(*) OVER () <= 40 THEN 1 ELSE 0 END AS one FROM z),
x AS (SELECT *, (40 - sum(one) OVER ()) * (size - one) / sum(size - one) OVER ()::DOUBLE AS exact FROM o),
h AS (SELECT *, one + least(floor(exact)::BIGINT, size - one) AS has FROM x),
q AS (SELECT source, size, has + CASE WHEN size > has AND row_number() OVER (PARTITION BY size > has ORDER BY exact - (has - one) DESC, source DESC) <= 40 - sum(has) OVER () THEN 1 ELSE 0 END AS quota FROM h)"""


@_add("w11_budgets", f"WITH {_BUDGETS} SELECT source, size, quota::BIGINT AS quota FROM q")
def _(s, d):
    return St.budgets(_t(s, d, "documents").groupBy("source").agg(F.count("*").alias("size")), "source", "size", 40)


@_add("o10_compacted_sample", f"WITH {_BUDGETS}, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {draw_sql(13, 'sample', 'doc_id')}, doc_id) AS k FROM documents) SELECT r.source, doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_position FROM r JOIN q ON q.source IS NOT DISTINCT FROM r.source WHERE k <= quota")
def _(s, d):
    docs = _t(s, d, "documents").select("doc_id", "source")
    names = [r["source"] for r in docs.select("source").distinct().collect()]
    return Sp.subsample(docs, "source", "doc_id", names, 40, 13).select("source", "doc_id", "new_position")


@_add("t09_piece_match", "WITH RECURSIVE v AS (SELECT ['ca', 'car', 'ro', 'l', 'c', 'a', 'o'] AS words), c AS (SELECT c_custkey, lower(regexp_replace(c_mktsegment, '[^A-Z]', '', 'g')) AS t FROM customer), w(c_custkey, t, i, ids) AS (SELECT c_custkey, t, 1::BIGINT, []::BIGINT[] FROM c UNION ALL SELECT c_custkey, t, i + greatest(1, k), list_append(ids, CASE WHEN k = 0 THEN 3 ELSE 4 + list_position(words, substr(t, i, k)) END) FROM (SELECT w.*, words, CASE WHEN list_contains(words, substr(t, i, 3)) AND i + 2 <= length(t) THEN 3 WHEN list_contains(words, substr(t, i, 2)) AND i + 1 <= length(t) THEN 2 WHEN list_contains(words, substr(t, i, 1)) THEN 1 ELSE 0 END AS k FROM w, v WHERE i <= length(t))) SELECT c_custkey, array_to_string(ids, ',') AS ids FROM w WHERE i > length(t)")
def _(s, d):
    words = ["ca", "car", "ro", "l", "c", "a", "o"]
    vocab = {t: i for i, t in enumerate([*T.SPECIALS, *words])}
    pieces = text.pieces(F.lower(F.regexp_replace("c_mktsegment", "[^A-Z]", "")), text.SMILES_PIECE)
    return _t(s, d, "customer").select("c_custkey", _join(T.encode_pieces(pieces, vocab, 3)).alias("ids"))


@_add("o10_stratified_sample", QUERIES["w11_quotas"][1].rsplit("SELECT", 1)[0] + f", q AS (SELECT {QUERIES['w11_quotas'][1].rsplit('SELECT', 1)[1]}), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {draw_sql(13, 'sample', 'doc_id')}, doc_id) AS k FROM documents) SELECT r.source, doc_id FROM r JOIN q USING (source) WHERE k <= quota")
def _(s, d):
    docs = _t(s, d, "documents").select("doc_id", "source")
    q = St.quotas(docs.groupBy("source").agg(F.count("*").alias("size")), "source", "size", 100)
    u = draw(13, "sample", "doc_id")
    return placed(docs, ["source"], u, ["doc_id"]).join(F.broadcast(q), "source").where("place < quota").select("source", "doc_id")


@_add("g30_micro_macro", _Y + ", m AS (" + _AUROC.format(by="endpoint") + "), a AS (SELECT *, 0 AS everything FROM y) SELECT (SELECT round(auroc, 6) FROM (" + _AUROC.format(by="everything").replace("FROM y)", "FROM a)") + ")) AS micro, round(avg(auroc), 6) AS macro, count(*) AS n_endpoints FROM m")
def _(s, d):
    out = M.averaged_auroc(_y(s, d), "endpoint")
    return out.select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"), "n_endpoints")


@_add("g40_masked_accuracy", "SELECT event_type, count(*) FILTER (user_id % 5 <> 0) AS n, round(count(*) FILTER (user_id % 5 <> 0 AND user_id % 7 = event_id % 7) / count(*) FILTER (user_id % 5 <> 0), 6) AS accuracy FROM events GROUP BY 1")
def _(s, d):
    e = _t(s, d, "events").select("event_type", F.when(F.col("user_id") % 5 == 0, -100).otherwise(F.col("user_id") % 7).alias("label"), (F.col("event_id") % 7).alias("predicted"))
    return M.masked_accuracy(e, ["event_type"], "label", "predicted").withColumn("accuracy", F.round("accuracy", 6))


@_add("g48_weighted_mean", "SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS weighted_mean FROM events GROUP BY 1")
def _(s, d):
    return M.weighted_mean(_t(s, d, "events"), ["event_type"], "value", "user_id").withColumn("weighted_mean", F.round("weighted_mean", 6))


@_add("g32_category_counts", "SELECT least(greatest(floor((embedding[1] + 0.5) / 1.0 * 8), 0), 7)::INTEGER AS px, label, count(*) AS n FROM embeddings GROUP BY 1, 2")
def _(s, d):
    px = F.least(F.greatest(F.floor((F.col("embedding")[0].cast("double") + 0.5) * 8), F.lit(0)), F.lit(7)).cast("int")
    return _t(s, d, "embeddings").groupBy(px.alias("px"), "label").agg(F.count("*").alias("n"))


@_add("x15_scaled_by_training_rows", "WITH t AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer WHERE c_custkey % 10 <> 0) SELECT c_custkey, round((c_acctbal - m) / sd, 6) AS scaled FROM customer, t")
def _(s, d):
    c = _t(s, d, "customer")
    m = c.where("c_custkey % 10 <> 0").agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("sd"))
    return c.join(F.broadcast(m)).select("c_custkey", F.round((F.col("c_acctbal") - F.col("m")) / F.col("sd"), 6).alias("scaled"))


@_add("j17_count_similarity", "WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x) * 20)::DOUBLE) AS c FROM embeddings) SELECT vec_id, target, round(similarity, 6) AS similarity FROM (SELECT a.vec_id, b.vec_id AS target, coalesce(list_sum(list_transform(list_zip(a.c, b.c), lambda p: least(p[1], p[2]))) / nullif(list_sum(list_transform(list_zip(a.c, b.c), lambda p: greatest(p[1], p[2]))), 0), 0) AS similarity FROM w a JOIN w b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE similarity >= 0.4")
def _(s, d):
    c = F.transform("embedding", lambda x: F.floor(F.abs(x) * 20).cast("double"))
    rows = _t(s, d, "embeddings").select("vec_id", c.alias("c"))
    out = S.alike_counts(rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("c").alias("vector")), rows.select(F.col("vec_id").alias("target"), F.col("c").alias("vector")), 0.4)
    return out.select(F.col("query").alias("vec_id"), "target", F.round("similarity", 6).alias("similarity"))

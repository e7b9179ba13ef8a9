"""Queries of corpus preparation and string functions, over documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.functions import hashing, text
from lodeweave.operators import corpus as C
from lodeweave.operators import metrics as M
from lodeweave.operators import splits as Sp
from lodeweave.operators.order import exact_quantiles

QUERIES: dict = {}


def _add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


_UNIT = "(('0x' || substr(sha1({k}), 1, 13))::BIGINT::DOUBLE * pow(2::DOUBLE, -52) + ('0x' || substr(sha1({k}), 14, 13))::BIGINT::DOUBLE * pow(2::DOUBLE, -104) + ('0x' || substr(sha1({k}), 27, 13))::BIGINT::DOUBLE * pow(2::DOUBLE, -156))"
_SPLIT = f"CASE WHEN {_UNIT} < 0.1 THEN 'test' WHEN {_UNIT} < 0.2 THEN 'valid' ELSE 'train' END".format(k="concat('13:', doc_id)")


def _split(s, d):
    return C.with_split(_t(s, d, "documents"), F.col("doc_id").cast("string"), 0.1, 0.1, 13)


@_add("s01_batch_load", "SELECT region.* FROM region")
def _(s, d):
    return _t(s, d, "region")


@_add("s02_prefix_cap", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", "lang", "source").orderBy("doc_id").limit(100)


@_add("s07_pruned_read", "SELECT doc_id, n_chars FROM documents")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", "n_chars")


@_add("s08_schema_peek", "SELECT column_name, row_number() OVER () - 1 AS ordinal FROM (DESCRIBE SELECT * FROM documents)")
def _(s, d):
    return s.createDataFrame([(n, i) for i, n in enumerate(_t(s, d, "documents").columns)], "column_name string, ordinal long")


@_add("s30_collect_corpus", "SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS sequence FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", text.stripped(F.col("text")).alias("sequence")).where("sequence IS NOT NULL")


@_add("f01_required_columns", "SELECT doc_id, text FROM documents")
def _(s, d):
    return C.require_columns(_t(s, d, "documents"), ["doc_id", "text"]).select("doc_id", "text")


@_add("f02_basic_filters", "SELECT p_partkey FROM part WHERE coalesce(nullif(p_size, 7) BETWEEN 3 AND 40, true) AND coalesce(p_retailprice <= 1000, true) AND coalesce(lower(trim(p_type)) = 'economy', true)")
def _(s, d):
    size = F.nullif(F.col("p_size"), F.lit(7))
    return _t(s, d, "part").where(C.passes(size.between(3, 40), F.col("p_retailprice") <= 1000, F.lower(F.trim("p_type")) == "economy")).select("p_partkey")


@_add("f03_valid_only", "SELECT doc_id FROM labels WHERE quality = 1")
def _(s, d):
    return _t(s, d, "labels").where("quality = 1").select("doc_id")


@_add("f04_drop_nulls", "SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(s, d):
    return _t(s, d, "labels").dropna(how="any", subset=["quality", "toxic"])


@_add("f07_source_prefix", "SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def _(s, d):
    return _t(s, d, "documents").where(F.col("source").startswith("src1")).select("doc_id", "source")


@_add("f08_normalise_sequence", "SELECT p_partkey, nullif(trim(concat('  ', CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END, ' ')), '') AS sequence FROM part")
def _(s, d):
    padded = F.concat(F.lit("  "), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")), F.lit(" "))
    return _t(s, d, "part").select("p_partkey", text.stripped(padded).alias("sequence"))


_BUCKET = "0"
for _at in (1, 11, 21, 31):
    _BUCKET = f"(({_BUCKET} * 76::BIGINT + ('0x' || substr(sha1(source || '/' || doc_id), {_at}, 10))::BIGINT) % 100)"


@_add("f09_validation_bucket", f"SELECT doc_id FROM documents WHERE {_BUCKET} < 5")
def _(s, d):
    return _t(s, d, "documents").where(C.in_validation(F.concat("source", F.lit("/"), "doc_id"), 100, 5)).select("doc_id")


@_add("f10_split_aliases", "SELECT o_orderkey, 'valid' AS split FROM orders WHERE lower(o_orderstatus) IN ('f', 'p')")
def _(s, d):
    return _t(s, d, "orders").where(F.lower("o_orderstatus").isin("f", "p")).select("o_orderkey", F.lit("valid").alias("split"))


@_add("f11_exclude_listed", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def _(s, d):
    return _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels").where("toxic = 1"), "doc_id", "left_anti")


@_add("f12_drop_nan_embeddings", "SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isnan(x))) = 0")
def _(s, d):
    return _t(s, d, "embeddings").where(F.col("embedding").isNotNull() & ~F.exists("embedding", F.isnan)).select("vec_id")


@_add("f14_contains", "SELECT doc_id FROM documents WHERE text ILIKE '%all rights reserved%'")
def _(s, d):
    return _t(s, d, "documents").where(F.col("text").ilike("%all rights reserved%")).select("doc_id")


@_add("f15_canonical_names", "SELECT doc_id AS id, text AS sequence, coalesce(lang, 'none') AS language FROM documents")
def _(s, d):
    return _t(s, d, "documents").withColumnsRenamed({"doc_id": "id", "text": "sequence"}).select("id", "sequence", F.coalesce("lang", F.lit("none")).alias("language"))


@_add("f16_tagged_source", "SELECT s_suppkey AS id, s_name AS name, 'supplier' AS result_source FROM supplier")
def _(s, d):
    wanted = {"s_suppkey": "id", "s_name": "name", "s_comment": "comment"}
    x = _t(s, d, "supplier")
    return x.select(*[F.col(k).alias(v) for k, v in wanted.items() if k in x.columns], F.lit("supplier").alias("result_source"))


@_add("f17_winsorise", "WITH q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events) SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, q")
def _(s, d):
    e = _t(s, d, "events").select("event_id", "value")
    q = exact_quantiles(e, [], "value", [0.05, 0.95]).select(F.col("quantiles").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("event_id", F.round(F.least(F.greatest("value", F.col("q")[0]), F.col("q")[1]), 6).alias("value"))


@_add("f19_domain_violations", "SELECT 'duplicate_id' AS rule, (count(*) - count(DISTINCT doc_id))::BIGINT AS n FROM documents UNION ALL SELECT 'unknown_language', count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) FROM documents UNION ALL SELECT 'out_of_range', count(*) FILTER (n_chars NOT BETWEEN 1 AND 10000) FROM documents")
def _(s, d):
    one = _t(s, d, "documents").agg(
        (F.count("*") - F.countDistinct("doc_id")).alias("duplicate_id"),
        F.sum((~F.col("lang").isin("en", "de", "fr", "es")).cast("long")).alias("unknown_language"),
        F.sum((~F.col("n_chars").between(1, 10000)).cast("long")).alias("out_of_range"),
    )
    return one.unpivot([], ["duplicate_id", "unknown_language", "out_of_range"], "rule", "n")


@_add("f21_wildcard_repair", "SELECT p_partkey, replace(concat(p_name, '*'), '*', 'C') AS repaired FROM part")
def _(s, d):
    starred = F.concat("p_name", F.lit("*"))
    checked = F.when(starred.isNotNull(), starred).otherwise(F.raise_error(F.lit("null sequence")))
    return _t(s, d, "part").select("p_partkey", F.replace(checked, F.lit("*"), F.lit("C")).alias("repaired"))


@_add("f25_reliability_weights", "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 0.5 WHEN c_acctbal < 0 THEN 0.25 WHEN c_acctbal < 5000 THEN 0.75 ELSE 1.0 END::DOUBLE AS weight FROM customer")
def _(s, d):
    b = F.col("c_acctbal")
    return _t(s, d, "customer").select("c_custkey", F.when(b.isNull(), 0.5).when(b < 0, 0.25).when(b < 5000, 0.75).otherwise(1.0).alias("weight"))


@_add("u02_keep_first", "SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def _(s, d):
    return C.keep_first(_t(s, d, "documents").select("source", "lang", "doc_id"), "source", "doc_id")


@_add("x01_unit_interval", f"SELECT doc_id, {_UNIT.format(k='CAST(doc_id AS VARCHAR)')} AS u FROM documents")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", hashing.unit_interval(F.col("doc_id")).alias("u"))


@_add("x02_sequence_bucket", f"SELECT doc_id, {_BUCKET} AS bucket FROM documents")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", hashing.bucket(F.concat("source", F.lit("/"), "doc_id"), 100).alias("bucket"))


@_add("x03_hash_split", f"SELECT doc_id, {_SPLIT} AS split FROM documents")
def _(s, d):
    return _split(s, d).select("doc_id", "split")


@_add("x04_split_key", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_brand END), ''), nullif(trim(p_type), ''), p_name) AS split_key FROM part")
def _(s, d):
    brand = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_brand"))
    return _t(s, d, "part").select("p_partkey", text.first_filled(brand, F.col("p_type"), F.col("p_name")).alias("split_key"))


@_add("g01_error_counts", "SELECT coalesce(error, 'valid') AS error, count(*) AS n FROM (SELECT CASE WHEN length(text) < 20 THEN 'too_short' WHEN length(text) > 10000 THEN 'too_long' END AS error FROM documents) GROUP BY 1")
def _(s, d):
    n = F.length("text")
    e = F.coalesce(F.when(n < 20, "too_short").when(n > 10000, "too_long"), F.lit("valid"))
    return _t(s, d, "documents").groupBy(e.alias("error")).agg(F.count("*").alias("n"))


@_add("g02_split_counts", f"SELECT split, lang, count(*) AS n FROM (SELECT *, {_SPLIT} AS split FROM documents) GROUP BY 1, 2")
def _(s, d):
    return _split(s, d).groupBy("split", "lang").agg(F.count("*").alias("n"))


@_add("g50_next_id", "SELECT coalesce(max(TRY_CAST(replace(source, 'src', '') AS BIGINT)), 0) + 1 AS next_id FROM documents")
def _(s, d):
    return _t(s, d, "documents").agg((F.coalesce(F.max(F.expr("try_cast(replace(source, 'src', '') AS bigint)")), F.lit(0)) + 1).alias("next_id"))


@_add("g51_most_populated", "SELECT key, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY filled DESC, id) AS k FROM (SELECT user_id AS key, event_id AS id, (event_type <> 'error')::INT + (value > 10)::INT AS filled FROM events)) WHERE k = 1")
def _(s, d):
    e = _t(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), ((F.col("event_type") != "error").cast("int") + (F.col("value") > 10).cast("int")).alias("filled"))
    return e.groupBy("key").agg(F.min_by("id", F.struct(-F.col("filled"), "id")).alias("id"))


@_add("g52_fingerprints", "SELECT doc_id, sha256(concat_ws('|', doc_id, lang, source, n_chars)) AS fingerprint FROM documents")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("doc_id", "lang", "source", "n_chars")]), 256).alias("fingerprint"))


@_add("g53_split_overlap", f"WITH k AS (SELECT DISTINCT n_chars, {_SPLIT} AS split FROM documents), p AS (SELECT a.split AS split_a, b.split AS split_b, a.n_chars FROM k a JOIN k b ON a.n_chars = b.n_chars WHERE (a.split, b.split) IN (('train', 'valid'), ('train', 'test'), ('valid', 'test'))), r AS (SELECT *, row_number() OVER (PARTITION BY split_a, split_b ORDER BY n_chars) AS i FROM p) SELECT split_a, split_b, count(*) AS shared, string_agg(n_chars::VARCHAR, ',' ORDER BY n_chars::VARCHAR) FILTER (i <= 20) AS first_keys FROM r GROUP BY 1, 2")
def _(s, d):
    return C.split_overlap(_split(s, d), "n_chars", ["train", "valid", "test"])


@_add("g54_invalid_fraction", "SELECT lang, round(count(*) FILTER (length(text) < 100) / count(*), 6) AS short_fraction FROM documents GROUP BY 1")
def _(s, d):
    return _t(s, d, "documents").groupBy("lang").agg(F.round(F.sum((F.length("text") < 100).cast("long")) / F.count("*"), 6).alias("short_fraction"))


@_add("g55_manifest", "SELECT lang, count(*) AS n_rows, count(DISTINCT text) AS n_unique, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def _(s, d):
    # equal digests count as equal texts, so long texts are not kept in the aggregation
    return _t(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n_rows"), F.countDistinct(F.sha2(F.col("text").cast("binary"), 256)).alias("n_unique"), F.sum("n_chars").alias("chars"))


@_add("k01_shard_slices", "SELECT doc_id, (((row_number() OVER (ORDER BY doc_id)) * 8 - 1) // count(*) OVER ())::INTEGER AS shard FROM documents")
def _(s, d):
    return C.row_slices(_t(s, d, "documents").select("doc_id"), "doc_id", 8)


@_add("k04_example_rows", f"SELECT split, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS k FROM (SELECT doc_id, {_SPLIT} AS split FROM documents)) WHERE k <= 5")
def _(s, d):
    parts = [_split(s, d).where(F.col("split") == x).select("split", "doc_id").orderBy("doc_id").limit(5) for x in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_add("x16_clean_names", "SELECT p_partkey, trim(regexp_replace(lower(concat(p_brand, ' / ', p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS plain FROM part")
def _(s, d):
    return _t(s, d, "part").select("p_partkey", text.slug(F.concat("p_brand", F.lit(" / "), "p_name")).alias("slug"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "").alias("plain"))


@_add("x17_name_from_path", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, split_part(regexp_replace(url, '[?#].*$', ''), '/', -1) AS leaf FROM pages")
def _(s, d):
    return _t(s, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.substring_index(F.regexp_replace("url", r"[?#].*$", ""), "/", -1).alias("leaf"))


@_add("x18_result_key", "SELECT o_orderkey, concat_ws('_', o_orderstatus, o_orderpriority, o_custkey) AS key FROM orders")
def _(s, d):
    return _t(s, d, "orders").select("o_orderkey", F.concat_ws("_", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")).alias("key"))


@_add("x19_canonical_json", "SELECT p_partkey, concat('{\"brand\":\"', p_brand, '\",\"size\":', p_size, '}') AS json, substr(sha256(concat('{\"brand\":\"', p_brand, '\",\"size\":', p_size, '}')), 1, 16) AS version FROM part")
def _(s, d):
    j = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    return _t(s, d, "part").select("p_partkey", j.alias("json"), F.substring(F.sha2(j, 256), 1, 16).alias("version"))


@_add("x20_json_scalars", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(s, d):
    return _t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@_add("x21_metric_fallback", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.loss') AS DOUBLE), TRY_CAST(json_extract_string(props, '$.eval_loss') AS DOUBLE), TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS metric FROM events")
def _(s, d):
    keys = [F.expr(f"try_cast(get_json_object(props, '$.{k}') AS double)") for k in ("loss", "eval_loss", "k")]
    return _t(s, d, "events").select("event_id", F.coalesce(*keys).alias("metric"))


@_add("x22_run_status", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') AND bool_or(event_type = 'error') THEN 'complete' WHEN bool_or(event_type = 'purchase') THEN 'has_final_model' ELSE 'incomplete' END AS status FROM events GROUP BY 1")
def _(s, d):
    e = _t(s, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("final"), F.bool_or(F.col("event_type") == "error").alias("state"))
    return e.select("user_id", F.when(F.col("final") & F.col("state"), "complete").when(F.col("final"), "has_final_model").otherwise("incomplete").alias("status"))


@_add("x23_checkpoint_step", "SELECT s_suppkey, TRY_CAST(split_part(concat('run-a/checkpoint-', s_suppkey * 10), '-', -1) AS INTEGER) AS step FROM supplier")
def _(s, d):
    return _t(s, d, "supplier").select("s_suppkey", F.substring_index(F.concat(F.lit("run-a/checkpoint-"), F.col("s_suppkey") * 10), "-", -1).try_cast("int").alias("step"))


@_add("x24_number_formats", "SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN concat(floor(o_totalprice / 1000)::BIGINT, 'k') ELSE floor(o_totalprice)::BIGINT::VARCHAR END AS compact FROM orders")
def _(s, d):
    p = F.col("o_totalprice")
    return _t(s, d, "orders").select("o_orderkey", F.when(p >= 1000, F.concat(F.floor(p / 1000), F.lit("k"))).otherwise(F.floor(p).cast("string")).alias("compact"))


@_add("x25_scalar_maths", "SELECT c_custkey, round(ln(abs(c_acctbal) + 1), 6) AS log_balance, round(sqrt(abs(c_acctbal)), 6) AS root, least(greatest(c_acctbal, 0), 5000)::DOUBLE AS clipped FROM customer")
def _(s, d):
    b = F.col("c_acctbal")
    return _t(s, d, "customer").select("c_custkey", F.round(F.log(F.abs(b) + 1), 6).alias("log_balance"), F.round(F.sqrt(F.abs(b)), 6).alias("root"), F.least(F.greatest(b, F.lit(0.0)), F.lit(5000.0)).alias("clipped"))


@_add("x27_clip_bounds", "SELECT event_type, round(greatest(quantile_cont(value, 0.01), -100), 6) AS low, round(least(quantile_cont(value, 0.99), 100), 6) AS high FROM events GROUP BY 1")
def _(s, d):
    q = F.col("quantiles")
    out = exact_quantiles(_t(s, d, "events"), ["event_type"], "value", [0.01, 0.99])
    return out.select("event_type", F.round(F.greatest(q[0], F.lit(-100.0)), 6).alias("low"), F.round(F.least(q[1], F.lit(100.0)), 6).alias("high"))


@_add("j01_inner_join", "SELECT l.doc_id, d.lang, l.quality FROM labels l JOIN documents d USING (doc_id)")
def _(s, d):
    return _t(s, d, "labels").join(_t(s, d, "documents"), "doc_id").select("doc_id", "lang", "quality")


@_add("j02_left_join", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(s, d):
    return _t(s, d, "documents").join(_t(s, d, "labels"), "doc_id", "left").select("doc_id", "quality")


@_add("j03_first_row_join", "SELECT n.n_nationkey, n.n_name, s.s_suppkey FROM nation n JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey")
def _(s, d):
    first = C.keep_first(_t(s, d, "supplier"), "s_nationkey", "s_suppkey")
    return _t(s, d, "nation").join(first, F.col("n_nationkey") == F.col("s_nationkey")).select("n_nationkey", "n_name", "s_suppkey")


@_add("j04_many_to_one", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    nation = _t(s, d, "nation")
    # the count fails the join, in the same job, if a key repeats
    one = nation.withColumn("copies", F.count("*").over(Window.partitionBy("n_nationkey"))).where(F.when(F.col("copies") == 1, True).otherwise(F.raise_error(F.lit("the right side repeats a key")).cast("boolean")))
    return _t(s, d, "customer").join(one, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@_add("j10_positional_join", "SELECT l.doc_id, e.label FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id")
def _(s, d):
    return _t(s, d, "labels").join(_t(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "label")


@_add("j11_scatter", "SELECT d.doc_id, e.label FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.label < 5")
def _(s, d):
    e = _t(s, d, "embeddings").where("label < 5").select(F.col("vec_id").alias("doc_id"), "label")
    return _t(s, d, "documents").select("doc_id").join(e, "doc_id", "left")


@_add("j12_append_absent", "SELECT o_custkey AS key FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def _(s, d):
    old = _t(s, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("key"))
    return old.unionByName(_t(s, d, "customer").select(F.col("c_custkey").alias("key")).join(old, "key", "left_anti"))


@_add("j15_coverage_grid", "SELECT n.n_name, t.event_type, CASE WHEN e.n IS NULL THEN 'absent' WHEN e.n > 40 THEN 'full' ELSE 'partial' END AS status FROM nation n CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN (SELECT user_id % 30 AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2) e ON e.k = n.n_nationkey AND e.event_type = t.event_type")
def _(s, d):
    e = _t(s, d, "events")
    grid = _t(s, d, "nation").crossJoin(F.broadcast(e.select("event_type").distinct()))
    n = e.groupBy((F.col("user_id") % 30).cast("int").alias("n_nationkey"), "event_type").agg(F.count("*").alias("n"))
    return grid.join(n, ["n_nationkey", "event_type"], "left").select("n_name", "event_type", F.when(F.col("n").isNull(), "absent").when(F.col("n") > 40, "full").otherwise("partial").alias("status"))


@_add("j16_parameter_grid", "SELECT size, brand FROM (SELECT DISTINCT p_size AS size FROM part) CROSS JOIN (SELECT DISTINCT p_brand AS brand FROM part) EXCEPT SELECT p_size, p_brand FROM part")
def _(s, d):
    # the product of two lists of parameters, without the pairs that are populated
    p = _t(s, d, "part")
    sizes, brands = p.select(F.col("p_size").alias("size")).distinct(), p.select(F.col("p_brand").alias("brand")).distinct()
    done = p.select(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return sizes.crossJoin(brands).join(done, ["size", "brand"], "left_anti")


@_add("w06_sequential_ids", "SELECT p_name, row_number() OVER (ORDER BY p_name) AS id FROM (SELECT DISTINCT p_name FROM part)")
def _(s, d):
    return C.numbered(_t(s, d, "part").select("p_name").distinct(), [F.col("p_name")], "id")


@_add("k05_append_result", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + 1, 'appended'")
def _(s, d):
    old = _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return old.unionByName(old.agg((F.max("id") + 1).alias("id")).withColumn("name", F.lit("appended")))


@_add("k06_delete_rows", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')")
def _(s, d):
    return _t(s, d, "orders").where(~((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"))).select("o_orderkey")


@_add("k08_latest_status", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def _(s, d):
    return _t(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))


@_add("k15_submission_checks", "SELECT count(*) AS n_rows, count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS bad_values, (count(*) - count(DISTINCT event_id))::BIGINT AS repeated_names FROM events")
def _(s, d):
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return _t(s, d, "events").agg(F.count("*").alias("n_rows"), F.sum(bad.cast("long")).alias("bad_values"), (F.count("*") - F.countDistinct("event_id")).alias("repeated_names"))


@_add("o07_seeded_order", f"SELECT doc_id, lang FROM documents ORDER BY {hashing.draw_sql(13, 'sample', 'doc_id')}, doc_id LIMIT 200")
def _(s, d):
    return C.sample(_t(s, d, "documents").select("doc_id", "lang"), "doc_id", 200, 13)


@_add("o09_seeded_sample", f"SELECT p_partkey FROM part ORDER BY {hashing.draw_sql(7, 'sample', 'p_partkey')}, p_partkey LIMIT 64")
def _(s, d):
    return C.sample(_t(s, d, "part").select("p_partkey"), "p_partkey", 64, 7)


# both engines read these: names of splits as they come, sequences that may be blank
_SPLIT_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN 'Validation' WHEN 1 THEN 'val ' WHEN 2 THEN 'valid' WHEN 3 THEN 'train' END"
_SEQUENCE = "CASE WHEN o_orderkey % 7 = 0 THEN '  ' WHEN o_orderkey % 7 = 1 THEN NULL ELSE o_orderpriority END"


@_add("f10_split_filter", f"SELECT o_orderkey FROM orders WHERE lower(trim({_SPLIT_TEXT})) IN ('valid', 'validation', 'val') AND trim({_SEQUENCE}) <> ''")
def _(s, d):
    rows = _t(s, d, "orders").select("o_orderkey", F.expr(_SPLIT_TEXT).alias("split"), F.expr(_SEQUENCE).alias("sequence"))
    return Sp.of_split(rows, "split", "valid", "sequence").select("o_orderkey")


@_add("f11_excluded_splits", f"SELECT split, count(*) AS n FROM (SELECT doc_id, {_SPLIT} AS split FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def _(s, d):
    out = Sp.excluded(_split(s, d), "doc_id", "split", _t(s, d, "labels").where("toxic = 1"))
    return out.groupBy("split").agg(F.count("*").alias("n"))


@_add("f12_dropped_count", "SELECT count(*) FILTER (WHERE good) AS kept, count(*) FILTER (WHERE NOT good) AS dropped FROM (SELECT embedding IS NOT NULL AND label <> 3 AS good FROM embeddings)")
def _(s, d):
    vector = F.when(F.col("label") == 3, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    kept, n = Sp.without_nan(_t(s, d, "embeddings").select(vector.alias("v")), "v")
    return kept.agg(F.count("*").alias("kept")).join(n.select(F.col("n").alias("dropped")))


@_add("f15_coalesced_aliases", "SELECT coalesce(nullif(trim(CASE WHEN p_size > 25 THEN ' ' ELSE p_brand END), ''), p_type) AS name, p_partkey FROM part")
def _(s, d):
    p = _t(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_brand")).alias("Brand"), F.col("p_type").alias("kind"))
    return C.canonical(p, {"name": ["brand", "kind"]})


@_add("x17_short_names", "SELECT page_id, CASE WHEN leaf LIKE '%gpt%' THEN leaf ELSE split_part(leaf, '.', 1) END AS short FROM (SELECT page_id, split_part(concat('m/', CASE WHEN page_id % 3 = 0 THEN 'gpt-' ELSE 'v' END, page_id, '.5.bin'), '/', -1) AS leaf FROM pages)")
def _(s, d):
    path = F.concat(F.lit("m/"), F.when(F.col("page_id") % 3 == 0, "gpt-").otherwise("v"), F.col("page_id").cast("string"), F.lit(".5.bin"))
    return _t(s, d, "pages").select("page_id", text.short_name(path).alias("short"))


@_add("x24_all_formats", "SELECT o_orderkey, format('{:,}', round(o_totalprice)::BIGINT) AS thousands, CASE WHEN o_totalprice * 50 >= 1000000 THEN regexp_replace(printf('%.1f', round_even(o_totalprice * 50 / 1000000, 1)), '\\.0$', '') || 'M' WHEN o_totalprice * 50 >= 1000 THEN regexp_replace(printf('%.1f', round_even(o_totalprice * 50 / 1000, 1)), '\\.0$', '') || 'k' ELSE printf('%.0f', o_totalprice * 50) END AS compact, printf('%.1f', round_even(o_custkey / 1000 * 100, 1)) || '%' AS share FROM orders")
def _(s, d):
    p = F.col("o_totalprice")
    return _t(s, d, "orders").select("o_orderkey", text.thousands(F.round(p)).alias("thousands"), text.compact(p * 50).alias("compact"), text.percent(F.col("o_custkey") / 1000).alias("share"))


@_add("x25_powers", "SELECT c_custkey, round(exp(c_acctbal / 1000), 6) AS e, round(pow(10, -2 + 5 * (c_custkey % 10) / 9e0), 6) AS step, round_even(c_acctbal, 0) AS whole, floor(c_acctbal)::BIGINT AS down FROM customer")
def _(s, d):
    b = F.col("c_acctbal")
    # ten steps from 0.01 to 1000, even on the scale of powers
    step = F.pow(F.lit(10.0), F.lit(-2.0) + F.lit(5.0) * (F.col("c_custkey") % 10) / F.lit(9.0))
    return _t(s, d, "customer").select("c_custkey", F.round(F.exp(b / 1000), 6).alias("e"), F.round(step, 6).alias("step"), F.bround(b, 0).alias("whole"), F.floor(b).alias("down"))


# both engines read these: an error of measurement, a difference, whether there is one, an efficacy
_ASSAY = {"se": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE abs(c_acctbal) / 10000 END", "delta": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal / 3000 END", "has": "c_custkey % 5 <> 0", "emax": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 11) / 10e0 END"}


@_add("f25_noise_diagonal", "SELECT c_custkey, round((s * s + 0.04) / (ws * we), 6) AS noise FROM (SELECT c_custkey, greatest(coalesce(se, 0.3), 0.2) AS s, CASE WHEN NOT has OR delta IS NULL THEN 0.75e0 WHEN delta >= 1.5 THEN 1e0 WHEN delta >= 0.5 THEN 0.6e0 ELSE 0.3e0 END AS ws, CASE WHEN emax IS NULL THEN 0.85e0 WHEN emax >= 0.7 THEN 1e0 WHEN emax >= 0.4 THEN 0.85e0 ELSE 0.7e0 END AS we FROM (SELECT c_custkey, " + ", ".join(f"{e} AS {k}" for k, e in _ASSAY.items()) + " FROM customer))")
def _(s, d):
    rows = _t(s, d, "customer").select("c_custkey", *[F.expr(e.replace("10e0", "10.0D")).alias(k) for k, e in _ASSAY.items()])
    return rows.select("c_custkey", F.round(M.noise(F.col("se"), F.col("delta"), F.col("has"), F.col("emax"), 0.3, 0.2), 6).alias("noise"))


@_add("u07_ordered_distinct", "SELECT page_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') AS words FROM (SELECT page_id, list_concat(regexp_extract_all(url, '[a-z]+'), list_reverse(regexp_extract_all(url, '[a-z]+'))) AS w FROM pages)")
def _(s, d):
    words = F.regexp_extract_all("url", F.lit("[a-z]+"), F.lit(0))
    return _t(s, d, "pages").select("page_id", F.array_join(F.array_distinct(F.concat(words, F.reverse(words))), ",").alias("words"))


@_add("f18_label_columns", "SELECT column_name, row_number() OVER () - 1 AS ordinal FROM (DESCRIBE SELECT * EXCLUDE (doc_id) FROM labels)")
def _(s, d):
    return s.createDataFrame([(n, i) for i, n in enumerate(C.label_columns(_t(s, d, "labels").columns, {"Doc_ID"}))], "column_name string, ordinal long")


@_add("f20_skipped_names", "SELECT p_partkey, p_brand FROM part WHERE regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') NOT IN ('brand11', 'brand3')")
def _(s, d):
    return C.skipping(_t(s, d, "part"), "p_brand", ["BRAND 11", "brand_3"]).select("p_partkey", "p_brand")


@_add("f13_unparsable_rows", "SELECT l_linestatus AS split, count(*) FILTER (l_returnflag = 'N') AS kept, count(*) FILTER (l_returnflag <> 'N') AS dropped FROM lineitem GROUP BY 1")
def _(s, d):
    rows = _t(s, d, "lineitem").select(F.col("l_linestatus").alias("split"), "l_returnflag")
    return C.parsable(rows, text.looks_like_smiles(F.col("l_returnflag")), "split")[1]


@_add("x26_iso_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def _(s, d):
    # timestamps without a zone are UTC already
    return _t(s, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@_add("j03_first_row_two_keys", "SELECT c_custkey, first_part FROM customer JOIN (SELECT c_nationkey AS k1, c_mktsegment AS k2, min(c_custkey) AS first_part FROM customer GROUP BY 1, 2) ON k1 = c_nationkey AND k2 = c_mktsegment")
def _(s, d):
    c = _t(s, d, "customer")
    first = c.groupBy(F.col("c_nationkey").alias("k1"), F.col("c_mktsegment").alias("k2")).agg(F.min_by("c_custkey", "c_custkey").alias("first_part"))
    return c.join(first, (F.col("k1") == F.col("c_nationkey")) & (F.col("k2") == F.col("c_mktsegment"))).select("c_custkey", "first_part")


@_add("x19_sorted_json", "SELECT p_partkey, concat('{\"brand\":\"', p_brand, '\",\"size\":\"', p_size, '\",\"type\":\"', p_type, '\"}') AS json, substr(sha256(concat('{\"brand\":\"', p_brand, '\",\"size\":\"', p_size, '\",\"type\":\"', p_type, '\"}')), 1, 16) AS version FROM part")
def _(s, d):
    pairs = F.create_map(F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand")
    json = C.sorted_json(pairs)
    return _t(s, d, "part").select("p_partkey", json.alias("json"), F.substring(F.sha2(json, 256), 1, 16).alias("version"))

"""Queries of masks: letters of part names as tokens, framed, some rows padded, batches of 32 rows."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from lodeweave.functions.hashing import draw_sql
from lodeweave.operators import masking as M
from lodeweave.operators import tokens as T

QUERIES: dict = {}


def _add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


_VOCAB = {**T.SPECIALS, **{f"[{c}]": 5 + k for k, c in enumerate(string.ascii_uppercase)}}
_P, _SEED = 0.3, 5


def _rows(s, d):
    letters = F.transform(F.regexp_extract_all(F.upper("p_name"), F.lit("[A-Z]"), F.lit(0)), lambda c: F.ascii(c) - 60)
    framed = T.framed(letters)
    padded = T.padded(framed, F.when(F.col("p_size") % 3 == 0, 48).otherwise(0))
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("row_id"), F.floor(F.col("p_partkey") / 32).alias("batch"), padded.alias("ids"))


def _out(df, *columns):
    return df.select(F.col("row_id").alias("p_partkey"), *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in columns])


#: Places and tokens as rows; whether a place may be masked; where the next one that may not is.
_PLACES = """
seq AS (
  SELECT p_partkey AS r, p_partkey // 32 AS batch, p_size % 3 = 0 AS long,
         list_concat([0], list_concat(list_transform(regexp_extract_all(upper(p_name), '[A-Z]'), lambda c: ascii(c) - 60), [2])) AS ids FROM part),
padded AS (SELECT r, batch, CASE WHEN long THEN list_concat(ids, list_transform(range(48 - len(ids)), lambda k: 1)) ELSE ids END AS ids FROM seq),
flat AS (SELECT r, batch, unnest(ids) AS id, unnest(range(len(ids))) AS pos, len(ids) AS n FROM padded),
places AS (
  SELECT *, id NOT IN (0, 1, 2, 4) AS may,
         coalesce(min(CASE WHEN id IN (0, 1, 2, 4) THEN pos END) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) AS stop
  FROM flat)"""
_LABELS = "string_agg(CASE WHEN masked THEN id ELSE -100 END::VARCHAR, ',' ORDER BY pos) AS labels"


def _standard_sql(p: float) -> str:
    return f"""{_PLACES},
own AS (SELECT *, may AND {draw_sql(_SEED, "mask", "r", "pos")} < {p} AS hit FROM places),
forced AS (
  SELECT arg_min([r, pos], {draw_sql(_SEED, "force", "r", "pos")}) FILTER (may) AS place FROM own GROUP BY batch HAVING NOT bool_or(hit)),
final AS (SELECT own.*, hit OR place IS NOT NULL AS masked FROM own LEFT JOIN forced ON place = [r, pos])"""


@_add("m01_bernoulli_mask", f"WITH {_standard_sql(0.003)} SELECT r AS p_partkey, {_LABELS} FROM final GROUP BY r")
def _(s, d):
    # so few masks that some batches get theirs by the rule
    return _out(M.corrupted(M.standard(_rows(s, d), 0.003, _SEED), _SEED, len(_VOCAB)), "labels")


def _span_sql(weight: str) -> str:
    """Spans drawn one after the other, with the set of places masked so far."""
    longer = " + ".join(f"({draw_sql(_SEED, 'length', 'r', 'pos')} < {(1 - 0.4) ** t!r})::INT" for t in range(1, 5))
    return f"""WITH RECURSIVE {_PLACES},
tried AS (
  SELECT r, pos, least(pos + 1 + {longer}, n, stop) AS upto, row_number() OVER (PARTITION BY r ORDER BY -ln({draw_sql(_SEED, "start", "r", "pos")}) / {weight}, pos) AS k
  FROM places WHERE may),
budgets AS (SELECT r, count(*) AS n, greatest(1, round_even(count(*) * {_P}e0, 0)) AS budget FROM tried GROUP BY r),
walk(r, k, masked) AS (
  SELECT r, 0::BIGINT, []::BIGINT[] FROM budgets
  UNION ALL
  SELECT w.r, w.k + 1, CASE WHEN list_contains(masked, t.pos) THEN masked ELSE list_distinct(list_concat(masked, range(t.pos, t.upto))) END
  FROM walk w JOIN budgets b ON b.r = w.r JOIN tried t ON t.r = w.r AND t.k = w.k + 1 WHERE len(masked) < budget),
done AS (SELECT r, arg_max(masked, k) AS held FROM walk GROUP BY r),
final AS (SELECT p.*, coalesce(list_contains(held, pos), false) AS masked FROM places p LEFT JOIN done USING (r))
SELECT r AS p_partkey, {_LABELS} FROM final GROUP BY r"""


@_add("m02_span_mask", _span_sql("1e0"))
def _(s, d):
    return _out(M.corrupted(M.spans(_rows(s, d), _P, 0.4, 5, _SEED), _SEED, len(_VOCAB)), "labels")


@_add("m03_hetero_span_mask", _span_sql("(CASE WHEN chr(id + 60) IN ('N', 'O', 'S', 'P', 'F', 'I') THEN 4e0 ELSE 1e0 END)"))
def _(s, d):
    return _out(M.corrupted(M.spans(_rows(s, d), _P, 0.4, 5, _SEED, weight=M.start_weights(_VOCAB, 4.0)), _SEED, len(_VOCAB)), "labels")


_CORRUPTED = f"""WITH {_standard_sql(_P)},
changed AS (
  SELECT *, CASE WHEN NOT masked THEN id WHEN {draw_sql(_SEED, "replace", "r", "pos")} < 0.8 THEN 4
                 WHEN {draw_sql(_SEED, "random", "r", "pos")} < 0.5 THEN floor({draw_sql(_SEED, "other", "r", "pos")} * 26)::INT + 5 ELSE id END AS input
  FROM final),
rowed AS (SELECT r AS p_partkey, string_agg(input::VARCHAR, ',' ORDER BY pos) AS inputs, {_LABELS}, count(*) FILTER (may) AS e, count(*) FILTER (masked) AS m FROM changed GROUP BY r)"""


@_add("m04_corruption", f"{_CORRUPTED} SELECT p_partkey, inputs, labels FROM rowed")
def _(s, d):
    return _out(M.corrupted(M.standard(_rows(s, d), _P, _SEED), _SEED, len(_VOCAB)), "inputs", "labels")


@_add("m06_frozen_set", f"{_CORRUPTED} SELECT count(*) AS n_rows, sum(e)::BIGINT AS n_eligible, sum(m)::BIGINT AS n_masked, round(sum(m) / sum(e), 6) AS fraction, 0::BIGINT AS n_illegal, sum(('0x' || substr(sha256(concat_ws('|', p_partkey, inputs, labels)), 1, 12))::BIGINT)::BIGINT AS fingerprint FROM rowed")
def _(s, d):
    facts = M.frozen_facts(M.corrupted(M.standard(_rows(s, d), _P, _SEED), _SEED, len(_VOCAB)))
    # the sum outgrows a long from 2^16 rows or so: it wraps at 2^63
    return facts.withColumn("fraction", F.round("fraction", 6)).withColumn("fingerprint", F.pmod("fingerprint", F.lit(str(1 << 63)).cast("decimal(38,0)")).cast("long"))


# eight tokens of eight numbers each; ids below 5 are special, 1 is padding
_TOKENS = """
t AS (SELECT vec_id, k, CASE WHEN vec_id % 4 = 0 THEN k % 3 ELSE (vec_id * 7 + k * 3) % 9 END AS id, unnest(embedding[8 * k + 1:8 * k + 8])::DOUBLE AS v, unnest(range(8)) AS dim FROM embeddings, range(8) r(k)),
n AS (SELECT vec_id, dim, avg(v) FILTER (id > 4) AS free, avg(v) FILTER (id <> 1) AS seen FROM t GROUP BY 1, 2)"""


@_add("t17_special_pooling", f"WITH {_TOKENS} SELECT vec_id, round(sum(coalesce(free, seen)), 6) AS total, round(max(coalesce(free, seen)), 6) AS largest FROM n GROUP BY 1")
def _(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    places = F.sequence(F.lit(0), F.lit(7))
    hidden = F.transform(places, lambda k: F.slice("e", 8 * k + 1, 8))
    ids = F.transform(places, lambda k: F.when(F.col("vec_id") % 4 == 0, k % 3).otherwise((F.col("vec_id") * 7 + k * 3) % 9).cast("int"))
    rows = e.select("vec_id", hidden.alias("hidden"), ids.alias("ids")).select("vec_id", M.pooled(F.col("hidden"), F.col("ids")).alias("p"))
    return rows.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("p"), 6).alias("largest"))

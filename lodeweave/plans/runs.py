"""Queries of run logs: events as logs of users, with metrics that are missing, null, booleans or text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.sources import runs as R

QUERIES: dict = {}


def _add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


# both engines read this: an event as a JSON object
_EVENT = """concat('{"step": ', event_id, CASE event_type
  WHEN 'view' THEN concat(', "loss": ', value) WHEN 'click' THEN concat(', "eval_loss": "', value, '"') WHEN 'error' THEN ', "loss": null, "eval_loss": 0.001'
  WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN ', "loss": true' ELSE ', "loss": "n/a"' END ELSE ', "other": 0' END, ', "props": ', props, '}')"""


def _events(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), F.expr(_EVENT).alias("event"))


_BEST = """SELECT user_id AS run, min(v) AS best, arg_min(event_id, (v, event_id)) AS best_pos, arg_min(event_id, (v, event_id)) AS best_step, arg_max(v, event_id) AS last
FROM (SELECT user_id, event_id, value AS v FROM events WHERE event_type IN ('view', 'click')) GROUP BY 1"""


@_add("g15_best_event", _BEST)
def _(s, d):
    return R.best_event(_events(s, d), "loss", True)


@_add("x20_json_paths", """
WITH p AS (SELECT event_id, event_type, value, json_extract_string(props, '$.k') AS k, user_id FROM events)
SELECT event_id, 'props.k' AS path, 'number' AS kind, k AS value FROM p
UNION ALL SELECT event_id, 'seen[0].type', 'text', event_type FROM p
UNION ALL SELECT event_id, 'seen[1][0]', 'number', user_id::VARCHAR FROM p
UNION ALL SELECT event_id, 'seen[1][1]', 'null', NULL FROM p
UNION ALL SELECT event_id, 'big', 'bool', CASE WHEN value > 50 THEN 'true' ELSE 'false' END FROM p""")
def _(s, d):
    doc = F.expr("""concat('{"props": ', props, ', "seen": [{"type": "', event_type, '", "none": {}}, [', user_id, ', null]], "big": ', CAST(value > 50 AS STRING), ', "empty": []}')""")
    return R.json_paths(s.read.parquet(f"{d}/events.parquet").select("event_id", doc.alias("doc")), ["event_id"], "doc")


_SUMMARY = """CASE c_custkey % 4 WHEN 0 THEN concat('{"loss": ', c_nationkey, ', "eval_loss": 1}') WHEN 1 THEN concat('{"eval_loss": "', c_nationkey, '.5"}') WHEN 2 THEN '{"other": 1}' ELSE '{"loss": "none"}' END"""


@_add("x21_selection_metric", f"WITH best AS ({_BEST}) SELECT c_custkey AS run, CASE c_custkey % 4 WHEN 0 THEN c_nationkey::DOUBLE WHEN 1 THEN c_nationkey + 0.5e0 WHEN 2 THEN coalesce(best, 'nan'::DOUBLE) ELSE 'nan'::DOUBLE END AS selection_metric, best_step FROM customer LEFT JOIN best ON run = c_custkey")
def _(s, d):
    summaries = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("run"), F.expr(_SUMMARY).alias("json"))
    found = summaries.join(R.best_event(_events(s, d), "loss", True), "run", "left")
    return found.select("run", R.selection_metric(F.col("json"), "loss", F.col("best")).alias("selection_metric"), "best_step")

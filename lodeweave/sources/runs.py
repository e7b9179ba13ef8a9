"""Run folders: documents in JSON, nested logs, paths of their values, the metric that a run is chosen by."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.sources.readers import _hadoop

#: Documents that make a folder a run.
MARKERS = ("run_args.json", "trainer_state.json")


def run_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders of root that hold one of `MARKERS`, in order; hidden ones are skipped. Only names are listed."""
    fs, _ = _hadoop(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = {s.getPath().getParent().getName() for m in MARKERS for s in fs.globStatus(path(f"{root}/*/{m}")) or []}
    return sorted(n for n in found if not n.startswith("."))


def run_documents(spark: SparkSession, root: str) -> DataFrame:
    """(run, document, json): every JSON document of every run folder; document is the file's name without suffix.

    A run's document is one row of text, so files are read by as many tasks as there are partitions of them.
    """
    runs = run_folders(spark, root)
    if not runs:
        return spark.createDataFrame([], "run string, document string, json string")
    files = spark.read.text([f"{root}/{r}/*.json" for r in runs], wholetext=True)
    name = F.col("_metadata.file_path")
    found = files.select(F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract(name, r"([^/]+)\.json$", 1).alias("document"), F.col("value").alias("json"))
    return found.withColumn("run", F.url_decode("run")).withColumn("document", F.url_decode("document"))


def _leaves(value, path: str) -> Iterator[tuple[str, str, str | None]]:
    """(path, kind, text) of every scalar; a stack instead of recursion, so depth is no limit."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{at}.{k}" if at else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{at}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        else:
            kind = "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "text"
            yield at, kind, None if v is None else v if isinstance(v, str) else json.dumps(v)


def json_paths(df: DataFrame, keys: list[str], column: str, nested: bool = True) -> DataFrame:
    """(keys, path, kind, value): each scalar of a JSON text by its dotted path, list places as [i].

    kind is null, bool, number or text; value is text, numbers and booleans as in JSON. Without `nested` only the
    scalars of the outermost object. Empty lists and objects have no scalar; nulls and texts that are no JSON give no row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                try:
                    value = json.loads(text) if text is not None else {}
                except ValueError:
                    continue
                if not nested:
                    value = {k: v for k, v in value.items() if not isinstance(v, dict | list)} if isinstance(value, dict) else {}
                found = list(_leaves(value, ""))
                rows += found
                owner += [i] * len(found)
            cols = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array([r[k] for r in rows], pa.string()) for k in range(3)]], [*keys, "path", "kind", "value"])

    return df.select(*keys, column).mapInArrow(run, f"{schema}, path string, kind string, value string")


def log_events(documents: DataFrame, field: str = "log_history") -> DataFrame:
    """(run, pos, event): the objects of a list in each document `trainer_state` of `run_documents`, in their order."""
    events = F.from_json("json", f"struct<`{field}`:array<string>>")[field]
    return documents.where("document = 'trainer_state'").select("run", F.posexplode(events).alias("pos", "event"))


def metric_of(event: Column, metric: str) -> Column:
    """The metric of a JSON object as a number: under its name, else under `eval_` and its name; null where that isn't a finite number.

    Numbers in quotes count, booleans don't. A name that is there with a null hides the other one.
    """
    given = F.from_json(event, "map<string,string>")
    value = F.when(F.map_contains_key(given, metric), F.try_element_at(given, F.lit(metric))).otherwise(F.try_element_at(given, F.lit(f"eval_{metric}")))
    number = value.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def best_event(events: DataFrame, metric: str, lower: bool, run: str = "run", pos: str = "pos", event: str = "event") -> DataFrame:
    """(run, best, best_pos, best_step, last): the best value of a log, where it is, the first on ties; and the last value.

    Runs without a value have no row. What is shuffled is one row a run and task.
    """
    value = metric_of(F.col(event), metric)
    rows = events.select(run, F.col(pos).alias("__pos"), value.alias("v"), F.get_json_object(event, "$.step").try_cast("long").alias("step")).where("v IS NOT NULL")
    order = F.struct((F.col("v") if lower else -F.col("v")).alias("k"), "__pos", "v", "step")
    best = rows.groupBy(run).agg(F.min(order).alias("b"), F.max_by("v", "__pos").alias("last"))
    return best.select(run, F.col("b.v").alias("best"), F.col("b.__pos").alias("best_pos"), F.col("b.step").alias("best_step"), "last")


def selection_metric(summary: Column, metric: str, best: Column) -> Column:
    """What a run is ranked by: its summary's metric under its name, else under `eval_` and its name, else the best of its log; NaN if that is no number."""
    given = F.from_json(summary, "map<string,string>")
    nan = F.lit(float("nan"))

    def number(key: str) -> Column:
        return F.coalesce(F.try_element_at(given, F.lit(key)).try_cast("double"), nan)

    direct, other = (F.coalesce(F.map_contains_key(given, k), F.lit(False)) for k in (metric, f"eval_{metric}"))
    return F.when(direct, number(metric)).when(other, number(f"eval_{metric}")).otherwise(F.coalesce(best.cast("double"), nan))


def ranked_runs(summaries: DataFrame, events: DataFrame, metric: str, lower: bool) -> DataFrame:
    """(run, selection_metric, best_step, place): runs of (run, json) in the order of what they are chosen by, those without a number last, then by name."""
    found = summaries.join(best_event(events, metric, lower), "run", "left")
    rows = found.select("run", selection_metric(F.col("json"), metric, F.col("best")).alias("selection_metric"), "best_step")
    key = F.nanvl(F.col("selection_metric"), F.lit(None).cast("double"))
    # runs are few: one row each
    order = Window.orderBy(key.asc_nulls_last() if lower else key.desc_nulls_last(), "run")
    return rows.withColumn("place", F.row_number().over(order))

"""Run folders and nested logs."""

import json
import math

from lodeweave.sources import runs


def folders(root):
    logs = {
        "b": [{"step": 1, "eval_loss": 0.5}, {"step": 2, "loss": None, "eval_loss": 0.1}, {"step": 3, "loss": True}, {"step": 4, "loss": "0.4"}, {"step": 5, "loss": "bad"}, {"step": 6, "eval_loss": 0.4}, {"note": 1}],
        "a b": [{"step": 9, "loss": 3}],
        ".hidden": [{"step": 1, "loss": 0}],
        "none": [],
    }
    for name, log in logs.items():
        (root / name).mkdir()
        (root / name / "trainer_state.json").write_text(json.dumps({"log_history": log, "best": {"at": [1, {"x": None}]}}, indent=1))
    (root / "b" / "run_args.json").write_text('{"lr": 0.1, "tags": ["x"], "name": "b", "flag": true, "gone": null}')
    (root / "no_run").mkdir()
    (root / "no_run" / "other.json").write_text("{}")


def test_documents_and_best_events(spark, tmp_path):
    folders(tmp_path)
    assert runs.run_folders(spark, str(tmp_path)) == ["a b", "b", "none"]
    docs = runs.run_documents(spark, str(tmp_path))
    assert sorted((r.run, r.document) for r in docs.collect()) == [("a b", "trainer_state"), ("b", "run_args"), ("b", "trainer_state"), ("none", "trainer_state")]
    events = runs.log_events(docs)
    assert events.count() == 8
    low = {r.run: tuple(r)[1:] for r in runs.best_event(events, "loss", True).collect()}
    assert low == {"b": (0.4, 3, 4, 0.4), "a b": (3.0, 0, 9, 3.0)}
    high = {r.run: tuple(r)[1:] for r in runs.best_event(events, "loss", False).collect()}
    assert high["b"] == (0.5, 0, 1, 0.4)
    (tmp_path / "empty").mkdir()
    assert runs.run_documents(spark, str(tmp_path / "empty")).count() == 0


def test_paths_of_values(spark, tmp_path):
    folders(tmp_path)
    docs = runs.run_documents(spark, str(tmp_path))
    paths = {(r.path, r.kind, r.value) for r in runs.json_paths(docs.where("run = 'b' AND document = 'run_args'"), ["run"], "json").collect()}
    assert paths == {("lr", "number", "0.1"), ("tags[0]", "text", "x"), ("name", "text", "b"), ("flag", "bool", "true"), ("gone", "null", None)}
    flat = {r.path for r in runs.json_paths(docs.where("run = 'b' AND document = 'run_args'"), ["run"], "json", nested=False).collect()}
    assert flat == {"lr", "name", "flag", "gone"}
    deep = "[" * 900 + "1" + "]" * 900
    odd = spark.createDataFrame([(1, None), (2, "no json"), (3, '"text"'), (4, deep), (5, "{}")], "id long, doc string")
    got = {r.id: (r.path, r.value) for r in runs.json_paths(odd, ["id"], "doc").collect()}
    assert got == {3: ("", "text"), 4: ("[0]" * 900, "1")}


def test_runs_are_ranked_by_the_chain(spark, tmp_path):
    folders(tmp_path)
    events = runs.log_events(runs.run_documents(spark, str(tmp_path)))
    summaries = spark.createDataFrame([("b", "{}"), ("a b", '{"loss": 0.2}'), ("none", None), ("text", '{"loss": "x", "eval_loss": 1}'), ("other", '{"eval_loss": 0.4}')], "run string, json string")
    rows = runs.ranked_runs(summaries, events, "loss", True).orderBy("place").collect()
    assert [(r.run, r.place) for r in rows] == [("a b", 1), ("b", 2), ("other", 3), ("none", 4), ("text", 5)]
    assert [r.selection_metric for r in rows[:3]] == [0.2, 0.4, 0.4] and all(math.isnan(r.selection_metric) for r in rows[3:])

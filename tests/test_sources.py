"""Readers, writers and file streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lodeweave.sources import readers, writers
from lodeweave.streaming import files


def test_json_sequences_skip_what_is_no_record(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"s": " CCO "}\n\n[1]\n{"s": null}\n{"s": ""}\n{"s": "CN"}\n{"s": "CC"}\n')
    assert [r[0] for r in readers.json_sequences(spark, str(tmp_path / "a.jsonl"), "s", 2).collect()] == ["CCO", "CN"]


def test_counts_skip_header_comment_and_bad_rows(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("symbol\tcount\n# note\n[C]\t2\n[O]\tx\n\nonly\n[N]\t1\n")
    assert {tuple(r) for r in readers.symbol_counts(spark, str(tmp_path / "c.tsv")).collect()} == {("[C]", 2), ("[N]", 1)}


def test_vocabulary_round_trip_and_errors(spark, tmp_path):
    vocab = spark.createDataFrame([("<s>", 0), ("[C]", 5), ("[O]", 6)], "token string, id int")
    text = writers.vocabulary_json(vocab).first().json
    (tmp_path / "v.json").write_text(text)
    assert json.loads(text) == {"<s>": 0, "[C]": 5, "[O]": 6}
    assert readers.vocabulary(spark, str(tmp_path / "v.json"), ("<s>",)).count() == 3
    (tmp_path / "w.json").write_text('{"a": 1, "b": 1}')
    for bad, specials in (("w.json", ()), ("v.json", ("<pad>",))):
        with pytest.raises(ValueError):
            readers.vocabulary(spark, str(tmp_path / bad), specials)


def test_ragged_rows_meet_by_name(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b\n1,"x,y"\na,c,b,d\n2,p,q,r\n')
    got = {tuple(r) for r in readers.ragged(spark, str(tmp_path / "r.csv"), ["a", "b"], ["a", "c", "b", "d"]).collect()}
    assert got == {("1", None, "x,y", None), ("2", "p", "q", "r")}


def test_run_names(spark):
    df = spark.createDataFrame([("mask_standard__mlm_0p3__lr_2p5e-5",), ("other",)], "name string")
    got = [tuple(r)[1:] for r in readers.run_names(df, "name").collect()]
    assert got == [("standard", 0.3, 2.5e-5), (None, None, None)]


def test_shards_are_equal_slices_and_splits_are_found(spark, tmp_path):
    writers.write_shards(spark.range(10), str(tmp_path / "out"), "id", 3)
    got = {r.shard: sorted(r.ids) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(F.collect_list("id").alias("ids")).collect()}
    assert got == {0: [0, 1, 2], 1: [3, 4, 5], 2: [6, 7, 8, 9]}
    writers.write_table(spark.range(2), str(tmp_path / "data" / "validation.parquet"))
    assert readers.available_splits(spark, str(tmp_path / "data")) == ["valid"]
    with pytest.raises(ValueError):
        writers.write_table(spark.range(1), str(tmp_path / "x.xyz"))


def test_stream_gives_what_a_batch_gives_and_resumes(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "res", "chk"))
    spark.range(50).write.parquet(src)
    keep = lambda df: df.where("id % 3 = 0")
    files.run_once(files.file_stream(spark, src, "id long"), keep, out, at)
    spark.range(50, 80).write.mode("append").parquet(src)
    files.run_once(files.file_stream(spark, src, "id long"), keep, out, at)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [i for i in range(80) if i % 3 == 0]


def test_separators_gzip_and_result_frames(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_text('id,name\n1,"x, y"\n2,\n')
    (tmp_path / "b.tsv").write_text("id\tname\n3\tz\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("id,name\n4,zipped\n")
    rows = [tuple(r) for n in ("a.csv", "b.tsv", "c.csv.gz") for r in readers.read_table(spark, str(tmp_path / n)).collect()]
    assert rows == [("1", "x, y"), ("2", None), ("3", "z"), ("4", "zipped")]
    typed = readers.read_table(spark, str(tmp_path / "a.csv"), "id long, name string")
    assert typed.schema["id"].dataType.simpleString() == "bigint" and typed.count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "a.xml"))


def test_long_export_has_a_folder_for_each_metric(spark, tmp_path):
    df = spark.createDataFrame([("a", "roc_auc", 0.5), ("b", "mae", 1.5), ("c", "mae", 2.0)], "model string, metric string, v double")
    writers.write_by_metric(df, str(tmp_path / "out"), "metric")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["metric=mae", "metric=roc_auc"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "metric=mae")).count() == 2


def test_first_rows_of_a_source(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "id int")
    assert [r.id for r in readers.first_rows(df, "id", 2).collect()] == [1, 2] and readers.first_rows(df, "id", 9).count() == 3
    with pytest.raises(ValueError):
        readers.first_rows(df, "id", 0)
    assert [r.sequence for r in readers.collected(df.select(F.col("id").cast("string").alias("s")).union(spark.createDataFrame([(" ",), (None,)], "s string")), "s", 3, 5).orderBy("sequence").collect()] == ["1", "2", "3"]
    with pytest.raises(ValueError):
        readers.collected(df.limit(0).select(F.col("id").cast("string").alias("s")), "s", 3, 5)

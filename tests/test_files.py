"""Matrices, chunks, buffered shuffles and takes that stop reading."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.sources import arrays, chunks
from lodeweave.streaming import samples


def test_matrices_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 7))
    df = spark.createDataFrame([(f"k{i:03d}", [float(v) for v in x[i]]) for i in range(500)], "name string, v array<double>").repartition(3)
    arrays.write_embeddings(df, str(tmp_path), "name", "v")
    files = sorted((tmp_path / "arrays").glob("*.npy"))
    assert len(files) == 3 and sum(len(np.load(f)) for f in files) == 500 and np.load(files[0]).dtype == np.float32
    read = spark.read.format("npy").option("path", str(tmp_path / "arrays")).option("partition_bytes", 100).load()
    assert read.rdd.getNumPartitions() > 100  # ranges of a few rows, no file as a whole
    met = spark.read.parquet(str(tmp_path / "metadata")).join(read.withColumn("file", F.regexp_extract("file", "[^/]+$", 0)), ["file", "row"])
    got = {r.name: r.vector for r in met.collect()}
    assert all(np.allclose(got[f"k{i:03d}"], x[i], atol=1e-6) for i in range(500)) and len(got) == 500


def test_matrices_of_others_and_keys(spark, tmp_path):
    spark.dataSource.register(arrays.ArrayFiles)
    kinds = {"a": np.arange(12, dtype=np.int64).reshape(4, 3), "b c": np.arange(5, dtype=">f4"), "e": np.zeros((0, 2)), "s": np.float64(3.5)}
    for k, v in kinds.items():
        folder = tmp_path / f"dataset={k.replace(' ', '%20')}" / "head=rf"
        folder.mkdir(parents=True)
        np.save(folder / "p.npy", v)
    (tmp_path / "note.txt").write_text("x")
    df = spark.read.format("npy").option("path", str(tmp_path)).option("keys", "dataset, head, none").load()
    assert df.columns == ["file", "row", "dataset", "head", "none", "vector"]
    got = {(r.dataset, r.row): r.vector for r in df.collect() if r.head == "rf" and r.none is None}
    assert got == {**{("a", i): list(map(float, range(3 * i, 3 * i + 3))) for i in range(4)}, **{("b c", i): [float(i)] for i in range(5)}, ("s", 0): [3.5]}
    np.save(tmp_path / "bad.npy", np.asfortranarray(np.ones((2, 2)) * [[1], [2]]))
    with pytest.raises(Exception, match="columns first"):
        spark.read.format("npy").option("path", str(tmp_path)).load().collect()


def test_uneven_vectors_are_an_error_and_leave_nothing(spark, tmp_path):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>").coalesce(1)
    spark.dataSource.register(arrays.ArrayFiles)
    with pytest.raises(Exception, match="one length"):
        df.write.format("npy").mode("overwrite").option("path", str(tmp_path / "o")).save()
    assert not list((tmp_path / "o").glob("part-*"))
    spark.createDataFrame([([1.0],)], "vector array<double>").write.format("npy").mode("append").option("path", str(tmp_path / "p")).save()
    with pytest.raises(Exception, match="already"):
        df.write.format("npy").mode("append").option("path", str(tmp_path / "p")).save()


def test_chunks_resume_after_a_failure(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    number, path = F.pmod("id", F.lit(9)), str(tmp_path)
    broken = df.withColumn("v", F.when(F.col("id") == 95, F.raise_error(F.lit("power cut"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="power cut"):
        chunks.write_chunks(broken, path, {"a": 1}, number, 9, wave=2)  # row 95 is of chunk 5, in the third wave
    folder = chunks.config_folder(path, {"a": 1})
    assert chunks.chunks_done(spark, folder) == {0, 1, 2, 3}
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / folder.rsplit("/", 1)[-1]).glob("chunk=*/*.parquet")}
    assert chunks.write_chunks(df, path, {"a": 1}, number, 9, wave=2) == folder
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    rows = chunks.read_chunks(spark, folder, "id long, v long").collect()
    assert sorted((r.id, r.v, r.chunk) for r in rows) == [(i, 2 * i, i % 9) for i in range(100)]
    assert chunks.config_folder(path, {"b": 2, "a": 1}) == chunks.config_folder(path, {"a": 1, "b": 2}) != folder
    with pytest.raises(ValueError):
        chunks.write_chunks(df, path, {"c": 1}, number, 5)
    empty = chunks.write_chunks(df.where("id < 2"), path, {"d": 1}, number, 3)
    assert chunks.chunks_done(spark, empty) == {0, 1, 2} and chunks.read_chunks(spark, empty, "id long, v long").count() == 2


def test_buffered_shuffle_is_a_bounded_permutation(spark):
    df = spark.range(0, 3000, 1, 2).select("id", F.array("id").alias("a"))
    once = [r.id for r in samples.buffered_shuffle(df, 3, 50).collect()]
    assert sorted(once) == list(range(3000)) and once != sorted(once) and once[:1500] != list(range(1500))
    assert once == [r.id for r in samples.buffered_shuffle(df, 3, 50).collect()] != [r.id for r in samples.buffered_shuffle(df, 4, 50).collect()]
    # a row goes out no earlier than the buffer lets it in
    assert all(i <= place + 50 for place, i in enumerate(once[:1500])) and set(once[:1500]) == set(range(1500))
    assert [r.id for r in samples.buffered_shuffle(df, 3, 1).collect()] == list(range(3000))
    assert samples.buffered_shuffle(df.limit(0), 3, 5).count() == 0
    # the buffer's draws, one row after the other
    rng, held, want = random.Random("3:0"), list(range(50)), []
    for i in range(50, 1500):
        j = rng.randrange(50)
        want.append(held[j])
        held[j] = i
    assert once[: len(want)] == want


def test_takes_stop_reading(spark, tmp_path):
    for k in range(12):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"f{k:02d}"))
    paths = sorted(str(p) for p in tmp_path.glob("f*/*.parquet"))
    opened = []

    def each(rows):
        opened.append(len(rows.inputFiles()))
        return rows.where("id % 2 = 0").select("__at", "id")

    got = samples.take_from_files(spark, paths, each, 7)
    assert [r.id for r in got.collect()] == [0, 2, 4, 6, 8, 10, 12] and opened == [1, 4] and len(got.inputFiles()) == 4
    assert samples.take_from_files(spark, paths, each, 1000).count() == 60
    whole = samples.shuffled_files(spark, paths, 1, 5).collect()
    assert sorted(r.id for r in whole) == list(range(120))


def test_a_stream_stops_when_it_has_enough(spark, tmp_path):
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    half = lambda s: s.where("id % 2 = 0")
    assert samples.take_from_stream(spark, str(tmp_path / "in"), "id long", half, 12, out, log) == 12
    read = spark.read.parquet(f"{out}/batch=*")
    assert read.count() == 12 and len(list((tmp_path / "log" / "offsets").glob("[0-9]*"))) <= 4
    assert samples.take_from_stream(spark, str(tmp_path / "in"), "id long", half, 12, out, log) == 12
    assert samples.take_from_stream(spark, str(tmp_path / "in"), "id long", half, 1000, out, log) == 27
    assert {r.id for r in spark.read.parquet(f"{out}/batch=*").collect()} <= set(range(0, 60, 2))

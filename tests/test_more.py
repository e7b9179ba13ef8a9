"""Tokens by pieces, padding, patches and gates; budgets and samples; names; writers; registries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import text
from lodeweave.operators import corpus, heads, metrics, similarity, splits, statistics, tokens
from lodeweave.sources import writers

VOCAB = {**tokens.SPECIALS, "C": 5, "CC": 6, "Cl": 7, "CCl": 8, "(": 9, "CC(": 10, "N": 11}


def greedy(pieces, vocab, span):
    out, i = [], 0
    while i < len(pieces):
        k = next((k for k in range(min(span, len(pieces) - i), 0, -1) if "".join(pieces[i : i + k]) in vocab), 0)
        out.append(vocab["".join(pieces[i : i + k])] if k else 3)
        i += max(1, k)
    return out or [3]


def test_piece_encoding_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice(["C", "Cl", "(", ")", "N"]) for _ in range(rng.randrange(12))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, p array<string>")
    for span in (1, 2, 3):
        got = {r.i: r.ids for r in df.select("i", tokens.encode_pieces(F.col("p"), VOCAB, span).alias("ids")).collect()}
        assert got == {i: greedy(p, VOCAB, span) for i, p in rows}
    # C and Cl are different pieces, so "C" + "l" is no match
    one = spark.createDataFrame([("CCl",), ("",), (None,)], "s string").select(tokens.encode_pieces(text.pieces(F.col("s"), text.SMILES_PIECE), VOCAB, 2).alias("ids"))
    assert [r.ids for r in one.collect()] == [[8], [3], [3]]


def test_frequencies_are_booked(spark):
    rows = [["[A]", "[B]"] * 3, ["[A]", "[B]"], ["[A]", "[A]", "[A]"], ["[C]"]]
    df = spark.createDataFrame(list(enumerate(rows)), "row_id int, toks array<string>")
    # four pairs A B (two B A), two A A that overlap
    assert tokens.train_merges_counted(df, 4, 3, 4) == {"[A]": 3, "[B]": 0, "[C]": 1, "[A][B]": 4}
    # the next pair has the same token twice: it pays twice
    more = tokens.train_merges_counted(df, 5, 2, 4)
    assert (more["[A][B]"], more["[A][B][A][B]"]) == (0, 2)


def test_patches_and_comparisons(spark):
    vocab = tokens.vocabulary(spark, ["[A]", "[B]"])
    extra = spark.createDataFrame([("[Z]",), ("[C]",), ("[A]",), ("[Z]",)], "token string")
    new = {r.token: r.id for r in tokens.patched(vocab, extra).where("added").collect()}
    assert new == {"[C]": 7, "[Z]": 8}
    for bad in ("A", "[A", "[A][B]", "[ ]", None):
        with pytest.raises(Exception, match="malformed"):
            tokens.patched(vocab, spark.createDataFrame([(bad,)], "token string")).collect()
    other = spark.createDataFrame([("[A]", 5), ("[B]", 9), ("[X]", 6)], "token string, id int")
    diff = {(r.token, r.status) for r in tokens.compared(vocab.where("id > 4"), other).collect()}
    assert diff == {("[B]", "other_id"), ("[X]", "only_b")} and tokens.compared(vocab, vocab).count() == 0
    ids = spark.createDataFrame([(1, [1, 2], [1, 2]), (2, [1, 2], [1, 3]), (3, [1], [1, 2]), (4, None, [1])], "k int, a array<int>, b array<int>")
    assert {r.k: r.first_difference for r in tokens.compared_ids(ids, "a", "b").collect()} == {2: 1, 3: 1, 4: 0}


def test_padding_by_batch(spark):
    df = spark.createDataFrame([(0, [5]), (0, [5, 6, 7]), (1, [5, 6]), (None, []), (None, [9])], "batch int, ids array<int>").withColumn("labels", F.col("ids"))
    out = sorted((str(r.batch), r.ids, r.labels) for r in tokens.padded_batches(df, "batch", labels="labels").collect())
    assert out == [("0", [5, 1, 1], [5, -100, -100]), ("0", [5, 6, 7], [5, 6, 7]), ("1", [5, 6], [5, 6]), ("None", [1], [-100]), ("None", [9], [9])]
    left = {len(r.ids) for r in tokens.padded_batches(df, "batch", multiple=4, left=True).collect()}
    assert left == {4} and {len(r.ids) for r in tokens.padded_batches(df, "batch", length=5, multiple=3).collect()} == {6}
    row = df.limit(1).select(tokens.framed(F.array(F.lit(5)), F.array(F.lit(6))).alias("pair"), tokens.detokenised(F.array(F.lit(0), F.lit(5), F.lit(99), F.lit(2)), VOCAB).alias("text")).first()
    assert row.pair == [0, 5, 2, 6, 2] and row.text == "C<unk>"


def test_statistics_and_gates(spark):
    rng = random.Random(2)
    ids = [[0] + [rng.choice([3, 5, 6]) for _ in range(rng.randrange(9))] + [2] for _ in range(50)] + [[0, 3, 3, 3, 2], [], None]
    df = spark.createDataFrame([(x,) for x in ids], "ids array<int>")
    r = tokens.token_statistics(df, "ids", 6).first()
    full = [x for x in ids if x]
    cut = [x if len(x) <= 6 else x[:5] + x[-1:] for x in full]
    lengths = sorted(map(len, cut))
    may = [[t for t in x if t not in (0, 1, 2, 4)] for x in cut]
    assert r.sample_size == 53 and r.mean_len == pytest.approx(sum(lengths) / len(lengths)) and r.max_len == 6
    assert (r.p50_len, r.p95_len, r.p99_len) == tuple(lengths[round((len(lengths) - 1) * q)] for q in (0.5, 0.95, 0.99))
    assert r.unk_rate == pytest.approx(sum(x.count(3) for x in may) / sum(map(len, may)))
    assert r.mostly_unknown_rate == pytest.approx(sum(bool(x) and x.count(3) / len(x) > 0.8 for x in may) / 53)
    assert r.empty_sequence_rate == pytest.approx(2 / 53) and r.truncation_rate == pytest.approx(sum(len(x) > 6 for x in full) / 53)
    vocab = tokens.vocabulary(spark, [f"[{i}]" for i in range(100)])
    good = spark.createDataFrame([([0, 5, 2],)] * 20, "ids array<int>").withColumn("s", F.lit("[C]"))
    gates = {g.gate: g.passed for g in tokens.quality_gates(tokens.token_statistics(good, "ids", 6), vocab, good, "s", "aa", "aa").collect()}
    assert all(gates.values()) and len(gates) == 8
    moved = vocab.withColumn("id", F.when(F.col("token") == "<pad>", 50).otherwise(F.col("id")))
    bad = {g.gate: g.passed for g in tokens.quality_gates(tokens.token_statistics(df, "ids", 6), moved, good.withColumn("s", F.lit("C")), "s", "aa", "bb").collect()}
    assert not any(bad[g] for g in ("special_ids", "sha256", "bracketed", "unk_rate", "empty_sequence_rate", "truncation_rate")) and bad["vocabulary_size"]
    none = tokens.quality_gates(tokens.token_statistics(df.limit(0), "ids", 6), vocab, good.limit(0), "s").where("NOT passed")
    assert {g.gate for g in none.collect()} == {"bracketed", *tokens.GATES}


def budgets_by_loop(sizes, budget):
    if sum(sizes.values()) <= budget:
        return dict(sizes)
    full = {k: n for k, n in sizes.items() if n}
    has = {k: int(n > 0 and len(full) <= budget) for k, n in sizes.items()}
    rest = budget - sum(has.values())
    weight = {k: n - has[k] for k, n in full.items()}
    if rest and sum(weight.values()):
        share = {k: rest * w / sum(weight.values()) for k, w in weight.items()}
        add = {k: min(int(share[k]), weight[k]) for k in full}
        for k in full:
            has[k] += add[k]
        spare = budget - sum(has.values())
        for k in sorted(full, key=lambda k: (share[k] - add[k], k), reverse=True):
            if spare and has[k] < sizes[k]:
                has[k] += 1
                spare -= 1
    for k in sorted(full, key=lambda k: (-sizes[k], k)):
        has[k] += max(0, min(sizes[k] - has[k], budget - sum(has.values())))
    return has


def test_budgets_equal_a_loop(spark):
    rng = random.Random(3)
    for _ in range(12):
        sizes = {f"s{k}": rng.choice([0, 1, 2, 5, 30, 400]) for k in range(rng.randrange(1, 6))}
        budget = rng.choice([1, 2, 3, 7, 50, 300])
        got = {r.name: r.quota for r in statistics.budgets(spark.createDataFrame(list(sizes.items()), "name string, size long"), "name", "size", budget).collect()}
        assert got == budgets_by_loop(sizes, budget), (sizes, budget)


def test_subsample_compacts_and_leaves_other_splits(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "valid").otherwise("test").alias("split"))
    out = splits.subsample(df.repartition(4), "split", "id", ["train", "valid"], 20, 5).collect()
    n = [sum(r.split == s for r in out) for s in ("train", "valid", "test")]
    assert n == [10, 10, 100]
    assert [r.new_position for r in sorted(out, key=lambda r: r.id)] == list(range(120))
    assert {r.id for r in out} == {r.id for r in splits.subsample(df, "split", "id", ["train", "valid"], 20, 5).collect()}
    assert splits.subsample_name("m", "test", 20, 5) == "m__subsample_test20_seed5"


def test_split_helpers(spark):
    df = spark.createDataFrame([(1, "train", "a"), (2, "Validation ", "b"), (3, "val", " "), (4, "odd", "c"), (5, None, "d")], "id int, split string, s string")
    assert [r.id for r in splits.of_split(df, "split", "valid", "s").collect()] == [2]
    assert splits.of_split(df, None, "valid", "s").count() == 4 and splits.of_split(df, "gone", "valid", "s").count() == 4
    listed = spark.createDataFrame([(4,), (5,), (2,)], "id int")
    with pytest.raises(Exception, match="unknown split"):
        splits.excluded(df, "id", "split", listed.where("id < 4")).collect()
    assert {r.id for r in splits.excluded(df.where("id <> 3"), "id", "split", listed).collect()} == {1}
    with pytest.raises(ValueError, match="valid, test"):
        corpus.require_splits(df)
    kept, n = splits.without_nan(spark.createDataFrame([([1.0],), ([float("nan")],), ([None],), (None,)], "v array<double>"), "v")
    assert kept.count() == 1 and n.first().n == 3
    assert corpus.canonical(spark.createDataFrame([(" ", "b", 1)], "Smiles string, mol string, z int"), {"smiles": ["mol"]}).first() == ("b", 1)
    with pytest.raises(ValueError):
        corpus.canonical(df, {"gone": ["lost"]})
    placed = corpus.numbered(spark.createDataFrame([(x,) for x in "dbacb"], "x string"), [F.col("x")]).collect()
    assert sorted((r.place, r.x) for r in placed) == list(enumerate("abbcd", 1))


def test_names_and_numbers(spark):
    rows = [("C=O\n",), ("\t[13C]",), ("[C[N]",), ("Hello",), ("",), (None,), ("%12ClBr",)]
    got = [r.ok for r in spark.createDataFrame(rows, "s string").select(text.looks_like_smiles(F.col("s")).alias("ok")).collect()]
    assert got == [True, True, False, False, False, None, True]
    n = spark.createDataFrame([(950.0,), (1500.0,), (2000.0,), (2340000.0,), (-1250.0,)], "n double").select(text.compact(F.col("n")).alias("c"), text.thousands(F.col("n")).alias("t")).collect()
    assert [r.c for r in n] == ["950", "1.5k", "2k", "2.3M", "-1.2k"] and n[3].t == "2,340,000"
    names = spark.createDataFrame([("a/b/model.v2.bin",), ("x/gpt2.5/",), ("plain",)], "p string").select(text.short_name(F.col("p")).alias("s"), text.percent(F.lit(0.1235)).alias("q")).collect()
    assert [r.s for r in names] == ["model", "gpt2.5", "plain"] and names[0].q == "12.4%"


def test_nearest_equals_a_loop_in_any_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5))
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 5), (92, [float("nan")] * 5)]
    t = spark.createDataFrame(rows, "target long, vector array<double>").repartition(3)
    q = t.where("target % 4 = 0").withColumnRenamed("target", "query")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block_bytes in (80, 32 << 20):
        got = {(r["query"], r.place): r.target for r in similarity.nearest(q, t, 3, block_bytes).collect()}
        want = {}
        for i in range(0, 80, 4):
            s = np.round(unit @ unit[i], 9)
            for place, j in enumerate(sorted((j for j in range(80) if j != i), key=lambda j: (-s[j], j))[:3], 1):
                want[i, place] = j
        assert got == want


def test_registries(spark):
    df = spark.createDataFrame([(0, 1.0, 0.9), (0, 0.0, 0.2), (0, 1.0, 0.4), (1, 2.0, 1.0), (1, 4.0, 3.5), (1, 3.0, 3.0)], "g int, y_true double, y_score double")
    for name, want in (("roc_auc", {0: 1.0}), ("mae", {0: pytest.approx(0.9 / 3), 1: pytest.approx(0.5)}), ("spearmancorr", {1: pytest.approx(1.0)})):
        score, direction = metrics.scorer(name)
        got = {r.g: r.score for r in score(df, ["g"]).collect()}
        assert {g: got[g] for g in want} == want and direction == (-1 if name == "mae" else 1)
    with pytest.raises(ValueError):
        metrics.scorer("luck")
    assert heads.head("ridge", "classification") is heads.logistic_grid and not heads.knn_allowed("MUV")
    with pytest.raises(ValueError):
        heads.head("svm", "regression")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None), ("c|d", 2.25)], "name string, v double")
    assert writers.markdown_table(df, "name") == "| name | v |\n| --- | --- |\n| a | 1.5 |\n| b | — |\n| c\\|d | 2.25 |"
    facts = writers.write_metadata(df.withColumn("split", F.lit("train")), str(tmp_path / "m.json"), {"seed": 1}, "split", df.limit(1))
    assert json.loads((tmp_path / "m.json").read_text()) == json.loads(json.dumps(facts)) and facts["rows_by_split"] == {"train": 3}
    table = str(tmp_path / "results.csv")
    writers.append_results(spark, table, df.select("name"))
    writers.append_results(spark, table, df.select("name", "v").limit(1))
    rows = spark.read.option("header", True).csv(table).collect()
    assert sorted((int(r.id), r.name, r.v) for r in rows) == [(1, "a", None), (2, "b", None), (3, "c|d", None), (4, "a", "1.5")]
    assert writers.delete_results(spark, table, F.col("name") == "a") == 2 and spark.read.option("header", True).csv(table).count() == 2
    assert writers.delete_results(spark, table, F.col("name") == "zz") == 0
    want = df.select("name")
    for bad, match in ((df, "1 bad values"), (df.where("v > 2"), "2 missing"), (df.union(df).na.fill(0.0), "3 repeated")):
        with pytest.raises(ValueError, match=match):
            writers.write_submission(bad, str(tmp_path / "s"), "name", "v", want)
    assert not (tmp_path / "s").exists()
    writers.write_submission(df.na.fill(0.0), str(tmp_path / "s"), "name", "v", want)
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 3
    grid = spark.createDataFrame([("d1", "e", 1), ("d2", "e", 2)], "dataset string, embedder string, v int")
    writers.write_by_keys(grid, str(tmp_path / "k"), ["dataset", "embedder"])
    writers.write_by_keys(grid.where("v = 2").withColumn("v", F.lit(5)), str(tmp_path / "k"), ["dataset", "embedder"])
    assert {(r.dataset, r.v) for r in spark.read.option("header", True).csv(str(tmp_path / "k")).collect()} == {("d1", "1"), ("d2", "5")}
    counts = spark.createDataFrame([("[B]", 2), ("[A]", 2), ("[C]", 9)], "token string, n long")
    writers.write_symbols(counts, str(tmp_path / "sym"), "symbols")
    writers.write_symbols(counts, str(tmp_path / "cnt"), "symbol_counts")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "sym")).collect()) == ["[A]", "[B]", "[C]"]
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "cnt")).columns == ["token", "n"]
    with pytest.raises(ValueError):
        writers.write_symbols(counts, str(tmp_path / "x"), "other")


def test_small_operators(spark):
    assert corpus.label_columns(["SMILES", "a", "Split", "b", "Graph", "seed"], {"SEED"}) == ["a", "b"]
    df = spark.createDataFrame([("Brand-1",), ("BRAND 2",), (None,), ("é",)], "n string")
    assert [r.n for r in corpus.skipping(df, "n", ["brand_2"]).collect()] == ["Brand-1", None, "é"]
    assert corpus.skipping(df, "n", []).count() == 4
    kept, n = corpus.parsable(spark.createDataFrame([("a", True), ("a", None), ("b", False)], "s string, ok boolean"), F.col("ok"), "s")
    assert kept.count() == 1 and {(r.s, r.kept, r.dropped) for r in n.collect()} == {("a", 1, 1), ("b", 0, 1)}
    rows = [("x", 1, 1), ("x", 2, None), ("x", -100, 3), ("y", None, 1), ("y", -100, 1)]
    acc = {r.g: (r.n, r.accuracy) for r in metrics.masked_accuracy(spark.createDataFrame(rows, "g string, label int, p int"), ["g"], "label", "p").collect()}
    assert acc == {"x": (2, 0.5), "y": (0, None)}
    p = [r.p for r in spark.createDataFrame([(0.0,), (800.0,), (None,)], "l double").select(metrics.perplexity(F.col("l")).alias("p")).collect()]
    assert p == [1.0, float("inf"), None]
    means = {r.g: r.weighted_mean for r in metrics.weighted_mean(spark.createDataFrame([("a", 1.0, 3.0), ("a", 5.0, 1.0), ("a", None, 9.0), ("b", 1.0, 0.0)], "g string, v double, w double"), ["g"], "v", "w").collect()}
    assert means == {"a": 2.0, "b": None}
    one = spark.createDataFrame([("m",)], "k string").select(corpus.sorted_json(F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("é"))).alias("j")).first()
    assert one.j == '{"a":"é","z":"1"}'


def test_alike_counts_equal_a_loop_in_any_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, size=(60, 6))
    x[3] = 0
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None)], "target long, vector array<long>").repartition(3)
    q = t.where("target % 3 = 0").withColumnRenamed("target", "query")
    want = {(i, j) for i in range(0, 60, 3) for j in range(60) if i != j and np.maximum(x[i], x[j]).sum() and np.minimum(x[i], x[j]).sum() / np.maximum(x[i], x[j]).sum() >= 0.5}
    for block_bytes in (100, 32 << 20):
        assert {(r["query"], r.target) for r in similarity.alike_counts(q, t, 0.5, block_bytes).collect()} == want


@pytest.mark.parametrize("name", ["nearest", "alike_counts"])
def test_what_a_task_holds_does_not_grow_with_the_queries(spark, name):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, peak = 16000, []
    rng = np.random.default_rng(1)
    batch = pa.RecordBatch.from_pydict({"target": pa.array(np.arange(1024) + n), "vector": pa.array(rng.integers(1, 4000, (1024, 2)).astype(float).tolist())})

    class Targets:
        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, run, schema):
            tracemalloc.start()
            for _ in run(iter([batch])):
                pass
            peak.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            return spark.createDataFrame([], schema)

    queries = spark.range(n).select(F.col("id").alias("query"), F.array(F.rand(1) * 4000, F.rand(2) * 4000).alias("vector"))
    getattr(similarity, name)(queries, Targets(), 3 if name == "nearest" else 0.9999)
    assert len(peak) == 1 and peak[0] < 50e6

"""Golden cases and edges of single operators."""

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import hashing, text
from lodeweave.operators import corpus, metrics, reporting, similarity, statistics, tokens


def test_nulls_pass_basic_filters(spark):
    df = spark.createDataFrame([(1, 3, "Small molecule"), (2, 1, "Small molecule"), (3, None, None)], "id int, n int, t string")
    out = df.where(corpus.passes(F.col("n").between(3, 100), F.lower(F.trim("t")) == "small molecule"))
    assert sorted(r.id for r in out.collect()) == [1, 3]


def test_rows_without_a_key_collapse_to_one(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id int, k string")
    assert sorted(r.id for r in corpus.keep_first(df, "k", "id").collect()) == [1, 3]


def test_splits_are_disjoint_whole_and_depend_on_the_seed(spark):
    df = spark.range(700).select(F.concat(F.lit("row "), (F.col("id") * 7).cast("string")).alias("k"))
    a, b = ({r.k: r.split for r in corpus.with_split(df, F.col("k"), 0.15, 0.2, seed).collect()} for seed in (3, 4))
    assert set(a.values()) == {"train", "valid", "test"} and len(a) == 700 and a != b
    with pytest.raises(ValueError):
        corpus.with_split(df, F.col("k"), 0.6, 0.5, 1)


def test_hash_functions_agree_with_integers(spark):
    import hashlib

    rows = spark.range(50).select(F.col("id").cast("string").alias("k"), hashing.unit_interval(F.col("id")).alias("u"), hashing.bucket(F.col("id"), 100).alias("b")).collect()
    for r in rows:
        n = int(hashlib.sha1(r.k.encode()).hexdigest(), 16)
        assert r.b == n % 100 and abs(r.u - n / 16**40) < 1e-15


def test_split_overlap_counts_shared_keys(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), ("c", "valid")], "k string, split string")
    out = {(r.split_a, r.split_b): (r.shared, r.first_keys) for r in corpus.split_overlap(df, "k", ["train", "valid", "test"]).collect()}
    assert out[("train", "test")] == (1, "a") and out[("train", "valid")] == (0, "")


def test_unknown_metric_is_an_error(spark):
    df = spark.createDataFrame([("luck",)], "m string")
    with pytest.raises(Exception, match="unknown metric"):
        df.select(reporting.direction(F.col("m"))).collect()


def test_best_row_is_picked_by_cv_not_by_test(spark):
    rows = [("d", "e", "ridge", "roc_auc", 0.72, 0.60), ("d", "e", "knn", "roc_auc", 0.71, 0.99)]
    df = spark.createDataFrame(rows, "dataset string, embedder string, model string, cv_metric_name string, cv_metric double, test_metric double")
    assert reporting.best_by_cv(df).first().model == "ridge"


def test_auroc_is_the_share_of_pairs_in_order(spark):
    import random

    rng = random.Random(11)
    rows = [(e, rng.choice([0.0, 1.0, None]), rng.randrange(6) / 5) for e in range(3) for _ in range(25)]
    rows += [(3, 1.0, 0.5), (3, 1.0, 0.1)]  # one class only
    shares = []
    for e in range(3):
        good, bad = ([x for k, y, x in rows if k == e and y == v] for v in (1.0, 0.0))
        shares.append(sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)))
    df = spark.createDataFrame(rows, "endpoint int, y_true double, y_score double")
    assert metrics.mean_auroc(df, "endpoint").first().mean_auroc == pytest.approx(sum(shares) / 3)


def test_tanimoto_of_counts_equals_a_loop(spark):
    import random

    rng = random.Random(12)
    pairs = [tuple([rng.randrange(5) for _ in range(7)] for _ in "ab") for _ in range(20)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<int>, b array<int>")
    got = {r.i: r.t for r in df.select("i", similarity.tanimoto(F.col("a"), F.col("b")).alias("t")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(sum(map(min, a, b)) / sum(map(max, a, b)))


def test_set_join_finds_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(3)
    sets = {i: sorted({rng.randrange(12) for _ in range(8)}) for i in range(60)}
    df = spark.createDataFrame([(i, list(map(str, x))) for i, x in sets.items()], "id int, items array<string>")
    got = {(r.a, r.b) for r in similarity.set_join(df, 0.75).collect()}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.75}
    assert got == want


def merges_by_loop(rows, max_vocab, min_freq, max_pieces):
    """Counts all pairs anew in each round."""
    vocab = list(dict.fromkeys(t for row in rows for t in row))
    size = dict.fromkeys(vocab, 1)
    while len(vocab) < max_vocab:
        count, first = {}, {}
        for place, row in enumerate(rows):
            for at, pair in enumerate(zip(row, row[1:], strict=False)):
                count[pair] = count.get(pair, 0) + 1
                first.setdefault(pair, (place, at))
        fit = [p for p in count if size[p[0]] + size[p[1]] <= max_pieces and count[p] >= min_freq]
        if not fit:
            break
        left, right = min(fit, key=lambda p: (-count[p], first[p]))
        if left + right not in size:
            vocab.append(left + right)
            size[left + right] = size[left] + size[right]
        for k, row in enumerate(rows):
            out = []
            for t in row:
                if out and t == right and out[-1] == left:
                    out[-1] = left + right
                else:
                    out.append(t)
            rows[k] = out
    return vocab


def test_merge_training_equals_a_loop(spark):
    import random

    rng = random.Random(13)
    rows = [[rng.choice(["[P]", "[Q]", "[R]", "[S]"]) for _ in range(rng.randrange(1, 7))] for _ in range(12)]
    df = spark.createDataFrame([(i, "".join(r)) for i, r in enumerate(rows)], "row_id int, s string").select("row_id", text.pieces(F.col("s"), text.BRACKETED).alias("toks"))
    assert tokens.train_merges(df, 10, 2, 4) == merges_by_loop(rows, 10, 2, 4)


def test_no_merge_across_rows_and_empty_corpus(spark):
    df = spark.createDataFrame([(i, ["[C]" if i % 2 else "[O]"]) for i in range(40)], "row_id int, toks array<string>")
    assert tokens.train_merges(df, 20, 2, 10) == ["[O]", "[C]"]
    with pytest.raises(ValueError):
        tokens.train_merges(df.limit(0), 20, 2, 10)


def test_malformed_text_encodes_to_unknown(spark):
    df = spark.createDataFrame([("[C][O]",), ("C[O]",), ("",), ("[X]",)], "s string")
    vocab = {**tokens.SPECIALS, "[C]": 5, "[O]": 6, "[C][O]": 7}
    assert [r[0] for r in df.select(tokens.encode(F.col("s"), vocab, 2)).collect()] == [[7], [3], [3], [3]]


def test_three_truncations(spark):
    df = spark.createDataFrame([([5, 6, 7, 8],)], "ids array<int>")
    row = df.select(*[tokens.truncated(F.col("ids"), 4, h).alias(h) for h in ("cut", "content", "last")]).first()
    assert (row.cut, row.content, row.last) == ([0, 5, 6, 7], [0, 5, 6, 2], [0, 5, 6, 2])


def test_quotas_spend_the_budget(spark):
    df = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "name string, size long")
    out = {r.name: r.quota for r in statistics.quotas(df, "name", "size", 11).collect()}
    assert sum(out.values()) == 11 and out["a"] >= out["b"] >= out["c"]


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("v"))
    r = statistics.bootstrap_mean(df, "id", "v", 200, 1).first()
    assert r.low < r.mean < r.high


def test_set_join_meets_by_what_alike_sets_must_share(spark):
    import itertools
    import random

    # six items alike enough have to be equal, so sets that share a host and a word don't meet any more
    assert similarity._combinations(6, 6, 0.8) == [list(range(6))] and len(similarity._combinations(9, 9, 0.8)) == 9
    rng = random.Random(4)
    sets = [{f"r{rng.randrange(4)}", *rng.sample("abcdefgh", rng.randrange(1, 8))} for _ in range(70)]
    sets += [set(map(str, range(rng.randrange(18, 34)))) - {str(rng.randrange(18))} for _ in range(40)]
    sets += [sets[0], sets[80], set()]
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id int, items array<string>")
    for least in (0.5, 0.8, 1.0):
        got = sorted((r.a, r.b, round(r.similarity, 9)) for r in similarity.set_join(df, least).collect())
        pairs = ((a, b, len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))) for a, b in itertools.combinations(range(len(sets)), 2))
        assert got == [(a, b, round(s, 9)) for a, b, s in pairs if s >= least]

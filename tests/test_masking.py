"""Masks against loops that draw one span after the other, their rules, and edge cases."""

import decimal
import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import masking, tokens

NEVER = {0, 1, 2, 4}


def u(seed, what, *parts):
    return (int(hashlib.sha1(":".join(map(str, (seed, what, *parts))).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def rows_of(spark, many=80, longest=40):
    rng = random.Random(8)
    rows = [(k, k // 10, [0] + [rng.choice([3, 4, *range(5, 30)]) for _ in range(rng.randrange(longest))] + [2] + [1] * rng.randrange(4)) for k in range(many)]
    rows += [(many, 99, []), (many + 1, 99, [0, 2, 1]), (many + 2, None, [7]), (many + 3, 98, [9, 0, 9, 2, 9])]
    return rows, spark.createDataFrame(rows, "row_id long, batch long, ids array<int>")


def spans_by_loop(row, ids, p, p_geometric, longest, seed, weight):
    may = [i for i, x in enumerate(ids) if x not in NEVER]
    budget, masked, left = max(1, round(len(may) * p)), set(), set(may)
    while left and len(masked) < budget:
        # the next of the places left by the race of exponential clocks: a draw by weight
        at = min(left, key=lambda i: (-math.log(u(seed, "start", row, i)) / weight(ids[i]), i))
        length = 1
        while length < longest and u(seed, "length", row, at) < (1 - p_geometric) ** length:
            length += 1
        for i in range(at, min(at + length, len(ids))):
            if ids[i] in NEVER:
                break
            masked.add(i)
            left.discard(i)
    return masked


@pytest.mark.parametrize("p, weighted", [(0.3, False), (0.3, True), (0.02, False), (1.0, True)])
def test_spans_equal_a_loop(spark, p, weighted):
    rows, df = rows_of(spark)
    weight = (lambda x: 4.0 if x % 2 else 1.0) if weighted else (lambda x: 1.0)
    column = (lambda x: F.when(x % 2 == 1, 4.0).otherwise(1.0)) if weighted else None
    got = {r.row_id: {i for i, m in enumerate(r.masked) if m} for r in masking.spans(df.repartition(3), p, 0.4, 5, 9, weight=column).collect()}
    assert got == {k: spans_by_loop(k, ids, p, 0.4, 5, 9, weight) for k, _, ids in rows}
    for k, _, ids in rows:
        may = sum(x not in NEVER for x in ids)
        assert not any(ids[i] in NEVER for i in got[k])
        assert (not may and not got[k]) or max(1, round(may * p)) <= len(got[k]) <= max(1, round(may * p)) + 4


def test_starts_follow_their_weights(spark):
    df = spark.range(6000).select(F.col("id").alias("row_id"), F.array(F.lit(0), F.lit(5), F.lit(6), F.lit(7)).alias("ids"))
    weight = masking.start_weights({"[C]": 5, "[15N+]": 6, "[Branch1]": 7, "<mask>": 4}, 3.0)
    first = Counter(r.masked.index(True) for r in masking.spans(df, 0.1, 0.5, 1, 3, weight=weight).collect())
    assert set(first) == {1, 2, 3} and all(abs(first[i] - 6000 * w / 5) < 200 for i, w in ((1, 1), (2, 3), (3, 1)))


def test_hetero_tokens():
    import re

    good = ["[N]", "[=O]", "[#N]", "[Cl]", "[Br]", "[15NH2+]", "[/S]", "[C][N]", "[Se]", "[O-]"]
    bad = ["[C]", "[Branch1]", "[Ring1]", "[Na]", "[Fe]", "[Sn]", "[B]", "N", "[Zn][C]"]
    assert all(re.search(masking.HETERO, t) for t in good) and not any(re.search(masking.HETERO, t) for t in bad)


@pytest.mark.parametrize("p", [0.0, 0.004, 0.3, 1.0])
def test_standard_masks_equal_a_loop(spark, p):
    rows, df = rows_of(spark)
    want = {k: {i for i, x in enumerate(ids) if x not in NEVER and u(2, "mask", k, i) < p} for k, _, ids in rows}
    for batch in {b for _, b, _ in rows}:
        inside = [(k, ids) for k, b, ids in rows if b == batch]
        places = [(u(2, "force", k, i), k, i) for k, ids in inside for i, x in enumerate(ids) if x not in NEVER]
        if p > 0 and places and not any(want[k] for k, _ in inside):
            want[min(places)[1]].add(min(places)[2])
    out = masking.standard(df.repartition(5), p, 2)
    assert {r.row_id: {i for i, m in enumerate(r.masked) if m} for r in out.collect()} == want and out.columns == ["row_id", "batch", "ids", "masked"]


def test_corruption_follows_its_shares_and_rules(spark):
    rows, df = rows_of(spark, 400, 60)
    out = masking.corrupted(masking.standard(df, 0.5, 4), 4, 30)
    kinds = Counter()
    for r in out.collect():
        for x, m, given, label in zip(r.ids, r.masked, r.inputs, r.labels, strict=True):
            assert label == (x if m else -100) and (m or given == x)
            if m:
                kinds["mask" if given == 4 else "same" if given == x else "other"] += 1
                assert given == 4 or given == x or 5 <= given < 30
    n = sum(kinds.values())
    assert abs(kinds["mask"] / n - 0.8) < 0.03 and abs(kinds["other"] / n - 0.1) < 0.03
    facts = masking.frozen_facts(out).first()
    assert (facts.n_rows, facts.n_masked, facts.n_illegal) == (len(rows), n, 0)
    assert facts.fingerprint == masking.frozen_facts(out.repartition(7)).first().fingerprint
    broken = out.withColumn("inputs", F.transform("ids", lambda x: x + 1)).withColumn("labels", F.transform("ids", lambda x: x))
    assert masking.frozen_facts(broken).first().n_illegal == sum(x in NEVER for _, _, ids in rows for x in ids)


def test_wrong_parameters_are_errors(spark):
    _, df = rows_of(spark, 2)
    for call in (lambda: masking.spans(df, 0.1, 1.0, 3, 1), lambda: masking.spans(df, 0.1, 0.5, 0, 1), lambda: masking.standard(df, 1.5, 1), lambda: masking.start_weights({}, 2.0), lambda: masking.start_weights({"[N]": 5}, 0.0), lambda: masking.corrupted(df, 1, 5)):
        with pytest.raises(ValueError):
            call()
    assert tokens.SPECIALS["<mask>"] == 4
    empty = masking.spans(df.limit(0), 0.1, 0.5, 3, 1)
    assert empty.count() == 0 and masking.standard(df.limit(0), 0.1, 1).count() == 0


@pytest.mark.parametrize("strategy", ["standard", "span", "hetero_span"])
def test_collated_batches_are_whole(spark, strategy):
    rows, df = rows_of(spark, 40, 20)
    vocab = {**tokens.SPECIALS, **{f"[{'N' if i % 3 else 'C'}{i}]": i for i in range(5, 30)}}
    out = masking.collated(df, strategy, 0.3, 7, vocab, multiple=8).collect()
    assert len(out) == sum(bool(ids) for _, _, ids in rows)
    by_batch = {}
    for r in out:
        by_batch.setdefault(r.batch, set()).add(len(r.ids))
        assert len(r.ids) == len(r.inputs) == len(r.labels) == len(r.attention) and len(r.ids) % 8 == 0
        assert r.attention == [int(x != 1) for x in r.ids]
        assert all(label in (-100, x) and not (label != -100 and x in NEVER) for x, label in zip(r.ids, r.labels))
    assert all(len(n) == 1 for n in by_batch.values())
    if strategy != "standard":
        assert all(any(x != -100 for x in r.labels) for r in out if any(x not in NEVER for x in r.ids))
    with pytest.raises(ValueError):
        masking.collated(df, "other", 0.3, 7, vocab)
    with pytest.raises(ValueError):
        masking.collated(df.where("size(ids) = 0"), strategy, 0.3, 7, vocab)


def test_pooling_falls_back(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [5, 7, 2]), (2, [[1.0, 1.0], [5.0, 5.0], [9.0, 9.0]], [0, 2, 1]), (3, [[1.0, 1.0]], [1]), (4, [], [])]
    df = spark.createDataFrame(rows, "k int, h array<array<double>>, ids array<int>")
    got = {r.k: r.p for r in df.select("k", masking.pooled(F.col("h"), F.col("ids")).alias("p")).collect()}
    assert got == {1: [2.0, 4.0], 2: [3.0, 3.0], 3: None, 4: None}


def test_a_fingerprint_of_many_rows_wraps(spark, monkeypatch):
    from lodeweave.plans import masking as plans

    def facts(df, *a, **k):
        return spark.createDataFrame([(1, 1, 1, 0.5, 0, decimal.Decimal((1 << 63) + 7))], "n_rows long, n_eligible long, n_masked long, fraction double, n_illegal long, fingerprint decimal(38,0)")

    monkeypatch.setattr(masking, "frozen_facts", facts)
    assert plans.QUERIES["m06_frozen_set"][0](spark, "/root/testdata/sf0.001").first().fingerprint == 7

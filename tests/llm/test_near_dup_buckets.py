"""Buckets that hold several labels: what is dealt out, and that no link between labels is lost."""

import itertools
import random

import pytest

from lodeweave.llm import near_dup


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def near(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = "new" + str(rng.random())[2:6]
    return " ".join(out)


def frames(spark, rows, texts):
    return spark.createDataFrame(rows, "key long, node long, label long"), spark.createDataFrame(list(enumerate(texts)), "node long, text string")


def test_one_odd_member_does_not_open_the_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    rng = random.Random(1)
    base = words(rng, 60)
    texts = [near(rng, base, 1) for _ in range(800)] + [" ".join(words(rng, 60))]
    state, of = frames(spark, [(5, i, 0 if i < 800 else 800) for i in range(801)], texts)
    dealt, _ = near_dup.dealt_to_blocks(state, of)
    assert dealt.count() == 801 + 13  # each member once, the odd one once a block
    idf = near_dup.idf_table(of.select("text"))
    assert near_dup.resolved(state, of, idf).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_links_between_labels_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(2)
    bases = [words(rng, 60) for _ in range(4)]
    texts = [near(rng, bases[i % 4], rng.choice((0, 1, 2, 3))) for i in range(40)] + ["", "one"]
    label = [rng.choice([0, 0, 0, i]) for i in range(42)]
    buckets = {1: range(42), 2: [3, 9, 40], 3: [5, 6], 4: [3, 9, 40]}
    rows = [(k, i, label[i]) for k, members in buckets.items() for i in members]
    state, of = frames(spark, rows, texts)
    idf = near_dup.idf_table(of.select("text"))
    held = [near_dup.weighted(t, idf) for t in texts]
    parent = list(range(42))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    for a, b in itertools.combinations(range(42), 2):
        if label[a] != label[b] and near_dup.jaccard(held[a], held[b]) >= 0.8:
            join(label[a], label[b])
    want = {x: find(x) for x in set(label)}
    parent = list(range(42))
    for r in near_dup.resolved(state, of, idf).collect():
        join(r.a, r.b)
    assert {x: find(x) for x in set(label)} == want and len(set(want.values())) < len(want)

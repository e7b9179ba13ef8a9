"""Jump consistent hashing against a loop, slots against a sort, and edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeweave.llm import sharding


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def md5_60(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_walks_equal_a_loop(spark):
    rng = random.Random(2)
    keys = [0, 1, 42, 256, 0xDEAD10CC, 2**60 - 1] + [rng.randrange(2**60) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 40, 57, 666, 1024):
        got = {r.k: (r.shard, r.next) for r in df.select("k", sharding.walk(F.col("k"), shards)["shard"].alias("shard"), sharding.walk(F.col("k"), shards)["next"].alias("next")).collect()}
        for k in keys:
            assert got[k][0] == jump(k, shards)
            assert jump(k, got[k][1]) == got[k][0] and (got[k][1] > 5000 or jump(k, got[k][1] + 1) == got[k][1])
    # values published with the method
    assert (jump(42, 57), jump(0xDEAD10CC, 666), jump(256, 1024)) == (43, 361, 520)
    with pytest.raises(ValueError):
        sharding.walk(F.col("k"), 0)


@pytest.mark.parametrize("run", [2, 100_000])
def test_slots_equal_a_sort(spark, monkeypatch, run):
    monkeypatch.setattr(sharding, "RUN", run)
    rng = random.Random(3)
    texts = [None, "", "é日", "x" * 20000, "same"]
    rows = [(rng.choice([None, *range(120)]), rng.choice(texts), "own") for _ in range(900)] + [(7, "hot", "own")] * 25
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    want, by_shard = [], {}
    for i, t, _ in rows:
        data = (t or "").encode()
        size, crc, name = len(data) + 16, zlib.crc32(data), "" if i is None else str(i)
        key = md5_60(name)
        by_shard.setdefault(jump(key, 40), []).append((md5_60(f"{name}|{crc}|{size}"), i, size, crc, jump(key, 41)))
    for shard, held in by_shard.items():
        held.sort(key=lambda r: r[0])
        want += [(i, size, crc, "key", shard, slot, grown) for slot, (_, i, size, crc, grown) in enumerate(held)]
    got = sharding.assign(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sorted(map(str, sharding.assign(docs.repartition(7)).collect())) == sorted(map(str, got))


def test_one_more_shard_only_takes_rows(spark):
    keys = spark.range(20000).select(sharding.walk(sharding.key_of(F.col("id")), 40)["shard"].alias("a"), sharding.walk(sharding.key_of(F.col("id")), 41)["shard"].alias("b"))
    n = Counter((r.a, r.b) for r in keys.collect())
    moved = {k: v for k, v in n.items() if k[0] != k[1]}
    assert all(b == 40 for _, b in moved) and abs(sum(moved.values()) - 20000 / 41) < 120
    sizes = Counter()
    for (a, _), v in n.items():
        sizes[a] += v
    assert len(sizes) == 40 and max(sizes.values()) < 650 and min(sizes.values()) > 370


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.createDataFrame([(k % 30 if k % 4 else None, f"t{k}", "own") for k in range(200)], "doc_id long, text string, Shard string")
    sharding.write_shards(docs, f"{tmp_path}/out", 5, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text) for r in docs.collect())
    assert all(jump(md5_60("" if r.doc_id is None else str(r.doc_id)), 5) == r.shard for r in back.collect())
    assert sharding.assign(docs.limit(0)).count() == 0

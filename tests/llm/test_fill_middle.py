"""Fill-in-the-middle texts against whole token lists, and on edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import fill_middle

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
ODD = [None, "", " ", "\n\t \x0b", "a", " a", "a ", "é日 本 x  y", "x" * 9000, "word " * 4000, " " * 5000 + "end", "<P> in it", "a <M> b", "tail   \r\n"]


def by_list(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk_bytes", [1, 7, 64, 2048])
def test_forms_equal_whole_token_lists(spark, chunk_bytes):
    rng = random.Random(4)
    texts = ODD * 6 + ["".join(rng.choice(["a", "bé", "  ", "\n", "日", "x<", " "]) for _ in range(rng.randrange(400))) for _ in range(60)]
    ids = [None if k % 13 == 5 else k % 70 for k in range(len(texts))]  # null ids and repeated ones
    docs = spark.createDataFrame([(i, t, "own") for i, t in zip(ids, texts)], "doc_id long, text string, output string")
    got = fill_middle.transform(docs, chunk_bytes=chunk_bytes)
    rows = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *by_list(i, t)) for i, t in zip(ids, texts)]
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows))) == sorted(map(str, want))
    assert sorted(r.back for r in rows) == sorted(t or "" for t in texts)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    data = np.frombuffer(b"ab cd " * 5000, np.uint8)
    offsets = np.array([0, len(data)])
    calls = []
    real = fill_middle.ends
    monkeypatch.setattr(fill_middle, "ends", lambda d, b, e, last: calls.append(e - b) or real(d, b, e, last))
    n, place, before = fill_middle.cuts(data, offsets, lambda n: np.array([[3, 7000]]), 100)
    assert n[0] == 10001 and place[0].tolist() == [8, 7000 * 3 - 1] and before.tolist() == place.tolist()
    assert calls[-2:] == [100, 100] and sum(calls[:-2]) == len(data)


def test_no_rows_and_string_ids(spark):
    schema = "doc_id string, text string"
    assert fill_middle.digests(spark.createDataFrame([], schema)).count() == 0
    rows = fill_middle.digests(spark.createDataFrame([(f"id{k}", "some text here") for k in range(40)], schema)).collect()
    assert all(r.restored_sha256 == hashlib.sha256(b"some text here").hexdigest() for r in rows)
    assert {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars) for r in rows} == {(f"id{k}", *by_list(f"id{k}", "some text here")[:4]) for k in range(40)}

"""Token alignment against comparing all pairs of tokens of whole texts, and edge cases."""

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lodeweave.llm import alignment

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  \n ", "a", "é" * 9, "x" * 3000, "Hello world  \t and more 123's 'll", "<|endoftext|> <s> x</s>", "日本語 テキスト", "▁ not given back", "a b " * 900, "tail   ", "　 wide   x", "a" + " " * 200 + "b", "nul \x00 byte", "line\r\n  next\n\n end "]


def brute(texts):
    """All pairs of whole texts' tokens, by their byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path(alignment.VOCABULARY_A)
    a = Tokenizer.from_file(path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.VOCABULARY_B))
    byte = alignment.byte_of_character()
    entries = {i: t for t, i in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    docs, counts = [], Counter()
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        pa, pb = [bytes(byte[c] for c in entries[i]) for i in ids_a], [piece(i) for i in ids_b]
        if not t or b"".join(pa) != (" " + t).encode() or b"".join(pb) != (" " + t).encode():
            docs.append(None)
            continue
        sa, sb = spans(pa), spans(pb)
        links, low = [], 0
        for i, (s, e) in zip(ids_a, sa):
            while sb[low][1] <= s:
                low += 1
            k = low
            while k < len(sb) and sb[k][0] < e:
                links.append((i, ids_b[k]))
                k += 1
        both = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for e in both:
            groups.append(",".join(str(i) for i, s in zip(ids_a, sa) if start <= s[0] < e) + "|" + ",".join(str(i) for i, s in zip(ids_b, sb) if start <= s[0] < e))
            start = e
        counts.update(links)
        docs.append((len(ids_a), len(ids_b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(counts[x] == best[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), d[4]) for d in docs]


@pytest.mark.parametrize("chunk_chars", [1, 4000, alignment.CHUNK_CHARS])
def test_alignment_equals_all_pairs(spark, chunk_chars):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("n_chars").limit(60).collect()]
    ids = [None if k % 9 == 4 else k // 2 for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "own") for i, t in zip(ids, texts)], "doc_id long, text string, chunk string").repartition(3)
    got = sorted(str(tuple(r)) for r in alignment.align(docs, chunk_chars=chunk_chars).collect())
    assert got == sorted(str((i, *w)) for i, w in zip(ids, brute(texts)))


def test_segments_encode_as_within_the_text(spark):
    aligner = alignment.Aligner(public_tokenizers.path(alignment.VOCABULARY_A), public_tokenizers.path(alignment.VOCABULARY_B))
    assert aligner.cuts
    for t in [t for t in ODD if t] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]:
        parts = aligner.segments(" " + t)
        assert "".join(parts) == " " + t and all(p[0] == " " for p in parts)
        assert [i for p in parts for i in aligner.a.encode(p, add_special_tokens=False).ids] == aligner.a.encode(" " + t, add_special_tokens=False).ids
        assert [i for p in parts for i in aligner.b.encode(p[1:])] == aligner.b.encode(t)


def test_index_and_groups():
    def of(a, b):
        return [x.tolist() for x in alignment.overlaps(np.array(a, np.int64), np.array(b, np.int64))]

    assert of([4, 8, 10], [2, 6, 8, 9, 10]) == [[0, 1, 3], [2, 3, 5], [2, 4]]
    assert of([5], [1, 2, 5]) == [[0], [3], [2]]
    assert of([1, 2, 5], [5]) == [[0, 0, 0], [1, 1, 1], [0]]


def test_a_worker_forgets_segments_and_counts_on(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("n_chars").limit(90)
    want = sorted(map(str, alignment.align(docs).collect()))
    aligner = alignment.Aligner(public_tokenizers.path(alignment.VOCABULARY_A), public_tokenizers.path(alignment.VOCABULARY_B))
    first = aligner.documents(["some words and words", None])
    aligner.clear()
    assert first == [aligner.documents(["some words and words"])[0], []] and aligner.facts.shape == (3, 4)
    monkeypatch.setattr(alignment, "MOST_SEGMENTS", 50)
    assert sorted(map(str, alignment.align(docs.repartition(2)).collect())) == want


def test_no_rows_and_string_ids(spark):
    schema = "doc_id string, text string"
    assert alignment.align(spark.createDataFrame([], schema)).count() == 0
    rows = alignment.align(spark.createDataFrame([("x", None), ("y", "one two")], schema)).collect()
    assert {r.doc_id: r.n_a > 0 for r in rows} == {"x": False, "y": True}

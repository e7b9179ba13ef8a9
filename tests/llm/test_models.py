"""The learned models against loops: the network's forward pass and gradient, the n-gram models and their scores."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from lodeweave.llm import language_id, quality

P = 0x9E3779B97F4A7C15
M = 2**64


def forward(p, window):
    """Embedding, each filter at its own width at each place, its largest answer, softmax."""
    e = [p["e"][b].astype(float) for b in window]
    pooled = []
    for k, width in enumerate(language_id.WIDTHS):
        for f in range(k * language_id.FILTERS, (k + 1) * language_id.FILTERS):
            weights = p["f"][:, f].astype(float).reshape(-1, language_id.EMBEDDING)
            answers = [sum(float(weights[j] @ e[at + j]) for j in range(width)) for at in range(len(window) - max(language_id.WIDTHS) + 1)]
            pooled.append(max(0.0, max(answers) + float(p["fb"][f])))
    z = [sum(h * float(w) for h, w in zip(pooled, p["w"][:, c])) + float(p["b"][c]) for c in range(p["w"].shape[1])]
    top = max(z)
    z = [math.exp(x - top) for x in z]
    return [x / sum(z) for x in z]


def windows(n, length, seed):
    out = np.random.default_rng(seed).integers(1, 256, (n, length)).astype(np.uint8)
    out[0, length // 2 :] = 0  # padded
    return out


def test_probabilities_equal_a_loop():
    net = language_id.ByteCNN(["a", "b", "c"])
    some = windows(5, 24, 1)
    assert np.allclose(net.probabilities(some), [forward(net.p, w) for w in some], atol=1e-5)
    assert np.allclose(net.probabilities(windows(70, 24, 2)), [forward(net.p, w) for w in windows(70, 24, 2)], atol=1e-5)


def test_first_step_goes_down_the_numeric_gradient(monkeypatch):
    monkeypatch.setattr(language_id, "EPOCHS", 1)
    monkeypatch.setattr(language_id, "STEPS", 0)
    some, y = windows(4, 20, 3), np.array([0, 1, 1, 0])
    net = language_id.ByteCNN(["a", "b"])
    before = {k: v.copy() for k, v in net.p.items()}
    net.fit(some, y)

    def loss(p):
        return -sum(math.log(forward(p, w)[c]) for w, c in zip(some, y)) / len(y)

    rng, told = np.random.default_rng(4), 0
    for name, v in before.items():
        moved = net.p[name] - v
        places = list(itertools.product(*map(range, v.shape)))
        used = [i for i in places if name != "e" or i[0] in some]
        for i in (used[k] for k in rng.choice(len(used), min(25, len(used)), replace=False)):
            if name == "f" and not net.mask[i] or name == "e" and i[0] == 0:
                assert moved[i] == 0  # weights outside a narrow filter, and the padding, stay zero
                continue
            up, down = ({k: x.astype(float) for k, x in before.items()} for _ in range(2))
            up[name][i] += 1e-4
            down[name][i] -= 1e-4
            slope = (loss(up) - loss(down)) / 2e-4
            if abs(slope) > 1e-4:  # Adam's first step is as long as the rate, against the gradient
                assert moved[i] == pytest.approx(-language_id.RATE * np.sign(slope), rel=0.02)
                told += 1
    assert told > 40


def tokens(text):
    def kind(b):
        return 0 if b in b"\t\n\x0b\x0c\r " else 1 if b >= 128 or chr(b).isalnum() or b == 95 else 2

    return [bytes(g) for k, g in itertools.groupby(text.encode(), kind) if k]


def scramble(h):
    h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 % M
    return h ^ h >> 29


def buckets(text):
    hashes = [scramble(sum((b + 1) * pow(P, k, M) for k, b in enumerate(t.lower())) % M) for t in tokens(text)]
    pairs = [scramble((a * P + b) % M) for a, b in zip(hashes, hashes[1:])]
    return [(h >> 40) % quality.BUCKETS for h in hashes + pairs]


TEXTS = ["The cat, the CAT!! sat_1", "", None, " \n ", "é日 本x", "a" * 300, "... --", "one two one two one", "x"]


def test_counts_models_and_scores_equal_loops(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string").repartition(3)
    want = Counter(b for t in TEXTS * 2 if t for b in buckets(t))
    raw = quality.bucket_counts(docs)
    assert {int(b): int(raw[b]) for b in np.flatnonzero(raw)} == want
    target = quality.bucket_counts(docs.where("doc_id IN (0, 7)"))
    ratio = quality.log_ratio(target, raw)
    smooth = quality.PRIOR * quality.BUCKETS
    for b in [*want, 1, 2]:
        base = (raw[b] + 1) / (raw.sum() + quality.BUCKETS)
        assert ratio[b] == pytest.approx(math.log((target[b] + smooth * base) / (target.sum() + smooth) / base))
    got = {r.doc_id: r.score for r in quality.scored(docs, ratio, ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        held = buckets(t or "")
        assert got[i] == (pytest.approx(np.mean([ratio[b] for b in held])) if held else None)


def test_cut_costs_least():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(1, 25))
        scores, good = rng.permutation(n).astype(float), rng.integers(0, 2, n)

        def cost(at):
            return sum(10.0 if g else 0.0 for s, g in zip(scores, good) if s < at) + sum(1.0 for s, g in zip(scores, good) if s >= at and not g)

        at = quality.best_cut(scores, good)
        assert cost(at) == min(cost(c) for c in [-np.inf, np.inf, *(scores + 0.5)])


def test_samples_stay_bounded_when_rows_repeat_an_id(spark):
    texts = [f"bonjour le monde numero {i} " * 3 if i % 2 else f"hello the world number {i} " * 3 for i in range(60)]
    rows = [(i, t, "fr" if i % 2 else "en") for i, t in enumerate(texts)] + [(2, texts[2], "en")] * 500 + [(None, "x y", "en")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, fit_docs=4)
    assert model.labels == ["en", "fr"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    scores, cut = quality.fitted_scores(docs.select("doc_id", "text"), labels, ["doc_id"])
    assert scores.count() == len(rows) and cut == cut

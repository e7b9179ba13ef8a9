"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths slide over a fixed-length window; each filter keeps its largest answer in
the window; a softmax layer reads these. A document is cut into windows that overlap by the largest width less one and
cover it wholly; its probabilities are the mean of its windows', weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm._common import aside

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8
#: The bound on labelled rows: about so many documents per language are fitted on, with so many windows each.
FIT_DOCS, FIT_WINDOWS = 600, 3
#: Small samples are gone through more often than EPOCHS, until STEPS steps are made.
EPOCHS, STEPS, BATCH, RATE, SEED = 12, 1350, 64, 0.003, 11
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """Whether nothing may be learned from a document: crc32 of its id's text leaves 1 when divided by 3. Null id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class ByteCNN:
    """The network. Filters narrower than the widest are held as wide ones whose missing weights stay zero."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels, self.width = labels, max(WIDTHS)
        n = FILTERS * len(WIDTHS)
        self.mask = np.zeros((self.width, EMBEDDING, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(-1, n)
        self.p = {
            "e": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            "f": (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32),
            "fb": np.zeros(n, np.float32),
            "w": rng.normal(0, 0.1, (n, len(labels))).astype(np.float32),
            "b": np.zeros(len(labels), np.float32),
        }
        self.p["e"][0] = 0  # byte 0 pads

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        x = self.p["e"][windows]
        n, length, _ = x.shape
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, length - self.width + 1, self.width * EMBEDDING), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Rows of softmax outputs for rows of bytes."""
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for at in range(0, len(windows), 32):  # small enough for the answers to stay in the cache
            patches = self._patches(windows[at : at + 32])
            answers = (patches.reshape(-1, patches.shape[2]) @ self.p["f"]).reshape(len(patches), -1, self.p["f"].shape[1])
            z = np.maximum(answers.max(1) + self.p["fb"], 0) @ self.p["w"] + self.p["b"]
            z = np.exp(z - z.max(1, keepdims=True))
            out[at : at + 32] = z / z.sum(1, keepdims=True)
        return out

    def fit(self, windows: np.ndarray, y: np.ndarray) -> ByteCNN:
        """Adam on the cross entropy; a filter's gradient goes to the place of its largest answer."""
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(y)))):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                take = order[at : at + BATCH]
                some = windows[take]
                patches = self._patches(some)
                answers = patches @ self.p["f"]
                best = answers.argmax(1)
                pooled = np.take_along_axis(answers, best[:, None, :], 1)[:, 0] + self.p["fb"]
                h = np.maximum(pooled, 0)
                z = h @ self.p["w"] + self.p["b"]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(take)), y[take]] -= 1
                z /= len(take)
                g = {"w": h.T @ z, "b": z.sum(0)}
                dh = (z @ self.p["w"].T) * (pooled > 0)
                at_best = np.take_along_axis(patches, best[:, :, None], 1)
                g["fb"] = dh.sum(0)
                g["f"] = np.einsum("nk,nkd->dk", dh, at_best) * self.mask
                dpatch = (dh[:, :, None] * self.p["f"].T[None]).reshape(len(take), -1, self.width, EMBEDDING)
                read = some[np.arange(len(take))[:, None, None], best[:, :, None] + np.arange(self.width)]
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], read.ravel(), dpatch.reshape(-1, EMBEDDING))
                g["e"][0] = 0
                t += 1
                for k, grad in g.items():
                    m[k] += 0.1 * (grad - m[k])
                    v2[k] += 0.001 * (grad * grad - v2[k])
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def cut(data: bytes, width: int = max(WIDTHS), window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text's bytes and how many bytes each holds first; the last is padded with zero bytes."""
    step = window - width + 1
    n = max(1, -(-max(len(data) - width + 1, 1) // step))
    padded = np.zeros(step * (n - 1) + window, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    held = np.minimum(step, np.maximum(len(data) - step * np.arange(n), 1))
    return np.lib.stride_tricks.as_strided(padded, (n, window), (step, 1)), held


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> ByteCNN | None:
    """Fits on a bounded sample of labelled documents that are not held out; None if there are none.

    Rows are picked by a hash of their id, a share of each language that gives about `fit_docs`, and give windows at
    places picked by the same hash. Rows that give the same windows count once, and the sample ends at twice its size.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(fit_docs / n)) for k, n in sorted(sizes.items())])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52))
    picked = known.where(drawn < share * (1 << 52))
    places = F.array(*[(F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))) + 1).cast("int") for k in range(FIT_WINDOWS)])
    text = F.col("text")
    parts = picked.select("doc_id", "lang", drawn.alias("drawn"), F.transform(F.array_distinct(places), lambda at: text.substr(at, F.lit(WINDOW))).alias("parts")).distinct()
    # rows that repeat an id come together: at most twice as many as meant go to the driver
    rows = parts.orderBy("drawn", "doc_id", "lang", "parts").limit(2 * fit_docs * len(sizes)).drop("drawn").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["parts"]))
    labels = sorted(sizes)
    # every third window is cut short, since many texts are
    cuts = np.random.default_rng(SEED).integers(6, 80, len(rows))
    parts = [(part.encode()[: WINDOW if k < 2 else n], labels.index(r["lang"])) for r, n in zip(rows, cuts, strict=True) for k, part in enumerate(r["parts"])]
    if not parts:
        return None
    return ByteCNN(labels).fit(np.concatenate([cut(p)[0][:1] for p, _ in parts]), np.array([y for _, y in parts]))


def predict(docs: DataFrame, model: ByteCNN | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all), and lang_pred, score: the language of each whole text.

    `und` with score 0 if the text is null or has no letter, or if nothing could be learned. Columns of docs that are
    called lang_pred or score are replaced. Every row gives a row.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    sent = docs.select(*kept, F.col("text").alias("__text"))
    schema = sent.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(part.num_columns - 1).to_pylist()
                names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                for i, text in enumerate(texts):
                    if model is None or not text or not LETTER.search(text):
                        continue
                    windows, held = cut(text.encode())
                    p = np.average(model.probabilities(windows), axis=0, weights=held)
                    names[i], scores[i] = model.labels[int(p.argmax())], min(1.0, float(p.max()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"]
                )

    return sent.mapInArrow(run, schema)


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; see train() and predict()."""
    out = predict(docs.select("doc_id", "text"), train(docs, fit_docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.4, fit_docs: int = FIT_DOCS) -> DataFrame:
    """The documents whose language is determined with a score of `least` or more, with their own columns."""
    renamed, back = aside(docs, ("lang_pred", "score"))
    out = predict(renamed, train(docs, fit_docs))
    return back(out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)))

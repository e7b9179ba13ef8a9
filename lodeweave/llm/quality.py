"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

After Xie et al., "Data Selection for Language Models via Importance Resampling" (2023): tokens are runs of word
characters or of punctuation, lower case for ASCII; one- and two-token features are hashed into buckets; a document's
log importance is the sum over its features of log p_target - log p_raw. It is divided by the number of features here,
so that length does not decide, and scaled by an inverse temperature before the Gumbel noise comes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm._common import written

BUCKETS = 1 << 16
#: Pseudo-counts of the models: a share of the raw model is mixed into both, so unseen buckets say nothing.
PRIOR = 0.5
#: The bound on labelled rows that the target model and the cut are fitted on.
FIT_ROWS = 20_000
#: Log importance a feature, times this, is what Gumbel noise of scale 1 is added to.
SHARPNESS = 400.0
SEED = 5

_CLASS = np.full(256, 2, np.uint8)  # punctuation
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
for _first, _last in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _CLASS[_first : _last + 1] = 1
_CLASS[95] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all one- and two-token features of texts, and each feature's text. data: their bytes, ends: where each ends."""
    low = _LOWER[data]
    kind = _CLASS[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    firsts = np.concatenate([[0], ends[:-1]])
    fresh[firsts[firsts < len(data)]] = True
    starts = np.flatnonzero(fresh)
    token = starts[kind[starts] > 0]
    stops = np.append(starts, len(data))[np.searchsorted(starts, token) + 1]
    # a token's hash: its bytes as a polynomial, by differences of running sums
    power = np.full(int((stops - token).max(initial=0)) + 1, _P, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    length = stops - token
    at = np.repeat(token - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    within = at - np.repeat(token, length)
    terms = (low[at].astype(np.uint64) + np.uint64(1)) * power[within]
    hashes = _scramble(np.add.reduceat(terms, np.concatenate([[0], np.cumsum(length)[:-1]])) if len(token) else terms)
    owner = np.searchsorted(ends, token, side="right")
    paired = owner[1:] == owner[:-1]
    pairs = _scramble(hashes[:-1] * _P + hashes[1:])[paired]
    both = np.concatenate([hashes, pairs])
    return (both >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate([owner, owner[:-1][paired] if len(owner) else owner])


def _batches(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (from, to) of a batch of about `most_bytes` of text each, with their bytes and ends."""
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or b"") <= most_bytes):
            size += len(texts[to] or b"")
            to += 1
        some = [t or b"" for t in texts[at:to]]
        yield at, to, np.frombuffer(b"".join(some), np.uint8), np.cumsum([len(t) for t in some])
        at = to


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket's features occur in all texts: one partial count per task, summed by Spark, BUCKETS rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, ends in _batches(batch, 0):
                if len(data):
                    total += np.bincount(features(data, ends)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    summed = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    held = summed.toArrow()
    out[held.column("bucket").to_numpy()] = held.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, both smoothed towards the raw model."""
    base = (raw + 1) / (raw.sum() + len(raw))
    smooth = PRIOR * len(raw)
    return np.log((target + smooth * base) / (target.sum() + smooth)) - np.log(base)


def scored(docs: DataFrame, ratio: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep` and score: the mean log ratio of the text's features, null without features."""
    keep = [c for c in keep if c != "score"]
    sent = docs.select(*keep, F.col("text").alias("__text"))
    schema = sent.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, ends in _batches(batch, batch.num_columns - 1):
                bucket, owner = features(data, ends) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                n = np.bincount(owner, minlength=to - at)
                total = np.bincount(owner, weights=ratio[bucket], minlength=to - at)
                score = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
                yield pa.RecordBatch.from_arrays([*[c.slice(at, to - at) for c in batch.columns[:-1]], score], [*keep, "score"])

    return sent.mapInArrow(run, schema)


def best_cut(scores: np.ndarray, good: np.ndarray, good_weight: float = 10.0) -> float:
    """The score from which on a document counts as target: losing a good labelled one costs good_weight bad ones kept."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order].astype(bool)
    if not len(s) or g.all():
        return -np.inf
    cost = np.concatenate([[0.0], np.cumsum(np.where(g, good_weight, -1.0))])
    k = int(cost.argmin())
    return -np.inf if k == 0 else np.inf if k == len(s) else float((s[k - 1] + s[k]) / 2)


def gumbel_top_k(scores: DataFrame, k: int, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """scores and kept: the k rows with the largest sharpness * score + Gumbel noise of the id's hash, a sample without
    replacement weighted by importance.

    Exact without a global sort: the k-th key is found by counting keys in ever finer bins (at most 4096 counts reach the
    driver each time); rows above it are kept, and of those equal to it as many as are missing, smallest ids first. Rows
    that repeat id and score are kept together, even if that makes more than k. Rows without a score come last.
    """
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = F.coalesce(sharpness * F.col("score"), F.lit(-1e9)) - F.log(-F.log(u))
    # fixed point: equal keys stay equal, and bins are exact
    keyed = scores.withColumn("__key", F.round(key * 1e6).cast("long"))
    low, wanted = keyed.agg(F.min("__key")).first()[0], k
    if low is None or k <= 0:
        return scores.withColumn("kept", F.lit(False))
    width = 1 << 60
    while width > 1:
        finer = max(1, width >> 12)
        inside = keyed.where((F.col("__key") >= low) & (F.col("__key") - low < width))
        bins = inside.groupBy(F.floor((F.col("__key") - low) / F.lit(finer)).cast("long").alias("bin")).count().collect()
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if row["count"] >= wanted:
                break
            wanted -= row["count"]
        else:
            return scores.withColumn("kept", F.lit(True))
        low, width = low + row["bin"] * finer, finer
    ids = keyed.where(F.col("__key") == low).select("doc_id").orderBy(F.col("doc_id").asc_nulls_first()).limit(wanted)
    last = ids.agg(F.max("doc_id")).first()[0]
    equal = (F.col("__key") == low) & F.coalesce(F.col("doc_id") <= F.lit(last), F.col("doc_id").isNull())
    return keyed.withColumn("kept", (F.col("__key") > low) | equal).drop("__key")


def fitted_scores(docs: DataFrame, labels: DataFrame, keep: list[str], fit_rows: int = FIT_ROWS) -> tuple[DataFrame, float]:
    """The scores of all documents as a written table, and the cut.

    The raw model counts all texts. The target model counts the texts of a bounded sample, picked by a hash of the id,
    of those labelled quality = 1, one half of it; the cut is where the other half parts best. Labels that repeat an id count once; of texts that
    repeat an id the first in order is in the sample.
    """
    raw = bucket_counts(docs)
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    share = min(1.0, fit_rows / max(1, ids.count()))
    ids = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(1 << 52)) < share * (1 << 52)).withColumnRenamed("doc_id", "__label_id")
    # one text an id, so rows that repeat an id don't make the sample larger
    sample = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__label_id")).groupBy("doc_id", "__quality").agg(F.min("text").alias("text"))
    sample = written(sample, "labelled")
    # the model has seen the texts it is fitted on, so the cut comes from the other half
    fit = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 2)), F.lit(2)) == 0
    ratio = log_ratio(bucket_counts(sample.where(fit & (F.col("__quality") == 1))), raw)
    rows = scored(sample.where(~fit), ratio, ["__quality"]).where("score IS NOT NULL").toArrow()
    cut = best_cut(rows.column("score").to_numpy(), rows.column("__quality").to_numpy())
    return written(scored(docs, ratio, keep), "scores"), cut


def resample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, score, kept. As many are kept as have a score at the cut or above; which ones, Gumbel top-k draws.

    Null texts and texts without a token have a null score and are kept only if all rows are. Without labels all are
    kept. Rows that repeat an id are kept or not together with it if their scores agree. Other columns are ignored.
    """
    scores, cut = fitted_scores(docs.select("doc_id", "text"), labels, ["doc_id"], fit_rows)
    k = scores.where(F.coalesce(F.col("score") >= F.lit(float(cut)), F.lit(bool(cut == -np.inf)))).count()
    return gumbel_top_k(scores, k).select("doc_id", "score", "kept")


def select_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that resample() keeps, with their own columns but those called score or kept."""
    own = [c for c in docs.columns if c.lower() not in ("score", "kept")]
    scores, cut = fitted_scores(docs, labels, own, fit_rows)
    k = scores.where(F.coalesce(F.col("score") >= F.lit(float(cut)), F.lit(bool(cut == -np.inf)))).count()
    return gumbel_top_k(scores, k).where("kept").select(*own)

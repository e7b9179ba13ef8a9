"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document's shingles are its runs of five words (all words if fewer), weighted by their count in it times their idf. idf
is 1 + IDF_SHARE * ln(N / df) / ln(1 / RARE), where df is the exact number of documents with the shingle, taken as RARE * N
where it is less: the weighting is the same at every size, and only shingles in RARE of all documents have to be known by
name. Each of the hash functions keeps one (shingle, level) of a document as Ioffe's consistent weighted sampling (2010)
prescribes: two documents agree in it with the probability of their weighted Jaccard similarity. The random numbers of a
shingle come from pools that its hash indexes. Bands of agreeing samples make buckets.

Buckets are resolved in two steps. First every member is compared with its bucket's first member, which is linear and puts
copies of one text into one class. Then each bucket that still holds several classes (one of those with the same members)
is compared whole: an inverted index of its shingles gives the exact similarities of a text to all others at once, and only
links between classes leave it. Buckets above BLOCK members or BLOCK_BYTES are compared in pairs of blocks, so no task
holds more than two blocks, no pair is lost to a cap, and no pair that is not a link is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.llm._common import components, dropped, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
#: Signatures of two documents have to agree in so many places before texts are compared: at similarity 0.8 fewer have a chance of 1e-7.
LEAST_AGREE = 28
#: Shingles in less than RARE of the documents have the idf of RARE. Weights are multiples of 1 / GRAIN, so sums are exact.
RARE, IDF_SHARE, GRAIN = 1e-3, 0.25, 1024.0
#: Counters that tell which shingles may be in RARE of the documents, and how many are sent in a row.
IDF_BUCKETS, IDF_BLOCK = 1 << 20, 1 << 12
#: A bucket with more members or bytes of text is compared in pairs of blocks.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
POOL = 1 << 16
SEED = 23

_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the runs of `words` words (between ASCII white space) of a text, repeats included; of all words if fewer."""
    own = (text or "").encode().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _P + h[k : len(h) - n + 1 + k]
    return _mix(out)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % IDF_BUCKETS


class Idf:
    """idf of shingles: of those in `hashes` (sorted) as in `values`, of all others the largest there is."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, rest: float):
        self.hashes, self.values, self.rest = np.append(hashes, np.uint64(2**64 - 1)), np.append(values, rest), rest

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, h)
        return np.where(self.hashes[at] == h, self.values[at], self.rest)


def _distinct_by_text(texts: pa.Array) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), 256):
        for text in texts.slice(at, 256).to_pylist():
            yield np.unique(shingles(text))


def idf_table(texts: DataFrame) -> Idf:
    """idf from all rows of `texts` (column text).

    Two passes: hashed counters, summed over all documents, tell which shingles may be in RARE of them; only those are
    counted by name. At most 1 / RARE times the mean number of shingles of a document reach that share, so the table that
    the driver collects and broadcasts does not grow with the number of documents.
    """
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(IDF_BUCKETS, np.int32)
        n = 0
        for batch in batches:
            for h in _distinct_by_text(batch.column(0)):
                n += 1
                held[np.unique(_bucket(h))] += 1
        for k, block in enumerate(held.reshape(-1, IDF_BLOCK)):
            if k == 0 or block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n if k == 0 else 0], pa.int64()), pa.array([block.astype(np.int64)], pa.list_(pa.int64()))], ["block", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k, n, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = sums.setdefault(k, [0, np.zeros(IDF_BLOCK, np.int64)])
                own[0] += n
                own[1] += counts.values.to_numpy()
        for k, (n, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([counts], pa.list_(pa.int64()))], ["block", "n", "counts"])

    schema = "block int, n long, counts array<long>"
    table, total = np.zeros((IDF_BUCKETS // IDF_BLOCK, IDF_BLOCK), np.int64), 0
    summed = texts.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    for row in summed.toLocalIterator():
        table[row["block"]] = row["counts"]
        total += row["n"]
    total = max(total, 2)
    least = max(1, total * RARE)
    full = spark.sparkContext.broadcast(np.packbits(table.ravel() >= least))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(full.value).astype(bool)
        held: list[np.ndarray] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], ["shingle", "df"])
            held.clear()

        for batch in batches:
            for h in _distinct_by_text(batch.column(0)):
                held.append(h[wanted[_bucket(h)]])
                size += len(held[-1])
                if size > 2_000_000:
                    yield from rows()
                    size = 0
        if held:
            yield from rows()

    known = texts.select("text").mapInArrow(name, "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") >= least).toArrow()
    full.unpersist()
    h = known.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(h)
    df = known.column("df").to_numpy().astype(np.float64)[order]
    idf = lambda df: np.round((1 + IDF_SHARE * np.minimum(np.log(total / df) / math.log(1 / RARE), 1)) * GRAIN) / GRAIN
    return Idf(h[order], idf(df), float(idf(least)))


def weighted(text: str | None, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct shingles, sorted, and their weights: count times idf."""
    h, n = np.unique(shingles(text), return_counts=True)
    return h, n * idf(h)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the sum of the smaller weights by the sum of the larger. 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 0.0


class Sampler:
    """Consistent weighted samples of weighted shingles."""

    def __init__(self, n: int = BANDS * ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, POOL).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, POOL)).astype(np.float32)
        self.beta = rng.random(POOL).astype(np.float32)
        self.odd = (rng.integers(1, 1 << 62, (n, 1)).astype(np.uint64) << np.uint64(1)).astype(np.uint32) | np.uint32(1)

        self.usual: tuple[float, np.ndarray, np.ndarray] | None = None

    def _level(self, log_w: np.ndarray, i: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        r, beta = self.r[i], self.beta[i]
        t = np.floor(log_w * self.inverse[i] + beta)
        return self.log_c[i] - r * (t - beta + 1), t

    def samples(self, h: np.ndarray, w: np.ndarray, usual: float = 0.0) -> np.ndarray:
        """One 64-bit value for each hash function; equal if shingle and level are. Weights `usual` are read from a table."""
        if self.usual is None or self.usual[0] != usual:
            self.usual = (usual, *self._level(np.log(np.float32(usual or 1)), slice(None)))
        _, usual_a, usual_t = self.usual
        most = w == usual
        best = np.full(len(self.odd), np.inf, np.float32)
        best_at, best_t = np.zeros(len(best), np.int64), np.zeros(len(best), np.float32)
        rows = np.arange(len(best))
        short = (h >> np.uint64(32)).astype(np.uint32)
        for own in (True, False):
            places = np.flatnonzero(most == own)
            for at in range(0, len(places), 2048):
                some = places[at : at + 2048]
                i = ((short[None, some] * self.odd) >> np.uint32(16)).astype(np.int64)
                log_a, t = (usual_a.take(i, mode="wrap"), None) if own else self._level(np.log(w[some]).astype(np.float32), i)
                k = log_a.argmin(1)
                low = log_a[rows, k]
                level = usual_t[i[rows, k]] if own else t[rows, k]
                less = low < best
                best, best_at, best_t = np.where(less, low, best), np.where(less, some[k], best_at), np.where(less, level, best_t)
        return _mix(h[best_at] + _mix(best_t.astype(np.int64).astype(np.uint64)))


def _digest() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)


def _key(doc_id: str | Column, exact: str | Column) -> Column:
    """One column for an id, which may be null, and a digest: joins and groups by it need one exchange."""
    return F.concat_ws("|", exact, F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def signatures(docs: DataFrame, idf: Idf) -> DataFrame:
    """Rows (doc_id, exact, keys array<long>, sig array<int>): the text's digest, its band keys and its samples; empty arrays without words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)  # bounded: see idf_table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, table = Sampler(), shared.value
        salt = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, sigs = [], []
                for text in part.column(2).to_pylist():
                    h, w = weighted(text, table)
                    if not len(h):
                        keys.append(np.zeros(0, np.int64))
                        sigs.append(np.zeros(0, np.int32))
                        continue
                    s = sampler.samples(h, w, table.rest)
                    band = salt.copy()
                    for k in range(ROWS):
                        band = band * _P + s.reshape(BANDS, ROWS)[:, k]
                    keys.append(_mix(band).view(np.int64))
                    sigs.append((s >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "exact", "keys", "sig"])

    sent = docs.select("doc_id", _digest().alias("exact"), "text")
    return sent.mapInArrow(run, sent.select("doc_id", "exact").schema.add("keys", T.ArrayType(T.LongType())).add("sig", T.ArrayType(T.IntegerType())))


def verified(pairs: DataFrame, texts: DataFrame, idf: Idf, similarity: float = SIMILARITY) -> DataFrame:
    """Of pairs (a, b) of ids, those whose texts have the similarity. texts: (node, text)."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        last_text, last = None, None
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 64):
                good = []
                rows = zip(batch.column(2).slice(at, 64).to_pylist(), batch.column(3).slice(at, 64).to_pylist(), strict=True)
                for one, other in rows:
                    if last is None or one != last_text:
                        last_text, last = one, weighted(one, table)
                    good.append(jaccard(last, weighted(other, table)) >= similarity)
                mask = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.slice(at, 64).filter(mask), b.slice(at, 64).filter(mask)], ["a", "b"])

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, pairs.select("a", "b").schema)


def _links_inside(nodes: np.ndarray, labels: np.ndarray, first: np.ndarray, second: np.ndarray, texts: list, idf: Idf, similarity: float) -> list[tuple[int, int]]:
    """Links (label, label) that connect the classes of similar texts, one of `first` and one of `second` each (masks)."""
    held = []
    for text in texts:
        h = np.sort(shingles(text))
        run = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0) if len(h) else np.zeros(0, np.int64)
        # of a shingle that occurs n times, occurrence 1 to n each are an element: shared ones weigh the smaller count
        nth = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
        held.append((_mix(h + nth.astype(np.uint64) * _M) if nth.any() else _mix(h), idf(h)))
    ends = np.concatenate([[0], np.cumsum([len(h) for h, _ in held])])
    everything = np.concatenate([h for h, _ in held])
    weight = np.concatenate([w for _, w in held])
    total = np.add.reduceat(np.append(weight, 0), ends[:-1]) * (np.diff(ends) > 0)
    _, element, n = np.unique(everything, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(held)), np.diff(ends))[np.argsort(element, kind="stable")]
    begin = np.cumsum(n) - n
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    names, counts = np.unique(labels, return_counts=True)
    rest = np.flatnonzero(labels != names[counts.argmax()])  # a link between classes has an end outside the largest
    out = []
    for x in rest.tolist():
        mine = element[ends[x] : ends[x + 1]]
        shared = n[mine] > 1
        size, at = n[mine][shared], begin[mine][shared]
        places = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = np.bincount(owner[places], np.repeat(weight[ends[x] : ends[x + 1]][shared], size), len(held))
        alike = both >= similarity * (total[x] + total - both)
        alike &= (both > 0) & (labels != labels[x]) & ((first & second[x]) | (second & first[x]))
        for y in np.flatnonzero(alike).tolist():
            a, b = find(int(labels[x])), find(int(labels[y]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((min(a, b), max(a, b)))
    return out


def dealt_to_blocks(state: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, block, odd, role, node, label, text): the members of open buckets, dealt so that links between labels are found; and the written table it reads.

    A link between labels has an end outside the bucket's most frequent label: an odd member. Members are dealt to
    blocks, in role 0, and odd members are dealt to blocks of their own, in role 1; each block of the one meets each
    block of the other. So rows number as members times blocks of odd members and odd members times blocks: with few odd
    members about as many as members, however many these are.
    """
    by_label = state.groupBy("key", "label").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (1, 2)])
    several = by_label.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("most"), *[F.bit_xor(f"mark{k}").alias(f"mark{k}") for k in (1, 2)])
    # two members have been compared; buckets with the same members hold the same pairs
    several = several.where("n > 2 AND labels > 1").groupBy("n", "mark1", "mark2").agg(F.min(F.struct("key", "most")).alias("first")).select("first.key", "first.most")
    odd = F.col("label") != F.col("most")
    open_ = written(state.join(several, "key").select("key", "node", "label", odd.alias("is_odd")).join(texts, "node").select("key", "node", "label", "is_odd", "text"), "open")

    def number(of) -> Column:
        size = F.octet_length("text")
        return F.greatest(F.lit(1), F.ceil(F.sum(F.when(of, 1)) / BLOCK), F.ceil(F.sum(F.when(of, size)) / BLOCK_BYTES)).cast("int")

    blocks = open_.groupBy("key").agg(number(F.lit(True)).alias("blocks"), number(F.col("is_odd")).alias("odds"))
    rows = open_.join(blocks, "key").withColumn("own", F.xxhash64("node"))
    members = rows.select("key", F.pmod("own", F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("odds") - 1)).alias("odd"), F.lit(0).alias("role"), "node", "label", "text")
    others = rows.where("is_odd").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod("own", F.col("odds")).cast("int").alias("odd"), F.lit(1).alias("role"), "node", "label", "text")
    return members.union(others), open_


def resolved(state: DataFrame, texts: DataFrame, idf: Idf, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between labels, from the pairs of members with different labels in each bucket that holds several. state: (key, node, label)."""
    shared = state.sparkSession.sparkContext.broadcast(idf)
    dealt, open_ = dealt_to_blocks(state, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        group, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            role, node, label = (np.concatenate([p.column(k).to_numpy() for p in held]) for k in (3, 4, 5))
            texts = [t for p in held for t in p.column(6).to_pylist()]
            pairs = _links_inside(node, label, role == 1, role == 0, texts, table, similarity)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(3)]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                now = tuple(int(c[a]) for c in columns)
                if now != group and held:
                    yield from found()
                    held.clear()
                group = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from found()

    ordered = dealt.repartition("key", "block", "odd").sortWithinPartitions("key", "block", "odd")
    links = written(ordered.mapInArrow(run, "a long, b long"), "between")
    dropped(open_)
    return links


def labelled(docs: DataFrame, exact: DataFrame, idf: Idf, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the nodes that have near-duplicates.

    exact: (node, doc_id, exact, keys, sig), one row per distinct text, with its smallest id (null if none) and digest.
    """
    members = exact.select("node", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").select("key", "first")
    state = written(members.join(shared, "key"), "state")
    pairs = written(state.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    sigs = exact.select("node", "sig")
    alike = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    alike = written(alike.where(agree >= LEAST_AGREE).select("a", "b"), "alike")
    dropped(pairs)
    # a text is read from the rows of its smallest id, so copies are not gathered
    touched = alike.select(F.col("a").alias("node")).union(alike.select("b")).union(state.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").join(state, "key").select("node")).distinct()
    of_node = exact.join(touched, "node", "left_semi").select("node", _key("doc_id", "exact").alias("key"))
    texts = docs.select(_key("doc_id", _digest()).alias("key"), "text").join(of_node, "key")
    texts = written(texts.groupBy("key", "node").agg(F.min("text").alias("text")).select("node", "text"), "texts")
    roots = components(verified(alike, texts, idf, similarity))
    roots = written(roots, "labels")
    dropped(alike)
    state_labels = state.join(roots, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    links = resolved(state_labels, texts, idf, similarity)
    for t in (state, texts):
        dropped(t)
    # labels that links connect; the rest keep theirs
    further = written(components(links).select(F.col("node").alias("label"), F.col("component").alias("whole")), "further")
    own = roots.select("node", F.col("component").alias("label")).union(further.join(roots, F.col("label") == F.col("component"), "left_anti").select("label", "label"))
    out = written(own.join(further, "label", "left").select("node", F.coalesce("whole", "label").alias("component")), "components")
    for t in (roots, links, further):
        dropped(t)
    return out


def _classed(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row, doc_id, exact), texts (exact, component) and components (component, first) with
    first = (no_id, doc_id, exact, row), the first row by doc_id, nulls last, and digest. Nodes are numbers of the distinct texts, so ids may be null or repeated.
    """
    docs = docs.select("doc_id", "text")
    idf = idf_table(docs)
    # no text: a digest of its own
    own = F.coalesce("exact", F.concat(F.lit("none:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), "row"))))
    signed = written(signatures(docs, idf).withColumn("row", F.monotonically_increasing_id()).withColumn("exact", own), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "exact", "row")).alias("first")
    texts = signed.groupBy("exact").agg(least, F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    texts = written(texts.select("exact", "first", "first.doc_id", "keys", "sig", F.monotonically_increasing_id().alias("node")), "exact")
    roots = labelled(docs, texts, idf, similarity)
    of_text = texts.select("exact", "first", "node").join(roots, "node", "left")
    of_text = written(of_text.select("exact", "first", F.coalesce("component", "node").alias("component")), "classes")
    for t in (texts, roots):
        dropped(t)
    return signed.select("row", "doc_id", "exact"), of_text.select("exact", "component"), of_text.groupBy("component").agg(F.min("first").alias("first"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per document: doc_id, class_id (the smallest id of its class), kept (one row of each class: of the smallest id, then digest).

    Documents with equal texts are in one class, as are those that a chain of near-duplicate pairs connects. A text
    without words is alike only to its equals; a null text to none but one of its own id, and its document is alone.
    Every row counts by its text: rows that repeat an id with different texts are different documents, and rows with a
    null id link, have the class of their text, null if no row of it has an id, and are kept where no other row is.
    No rows give none; other columns are ignored.
    """
    rows, texts, firsts = _classed(docs, similarity)
    facts = texts.join(firsts, "component").select("exact", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("kept_row"))
    return rows.join(facts, "exact").select("doc_id", "class_id", (F.col("row") == F.col("kept_row")).alias("kept"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that classes() keeps, with their own columns; of rows that repeat an id and text, one."""
    kept = _classed(docs, similarity)[2].select(_key(F.col("first.doc_id"), F.col("first.exact")).alias("__key"))
    own = docs.withColumn("__key", _key("doc_id", F.coalesce(_digest(), F.concat(F.lit("none:"), F.col("doc_id").cast("string")))))
    some = own.join(kept, "__key", "left_semi").dropDuplicates(["__key"])
    # neither id nor text: alone
    return some.drop("__key").select(docs.columns).union(docs.where("doc_id IS NULL AND text IS NULL"))

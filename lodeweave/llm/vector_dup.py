"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Vectors are first parted by the signs of a few random projections, in several independent tables, so that only vectors
of one cell meet. In a cell the vectors are sorted by each of many other projections; a vector collides with those inside
a window around its own value; pairs whose number of collisions reaches a count, and whose summed squared differences are not
too large, are verified by their cosine in double precision. All of it is calibrated from the recall wanted for a pair at
the threshold: a projection's difference for such a pair is normal with a known deviation, so the count's chance of being
reached is a binomial tail, the sum is chi-squared, and the number of tables follows from the chance that no sign differs.
Equal vectors are one vector with a multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.llm._common import components, dropped, written

SIMILARITY = 0.9
PROJECTIONS = 32
#: A window reaches so many deviations of the difference of a pair at the threshold.
WINDOW = 1.5
#: Chances of losing a pair at the threshold in all tables, and in the count; deviations that its sum of squares may lie too high.
LOSE_TABLES, LOSE_COUNT, FAR = 2e-3, 5e-4, 4.0
#: So many vectors to twice as many share a cell on average, enough for the fixed cost of a projection not to outweigh
#: theirs; a cell with more than BLOCK is counted in pairs of blocks.
CELL, BLOCK = 64, 1024
SEED = 31
_SCALE = 120.0  # projections of unit vectors by Gaussian directions of length about 1 are held as int8 steps


def _directions(kind: int, n: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, kind, dim]).normal(0, 1 / math.sqrt(dim), (dim, n))


def plan(n: int, similarity: float = SIMILARITY) -> tuple[int, int, int]:
    """Signs per cell, tables, and the count to reach, for n vectors."""
    agree = 1 - math.acos(similarity) / math.pi
    signs = max(1, math.floor(math.log2(max(2, n / CELL))))
    tables = math.ceil(math.log(LOSE_TABLES) / math.log1p(-(agree**signs)))
    p = math.erf(WINDOW / math.sqrt(2))
    tail, count = 1.0, 0
    while True:  # the largest count that a pair at the threshold reaches but for LOSE_COUNT
        tail -= math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if tail < 1 - LOSE_COUNT:
            return signs, tables, count
        count += 1


def usable(v: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def units(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length 1 in double precision; by the largest component first, so that no square overflows or vanishes."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(vectors: DataFrame, signs: int, tables: int) -> DataFrame:
    """Rows (node, cell, at): a vector's cell in each table and its projections in steps. Only these small rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column(1)
                dims = lists.value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    take = np.flatnonzero(dims == dim)
                    chosen = part.take(pa.array(take))
                    x = units(chosen.column(1), dim)
                    bits = (x @ _directions(0, signs * tables, dim) > 0).reshape(len(take), tables, signs)
                    code = (bits.astype(np.int64) << np.arange(signs)).sum(2)
                    code = (code * tables + np.arange(tables)) * 65_536 + dim
                    steps = np.clip(np.rint(x @ _directions(1, PROJECTIONS, dim) * _SCALE), -127, 127).astype(np.int8)
                    held = pa.array([s.tobytes() for s in steps], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([chosen.column(0), pa.array(code[:, t]), held], ["node", "cell", "at"])

    return vectors.select("node", "embedding").mapInArrow(run, "node long, cell long, at binary")


def colliding(v: np.ndarray, w: np.ndarray, window: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of v, j of w) whose projections lie inside each other's windows at least `count` times.

    v, w: one row of projections a vector. Each projection of w is sorted; the window around each v is a run of it.
    """
    out_i, out_j = [], []
    places = v.shape[1]
    order = np.argsort(w, axis=0, kind="stable").T.ravel()
    # the lines of all projections one after the other, so one search does for all
    apart = np.arange(places) * 100_000
    lines = (np.sort(w, axis=0).astype(np.int64) + apart).T.ravel()
    for at in range(0, len(v), 256):
        some = v[at : at + 256].astype(np.int64) + apart
        low = np.searchsorted(lines, (some - window).ravel(), "left")
        n = np.searchsorted(lines, (some + window).ravel(), "right") - low
        found = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pair = np.repeat(np.repeat(np.arange(len(some)) * len(w), places), n) + found
        hit = np.flatnonzero(np.bincount(pair, minlength=len(some) * len(w)) >= count)  # a pair meets once a projection
        out_i.append(hit // len(w) + at)
        out_j.append(hit % len(w))
    return np.concatenate(out_i), np.concatenate(out_j)


def candidates(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs (a, b), a < b, of distinct vectors (node, embedding) that collide often enough and closely enough."""
    signs, tables, count = plan(vectors.count(), similarity)
    dealt = cells(vectors, signs, tables)
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(sizes, "cell").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "at")
    far = 2 - 2 * similarity

    def of_group(group: tuple, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        cell, lo, hi = group
        variance = far / (cell % 65_536) * _SCALE**2
        # one step more for rounding
        window = WINDOW * math.sqrt(variance) + 1
        most = (PROJECTIONS + FAR * math.sqrt(2 * PROJECTIONS)) * (variance + 0.25)
        at = np.frombuffer(b"".join(x for r in rows for x in r.column(5).to_pylist()), np.int8).reshape(-1, PROJECTIONS).astype(np.int16)
        block, node = (np.concatenate([r.column(k).to_numpy() for r in rows]) for k in (3, 4))
        one, other = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        i, j = colliding(at[one], at[other], window, count) if len(one) and len(other) else (np.zeros(0, int), np.zeros(0, int))
        near = ((at[one[i]] - at[other[j]]).astype(np.int32) ** 2).sum(1) <= most
        a, b = node[one[i[near]]], node[other[j[near]]]
        if lo == hi:
            a, b = a[a < b], b[a < b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(3)]
            cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if x == y:
                    continue
                now = tuple(int(k[x]) for k in keys)
                if now != group and held:
                    yield of_group(group, held)
                    held.clear()
                group = now
                held.append(batch.slice(x, y - x))
        if held:
            yield of_group(group, held)

    ordered = dealt.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def alike(pairs: DataFrame, vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of pairs (a, b), those whose vectors (node, embedding) have the cosine, in double precision. Vectors of other lengths have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                dims = [part.column(k).value_lengths().to_numpy(zero_copy_only=False) for k in (2, 3)]
                for dim in np.unique(dims[0]):
                    own = part.take(pa.array(np.flatnonzero((dims[0] == dim) & (dims[1] == dim))))
                    good = np.einsum("ij,ij->i", units(own.column(2), dim), units(own.column(3), dim)) >= similarity if own.num_rows else np.zeros(0, bool)
                    yield pa.RecordBatch.from_arrays([own.column(k).filter(pa.array(good)) for k in (0, 1)], ["a", "b"])

    with_a = pairs.join(vectors.select(F.col("node").alias("a"), F.col("embedding").alias("x")), "a")
    both = with_a.join(vectors.select(F.col("node").alias("b"), F.col("embedding").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def link_classes(embeddings: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold a null or non-finite component link with nothing. Rows with equal vectors link
    with each other; each row counts as a vector, whatever its id: null and repeated ids lose no link. Vectors of other
    lengths do not link. A component whose vectors all lack an id has none. An id that is a string stays one. Other columns
    are ignored; no rows give none. Pairs below the similarity never link; one at it is lost with a chance of about
    LOSE_TABLES + LOSE_COUNT + 1e-3, one nearer with less.
    """
    good = embeddings.select("vec_id", "embedding").where(usable(F.col("embedding")))
    distinct = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    linked = written(alike(candidates(distinct.select("node", "embedding"), similarity), distinct, similarity), "links")
    ends = linked.union(linked.select("b", "a"))
    per_node = ends.join(distinct.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "node")
    roots = components(linked)
    firsts = roots.join(distinct.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    of_node = roots.join(firsts, "component").select("node", "component", "first")
    facts = distinct.join(per_node, "node", "left").join(of_node, "node", "left")
    first = F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("first"))
    facts = facts.select(F.col("embedding").alias("vector"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), first.alias("c"))
    facts = written(facts, "facts")
    for t in (distinct, linked):
        dropped(t)
    # an unusable vector is alone
    out = embeddings.select("vec_id", "embedding").join(facts, F.col("embedding") == F.col("vector"), "left")
    own = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    shown = own if isinstance(embeddings.schema["vec_id"].dataType, T.StringType) else own.cast("long")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), shown.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))

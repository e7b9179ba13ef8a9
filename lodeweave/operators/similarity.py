"""Similarities of vectors and sets, and joins by them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and targets are compared in squares of this side: what a task holds doesn't grow with either.
_TILE = 512
#: Groups of items by which a set meets sets of one size; sets of more items meet by single items.
_GROUPS, _LARGE = 32, 24


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def tanimoto(a: Column, b: Column) -> Column:
    """Sum of the smaller counts by the sum of the larger; 0 if both are empty."""
    low = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    high = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(high > 0, low / high).otherwise(0.0)


def set_tanimoto(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def nearest(queries: DataFrame, targets: DataFrame, k: int, block_bytes: int = 32 << 20) -> DataFrame:
    """(query, target, similarity, place): the k targets with the largest cosine, by id on ties.

    queries: (query, vector), a set that the caller states; targets: (target, vector), ids as longs. Queries go through in
    blocks of `block_bytes`, one at a time in the closure of a pass over the targets, which are never moved: a task keeps
    its best k of each query, and those meet by query. Vectors that are null, zero or not finite find nothing.
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    at_once = max(1, block_bytes // (8 * max(1, size["d"] or 1)))
    blocks = max(1, -(-size["n"] // at_once))
    best = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", F.col("vector").cast("array<double>").alias("vector")).toLocalIterator()
        held = [(r["query"], r["vector"]) for r in rows if r["vector"]]
        if held:
            found = _best_of_block(targets, np.array([q for q, _ in held]), np.array([v for _, v in held], float), k)
            best = found if best is None else best.unionByName(found)
    if best is None:
        best = queries.sparkSession.createDataFrame([], "query long, target long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "target")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def alike_counts(queries: DataFrame, targets: DataFrame, least: float, block_bytes: int = 32 << 20) -> DataFrame:
    """(query, target, similarity) of count vectors whose Tanimoto similarity is `least` or more; ids differ.

    queries: (query, vector), a set that the caller states; targets: (target, vector). As in `nearest`, queries go through
    in blocks and targets are never moved. Null vectors find nothing; two without counts have similarity 0.
    """
    from lodeweave.operators.kernels import similarities

    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = max(1, -(-size["n"] * 8 * max(1, size["d"] or 1) // block_bytes))
    whole = targets.where("vector IS NOT NULL AND size(vector) > 0").select(F.col("target").cast("long").alias("target"), F.col("vector").cast("array<double>").alias("vector"))
    found = queries.sparkSession.createDataFrame([], "query long, target long, similarity double")
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", F.col("vector").cast("array<double>").alias("vector")).toLocalIterator()
        held = [(r["query"], r["vector"]) for r in rows if r["vector"]]
        if not held:
            continue
        names, z = np.array([q for q, _ in held]), np.array([v for _, v in held], float)

        def run(batches: Iterator[pa.RecordBatch], names=names, z=z) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, low in itertools.product(range(0, batch.num_rows, _TILE), range(0, len(names), _TILE)):
                    part, some = batch.slice(at, _TILE), names[low : low + _TILE]
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    s = similarities(x, z[low : low + _TILE])
                    i, j = np.nonzero((s >= least) & (ids[:, None] != some[None, :]))
                    yield pa.RecordBatch.from_pydict({"query": pa.array(some[j], pa.int64()), "target": pa.array(ids[i], pa.int64()), "similarity": pa.array(s[i, j], pa.float64())})

        found = found.unionByName(whole.mapInArrow(run, "query long, target long, similarity double"))
    return found


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; NaN for rows without a direction."""
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=(norm > 0) & np.isfinite(norm))


def _better(similarity: np.ndarray, target: np.ndarray, s: np.ndarray, names: np.ndarray, ids: np.ndarray) -> None:
    """Puts the pairs of a tile (names by ids) into the best so far, in place: rows fall by similarity, then rise by target."""
    with np.errstate(invalid="ignore"):
        s = np.round(s, 9)
    s[~np.isfinite(s) | (names[:, None] == ids[None, :])] = -np.inf
    k = similarity.shape[1]
    # what is below a row's k-th best, so far or in the tile, cannot come in; equal ones may, by target
    least = similarity[:, -1]
    if s.shape[1] > k:
        least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    q, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    if not len(q):
        return
    rows = np.unique(q)
    held = np.repeat(rows, k)
    owner = np.concatenate([held, q])
    value, name = np.concatenate([similarity[rows].ravel(), s[q, c]]), np.concatenate([target[rows].ravel(), ids[c]])
    order = np.lexsort((name, -value, owner))
    owner, value, name = owner[order], value[order], name[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    kept = place < k
    similarity[owner[kept], place[kept]], target[owner[kept], place[kept]] = value[kept], name[kept]


def _best_of_block(targets: DataFrame, names: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    units = _units(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        similarity, target = np.full((len(names), k), -np.inf), np.zeros((len(names), k), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _TILE):
                part = batch.slice(at, _TILE)
                x = _units(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for low in range(0, len(names), _TILE):
                    own = slice(low, low + _TILE)
                    _better(similarity[own], target[own], units[own] @ x.T, names[own], ids)
        q, c = np.nonzero(np.isfinite(similarity))
        yield pa.RecordBatch.from_pydict({"query": pa.array(names[q], pa.int64()), "target": pa.array(target[q, c], pa.int64()), "similarity": pa.array(similarity[q, c], pa.float64())})

    whole = targets.where("vector IS NOT NULL AND size(vector) > 0").select(F.col("target").cast("long").alias("target"), F.col("vector").cast("array<double>").alias("vector"))
    return whole.mapInArrow(run, "query long, target long, similarity double")


def _combinations(n: int, m: int, least: float) -> list[list[int]]:
    """Of the items of a set of n, rare ones first: the groups of places of which a set of m that is alike enough shares one.

    Two such sets share `share` items, so the first l of these are among the first n - share + l of each. The more
    items a group has, the fewer sets share it by chance: l is as large as _GROUPS groups a set allow.
    """
    share = max(1, math.ceil(least / (1 + least) * (n + m) - 1e-9))
    if share > min(n, m):
        return []
    spare, l = max(n, m) - share, 1
    while l < share and math.comb(spare + l + 1, l + 1) <= _GROUPS:
        l += 1
    return [list(c) for c in itertools.combinations(range(n - share + l), l)]


def set_join(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of sets (id, items) whose Tanimoto similarity is `least` or more, by prefix filtering.

    Equal sets are joined once. Items are ordered from rare to frequent; for each pair of sizes that can be alike enough,
    sets meet by groups of items among the first (`_combinations`), up to all that they must share: for sets of few items
    only pairs that are alike enough meet. Larger sets (above _LARGE) meet by single items. A pair counts where the group
    is its first shared one, so it comes once.
    """
    whole = sets.select("id", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items")).where((F.size("items") > 0) & F.col("id").isNotNull())
    # a set goes by the least id that has it; the hash tells sets apart that share a repeated id
    distinct = whole.groupBy("items").agg(F.min("id").alias("least_id")).select("items", F.struct("least_id", F.xxhash64("items").alias("h")).alias("set"))
    members = whole.join(distinct, "items").select("id", "set")
    items = distinct.select("set", F.explode("items").alias("item"))
    ranked = items.join(items.groupBy("item").agg(F.count("*").alias("df")), "item")
    o = ranked.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("o")).select("set", F.col("o.item").alias("o")).withColumn("n", F.size("o"))
    sizes = sorted(r["n"] for r in distinct.select(F.size("items").alias("n")).where(f"n <= {_LARGE}").distinct().collect())
    plan = [(n, n, m, c) for n in sizes for m in sizes if m >= n for c in _combinations(n, m, least)]
    plan += [(m, n, m, c) for n in sizes for m in sizes if m > n for c in _combinations(m, n, least)]
    table = F.broadcast(sets.sparkSession.createDataFrame(plan, "n int, low int, high int, at array<int>"))
    small = o.join(table, "n").select("set", "o", "n", "low", "high", F.transform("at", lambda i: F.element_at("o", i + 1)).alias("group"))
    first = F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)
    large = o.where(F.col("n") > _LARGE * least - 1).select("set", "o", "n", F.lit(0).alias("low"), F.lit(0).alias("high"), F.explode(first).alias("x")).select("set", "o", "n", "low", "high", F.array("x").alias("group"))
    keyed = small.unionByName(large).withColumn("key", F.xxhash64("low", "high", "group"))
    x = keyed.select("key", "low", "high", "group", F.col("set").alias("set_x"), F.col("o").alias("x"), F.col("n").alias("nx"))
    y = keyed.select("key", F.col("low").alias("low_y"), F.col("high").alias("high_y"), F.col("group").alias("group_y"), F.col("set").alias("set_y"), F.col("o").alias("y"), F.col("n").alias("ny"))
    met = x.join(y, "key").where("low = low_y AND high = high_y AND group = group_y AND set_x < set_y")
    met = met.where(((F.col("high") > 0) & (F.least("nx", "ny") == F.col("low")) & (F.greatest("nx", "ny") == F.col("high"))) | ((F.col("high") == 0) & (F.greatest("nx", "ny") > _LARGE)))
    met = met.withColumn("both", F.array_intersect("x", "y")).where(F.slice("both", F.lit(1), F.size("group")) == F.col("group"))
    n = F.size("both")
    alike = met.select("set_x", "set_y", (n / (F.col("nx") + F.col("ny") - n)).alias("similarity")).where(F.col("similarity") >= least)
    a, b = members.select(F.col("set").alias("set_x"), F.col("id").alias("a")), members.select(F.col("set").alias("set_y"), F.col("id").alias("b"))
    other = alike.join(a, "set_x").join(b, "set_y").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    equal = a.join(b, F.col("set_x") == F.col("set_y")).where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return other.unionByName(equal)

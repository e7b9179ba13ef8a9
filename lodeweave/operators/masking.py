"""Masks for masked-token training: single positions, spans, spans that begin at chosen tokens; corruption; frozen sets.

All draws are hashes of seed, row and place (`hashing.draw`), so a mask depends on its row alone: rows never meet, but
for the rule that a batch without a mask gets one. Masks are arrays of booleans beside the ids; all of it are native
expressions over arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.hashing import draw
from lodeweave.operators.tokens import SPECIALS, padded_batches

#: Tokens that are never masked, and the pattern of tokens at which spans begin with another weight.
NEVER = tuple(SPECIALS[t] for t in ("<s>", "<pad>", "</s>", "<mask>"))
HETERO = r"\[[=#/\\@+\-]*[0-9]*(?:Cl|Br|Se|Si|[NOSPFI])(?:[^\]a-z][^\]]*)?\]"
IGNORED = -100


def _may(x: Column, never: Iterable[int]) -> Column:
    return ~x.isin(*never)


def _places(ids: str, never: Iterable[int], what) -> Column:
    """what(id, place) of the places that may be masked."""
    found = F.transform(ids, lambda x, i: F.when(_may(x, never), what(x, i)))
    return F.filter(found, lambda x: x.isNotNull())


def standard(df: DataFrame, p: float, seed: int, row: str = "row_id", ids: str = "ids", batch: str = "batch", never: Iterable[int] = NEVER) -> DataFrame:
    """df with `masked`: each place that may be masked is, with probability p; if p > 0, a batch has one at least.

    A batch without a draw gets its place with the smallest draw of a second kind, which is any of its places with the
    same chance. Only rows without a mask of their own are shuffled, to meet that place. Rows are told apart by `row`
    inside a batch; rows without ids, or only ids that are never masked, stay unmasked; a null array gives a null mask.
    """
    if not 0 <= p <= 1:
        raise ValueError("p must be a probability")
    own = df.withColumn("masked", F.transform(ids, lambda x, i: _may(x, never) & (draw(seed, "mask", row, i) < p)))
    if p == 0:
        return own
    any_ = F.coalesce(F.exists("masked", lambda m: m), F.lit(False))
    first = F.array_min(_places(ids, never, lambda x, i: F.struct(draw(seed, "force", row, i).alias("u"), F.col(row).alias("row"), i.alias("at"))))
    seen = own.select(F.col(batch).alias("__batch"), any_.alias("any"), F.when(~any_, first).alias("first"))
    forced = seen.groupBy("__batch").agg(F.max("any").alias("any"), F.min("first").alias("first")).where("NOT any AND first IS NOT NULL")
    forced = forced.select("__batch", F.col("first.row").alias("__row"), F.col("first.at").alias("__at"))
    rest = own.where(~any_).join(forced, F.col(batch).eqNullSafe(F.col("__batch")) & F.col(row).eqNullSafe(F.col("__row")), "left")
    rest = rest.withColumn("masked", F.transform("masked", lambda m, i: m | F.coalesce(i == F.col("__at"), F.lit(False)))).drop("__batch", "__row", "__at")
    return own.where(any_).unionByName(rest)


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once: the optimizer would put a column's expression into each use in a lambda."""
    return F.transform(F.array(value), f)[0]


def _inside(spans: Column, at: Column) -> Column:
    return F.exists(spans, lambda e: (e["begin"] <= at) & (at < e["end"]))


def spans(df: DataFrame, p: float, p_geometric: float, longest: int, seed: int, row: str = "row_id", ids: str = "ids", weight=None, never: Iterable[int] = NEVER) -> DataFrame:
    """df with `masked`: runs of tokens, until max(1, round(n p)) of the n places that may be masked are (halves to even).

    A span begins at a place not yet masked, drawn by weight(id) (1 each if there is none; above 0), and has 1 + k
    tokens, k geometric with `p_geometric`, `longest` at most; it ends before a token that is never masked. The last
    span may go beyond the budget. A row with a place has a mask.

    Weighted draws without replacement are a sort: places in the order of -ln(u) / weight come as if each were drawn
    among those left, also where a span has taken some out. So one sort and one fold over it do, and each draw adds a
    token at least, so there are never more draws than the budget. The fold looks at the spans so far for each place
    taken: its cost grows with the square of a row's budget, rows being model inputs of bounded length.
    """
    if not (0 < p_geometric < 1 and longest >= 1 and 0 <= p <= 1):
        raise ValueError("p_geometric must lie in (0, 1), longest be 1 or more and p be a probability")
    weigh = weight or (lambda x: F.lit(1.0))
    order = F.array_sort(_places(ids, never, lambda x, i: F.struct((-F.ln(draw(seed, "start", row, i)) / weigh(x)).alias("key"), i.alias("at"))))
    bad = F.filter(F.transform(ids, lambda x, i: F.when(~_may(x, never), i)), lambda x: x.isNotNull())
    given = F.struct(order.alias("order"), bad.alias("bad"), F.size(ids).alias("n"))

    def length(at: Column) -> Column:  # P(more than t tokens) = (1 - p_geometric)^t
        u = draw(seed, "length", row, at)
        return F.lit(1) + sum(((u < (1 - p_geometric) ** t).cast("int") for t in range(1, longest)), F.lit(0))

    def taken(g: Column) -> Column:
        budget = F.greatest(F.lit(1), F.bround(F.size(g["order"]) * F.lit(p), 0).cast("int"))

        def step(s: Column, o: Column) -> Column:
            end = F.least(o["at"] + length(o["at"]), g["n"], F.coalesce(F.array_min(F.filter(g["bad"], lambda b: b > o["at"])), g["n"]))
            span = F.struct(o["at"].alias("begin"), end.alias("end"))
            new = _let(span, lambda e: F.struct(F.concat(s["spans"], F.array(e)).alias("spans"), (s["count"] + F.size(F.filter(F.sequence(e["begin"], e["end"] - 1), lambda i: ~_inside(s["spans"], i)))).alias("count"), s["budget"].alias("budget")))
            return F.when((s["count"] < s["budget"]) & ~_inside(s["spans"], o["at"]), new).otherwise(s)

        start = F.struct(F.array().cast("array<struct<begin:int,end:int>>").alias("spans"), F.lit(0).alias("count"), budget.alias("budget"))
        return F.aggregate(g["order"], start, step, lambda s: s["spans"])

    masked = _let(_let(given, taken), lambda spans: F.transform(ids, lambda x, i: _inside(spans, i)))
    return df.withColumn("masked", F.when(F.col(ids).isNotNull(), masked))


def start_weights(vocab: dict[str, int], weight: float, pattern: str = HETERO):
    """weight(id) for `spans`: `weight` for ids whose token holds the pattern, 1 for others.

    The ids are a literal of the plan, no longer than the vocabulary.
    """
    if weight <= 0:
        raise ValueError("the weight must be above 0")
    if not vocab:
        raise ValueError("weights need a vocabulary")
    found = sorted(i for t, i in vocab.items() if i not in SPECIALS.values() and re.search(pattern, t))
    return lambda x: F.when(x.isin(*found), float(weight)).otherwise(1.0) if found else F.lit(1.0)


def corrupted(df: DataFrame, seed: int, vocab_size: int, row: str = "row_id", ids: str = "ids") -> DataFrame:
    """df with `inputs` and `labels`: a masked token becomes the mask (80 %), any token that isn't special (10 %) or stays.

    labels holds the token where it is masked and -100 elsewhere.
    """
    low = max(SPECIALS.values()) + 1
    if vocab_size <= low:
        raise ValueError("no token to replace others by")

    def become(x: Column, i: Column) -> Column:
        other = (F.floor(draw(seed, "other", row, i) * (vocab_size - low)) + low).cast("int")
        return F.when(draw(seed, "replace", row, i) < 0.8, SPECIALS["<mask>"]).when(draw(seed, "random", row, i) < 0.5, other).otherwise(x)

    both = F.arrays_zip(F.col(ids).alias("x"), F.col("masked").alias("m"))
    pairs = F.transform(both, lambda z, i: F.struct(F.when(z["m"], z["x"]).otherwise(IGNORED).alias("label"), F.when(z["m"], become(z["x"], i)).otherwise(z["x"]).alias("input")))
    out = df.withColumn("__pairs", pairs)
    return out.withColumn("labels", F.transform("__pairs", lambda z: z["label"])).withColumn("inputs", F.transform("__pairs", lambda z: z["input"])).drop("__pairs")


def frozen_facts(df: DataFrame, ids: str = "ids", row: str = "row_id", never: Iterable[int] = NEVER) -> DataFrame:
    """One row on a masked set: n_rows, n_eligible, n_masked, fraction, n_illegal, fingerprint.

    n_illegal counts places that break a rule: a masked token that never may be, a changed token without a label, a
    label that isn't the token. The fingerprint sums 48 bits of the SHA-256 of each row: the same whatever the order.
    """

    zipped = F.arrays_zip(F.col(ids).alias("x"), F.col("labels").alias("label"), F.col("inputs").alias("input"))

    def count(test) -> Column:
        return F.size(F.filter(zipped, lambda z: F.coalesce(test(z["x"], z["label"], z["input"]), F.lit(False)))).cast("long")

    illegal = count(lambda x, label, given: ((label != IGNORED) & (~_may(x, never) | (label != x))) | ((label == IGNORED) & (given != x)))

    def joined(c: str) -> Column:
        return F.array_join(F.col(c).cast("array<string>"), ",")

    digest = F.sha2(F.concat_ws("|", F.col(row).cast("string"), joined("inputs"), joined("labels")), 256)
    facts = df.select(count(lambda x, label, given: _may(x, never)).alias("e"), count(lambda x, label, given: label != IGNORED).alias("m"), illegal.alias("bad"), F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)").alias("f"))
    return facts.agg(F.count("*").alias("n_rows"), F.sum("e").alias("n_eligible"), F.sum("m").alias("n_masked"), (F.sum("m") / F.nullif(F.sum("e"), F.lit(0))).alias("fraction"), F.sum("bad").alias("n_illegal"), F.sum("f").alias("fingerprint"))


def attention(ids: Column) -> Column:
    """1 where a token is no padding, else 0."""
    return F.transform(ids, lambda x: (x != SPECIALS["<pad>"]).cast("int"))


def collated(df: DataFrame, strategy: str, p: float, seed: int, vocab: dict[str, int], row: str = "row_id", ids: str = "ids", batch: str = "batch", multiple: int = 1, p_geometric: float = 0.2, longest: int = 10, weight: float = 2.0) -> DataFrame:
    """What a masked model is trained on: df without empty rows, and inputs, labels and attention, padded to the longest of a batch.

    strategy is standard, span or hetero_span (spans that begin `weight` times as often at the tokens of `HETERO`); others
    are errors, as is a frame in which no row has ids.
    """
    if strategy not in ("standard", "span", "hetero_span"):
        raise ValueError(f"unknown strategy: {strategy}")
    full = df.where(F.coalesce(F.size(ids), F.lit(0)) > 0)
    if full.isEmpty():
        raise ValueError("no row has ids")
    rows = padded_batches(full, batch, ids, multiple=multiple)
    if strategy == "standard":
        rows = standard(rows, p, seed, row, ids, batch)
    else:
        rows = spans(rows, p, p_geometric, longest, seed, row, ids, start_weights(vocab, weight) if strategy == "hetero_span" else None)
    rows = corrupted(rows, seed, len(vocab), row, ids)
    return rows.withColumn("attention", attention(F.col(ids)))


def pooled(hidden: Column, ids: Column, never: Iterable[int] = tuple(SPECIALS.values())) -> Column:
    """The mean of the vectors (array of arrays) of tokens that aren't special; if all are, of those that are no padding; null if there is none."""

    def mean(keep) -> Column:
        held = F.filter(F.arrays_zip(hidden.alias("h"), ids.alias("x")), lambda z: keep(z["x"]))
        total = F.aggregate(F.slice(held, 2, F.greatest(F.size(held) - 1, F.lit(0))), held[0]["h"], lambda a, z: F.zip_with(a, z["h"], lambda x, y: x + y))
        return F.when(F.size(held) > 0, F.transform(total, lambda x: x / F.size(held)))

    return F.coalesce(mean(lambda x: ~x.isin(*never)), mean(lambda x: x != SPECIALS["<pad>"]))

"""Mixing sources to target weights, with DataFrame functions only.

Tokens (here: words) of each source are packed into fixed-length blocks. The mix is a row of output slots, cut into
output shards; each shard's slots are drawn from the sources as a multinomial, the k-th slot of a source takes block
perm(k), where perm is a pseudorandom permutation of that source's block indices, and blocks are joined by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm._common import dropped, written

#: What separates words: the space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix holds, and how often a source may be repeated at most.
TOTAL_SHARE, MOST_TIMES = 1.5, 2
BLOCK_WORDS = 256
SHARD_SLOTS = 65_536
#: A source's documents are dealt to so many buckets, so that offsets inside a hot source are summed in parallel.
BUCKETS = 1024


def _identity() -> Column:
    """128 bits of a row's id and text."""
    return F.struct(F.xxhash64("doc_id", "text").alias("one"), F.xxhash64(F.lit(1), "doc_id", "text").alias("two"))


def sized(docs: DataFrame) -> DataFrame:
    """Rows (row_id, doc_id, source, key, size) of a written table: size is the number of words, key tells texts apart."""
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col("doc_id"),
            F.col("source"),
            _identity().alias("key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sized",
    )


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, times: float = MOST_TIMES) -> DataFrame:
    """One row per source: sid (from 0, by code point, null last), source, source_size, target.

    The water level is the largest of the levels that come out if the i sources that fill first are full, for each i:
    assuming a source full that is not can only lower the level.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_source = by_source.withColumn("sid", (F.row_number().over(order) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)
    by_source = by_source.withColumn("weight", weight)
    everything = Window.partitionBy()
    filling = Window.orderBy((F.col("source_size") / F.col("weight")), "sid")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum(times * F.col("source_size")).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = by_source.withColumn("level", level)
    target = F.least(times * F.col("source_size"), F.col("weight") * F.max("level").over(everything))
    return levels.select("sid", "source", "source_size", target.cast("double").alias("target"))


def feistel_side(n: Column) -> Column:
    """The least power of two whose square is n or more."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(4)).cast("double")) / 2)).cast("long")


def permuted(i: Column, n: Column, side: Column, *keys: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 at i: four Feistel rounds on pairs below `side` = feistel_side(n), walked until below n."""

    def once(x: Column) -> Column:
        pair = F.struct(F.floor(x / side).cast("long").alias("l"), (x % side).alias("r"))
        for turn in range(4):
            pair = F.transform(
                F.array(pair),
                lambda p, turn=turn: F.struct(p["r"].alias("l"), ((p["l"] + F.pmod(F.xxhash64(p["r"], F.lit(turn), *keys), side)) % side).alias("r")),
            )[0]
        return F.transform(F.array(pair), lambda p: p["l"] * side + p["r"])[0]

    # outside 0 .. n - 1 with a chance under 3/4 a step: 256 steps leave 1e-32; a raised error would tell
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(256)), once(i), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.transform(F.array(walked), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("permutation walk did not end")).cast("long")))[0]


def slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """The output slots, as a written table: rows (shard, slot, sid, block, words), words the length taken from the block's start.

    A source gets ceil(target / block_words) slots, of which the last takes only what the target still lacks. Every
    slot draws its source in proportion to these numbers (a multinomial count per shard); draws that a source gets over
    its number go, in order, to the sources that got too few, so the totals hold. The table of sources is the mix's
    configuration: its few rows become a literal. Each step is written, since the driver plans anew after each exchange,
    all that is one plan.
    """
    spark = targets.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    full_passes = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")
    rest = F.when(F.col("source_size") > 0, F.round("target") - full_passes * F.col("source_size")).otherwise(0).cast("long")
    rest = F.greatest(rest, F.lit(0).cast("long"))
    plan = targets.select(
        "sid",
        blocks.alias("blocks"),
        (full_passes * blocks).alias("whole"),
        rest.alias("rest"),
        (full_passes * blocks + F.ceil(rest / block_words)).cast("long").alias("quota"),
    ).where("quota > 0")
    plan = written(plan.withColumn("upto", F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))), "sources")
    rows = plan.orderBy("sid").collect()
    total = rows[-1]["upto"] if rows else 0
    bounds = F.array(*[F.struct(F.lit(r["upto"]).cast("long").alias("upto"), F.lit(r["sid"]).cast("int").alias("sid")) for r in rows]) if rows else None
    if not total:
        return spark.createDataFrame([], "shard long, slot long, sid int, block long, words long")
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total))
    drawn = spark.range(total).select(
        F.col("id").alias("slot"),
        F.floor(F.col("id") / shard_slots).cast("long").alias("shard"),
        F.element_at(F.filter(bounds, lambda b: b["upto"] > draw), 1)["sid"].alias("sid"),
    )
    counts = drawn.groupBy("sid", "shard").count()
    running = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "shard", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("before"))
    in_shard = Window.partitionBy("sid", "shard").orderBy("slot")
    ranked = (
        drawn.withColumn("nth", F.row_number().over(in_shard) - 1)
        .join(counts, ["sid", "shard"])
        .select("shard", "slot", "sid", (F.col("before") + F.col("nth")).alias("k"))
        .join(F.broadcast(plan.select("sid", "quota")), "sid")
    )
    ranked = written(ranked, "drawn")
    kept = ranked.where("k < quota").select("shard", "slot", "sid", "k")
    got = ranked.groupBy("sid").agg(F.count("*").alias("got"))
    balance = plan.join(got, "sid", "left").na.fill(0, ["got"])
    by_sid = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    over = balance.where("got > quota").select("sid", "quota", F.coalesce(F.sum(F.col("got") - F.col("quota")).over(by_sid), F.lit(0)).alias("first"))
    spare = ranked.where("k >= quota").join(F.broadcast(over.select("sid", "first")), "sid")
    spare = spare.select("shard", "slot", (F.col("first") + F.col("k") - F.col("quota")).alias("e"))
    short = balance.where("got < quota").select("sid", "got", F.coalesce(F.sum(F.col("quota") - F.col("got")).over(by_sid), F.lit(0)).alias("first"), (F.col("quota") - F.col("got")).alias("lack"))
    lacking = short.select("sid", "got", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)).alias("j"))
    lacking = lacking.select("sid", (F.col("got") + F.col("j")).alias("k"), (F.col("first") + F.col("j")).alias("e"))
    every = kept.union(spare.join(lacking, "e").select("shard", "slot", "sid", "k")).join(F.broadcast(plan.withColumn("side", feistel_side(F.col("blocks")))), "sid")
    index = F.col("k") % F.col("blocks")
    words = F.when(F.col("k") < F.col("whole"), F.lit(block_words)).otherwise(F.least(F.lit(block_words), F.col("rest") - (F.col("k") - F.col("whole")) * block_words))
    every = every.select("shard", "slot", "sid", permuted(index, F.col("blocks"), F.col("side"), F.col("sid"), F.lit(seed)).alias("block"), words.cast("long").alias("words"))
    out = written(every, "slots")
    for t in (ranked, plan):
        dropped(t)
    return out


def pieces(sizes: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """The documents' parts in the blocks: rows (sid, block, row_id, ..., lo, hi), word positions in the document; block is null where size is 0.

    A document's place in its source is a sum over buckets plus a sum inside its bucket, so no task sees a whole source.
    """
    rows = sizes.join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    rows = rows.withColumn("mixed", F.xxhash64("doc_id", F.lit(seed)))
    rows = rows.withColumn("bucket", F.pmod("mixed", F.lit(buckets)))
    inside = Window.partitionBy("sid", "bucket").orderBy("mixed", "doc_id", "size", "key", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    upto = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("first"))
    rows = rows.join(sums, ["sid", "bucket"]).withColumn("start", F.col("first") + F.col("offset"))
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    spread = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words), last))
    rows = rows.withColumn("block", F.explode_outer(spread))
    return rows.select(
        "sid", "block", "row_id", "doc_id", "key", "size", "source_size", "target",
        F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")).cast("long").alias("lo"),
        F.least("size", (F.col("block") + 1) * block_words - F.col("start")).cast("long").alias("hi"),
        (F.col("block") * block_words - F.col("start")).alias("block_at"),
    )


def taken_pieces(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """The pieces joined with the slots that take them, by source and block index: adds shard, slot and `end`, up to where the slot takes it."""
    sizes = sized(docs)
    targets = written(source_targets(sizes), "targets")
    parts = pieces(sizes, targets, block_words, seed=seed)
    takes = slots(targets, block_words, shard_slots, seed)
    joined = parts.join(takes, ["sid", "block"], "left")
    end = F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("block_at") + F.col("words")))
    return joined.withColumn("end", F.when(F.col("words").isNotNull(), end))


def mix_counts(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken.

    Null or blank texts have size 0 and are taken 0 times. A null source is a source of its own, the last. Repeated rows
    are documents of their own. Other columns are ignored. No documents give no rows. Each block is taken at most twice,
    so no document's words are; a source's taken words miss its target by less than one block.
    """
    took = F.coalesce(F.col("end") - F.col("lo"), F.lit(0))
    by_row = taken_pieces(docs, block_words, shard_slots, seed).groupBy("row_id", "doc_id", "size", "source_size", "target").agg(F.sum(took).alias("taken"))
    return by_row.drop("row_id")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """The mixed corpus with the columns of `docs`: the text of a document becomes the words that the mix takes of it, in order of slot passes.

    A document taken twice holds its text twice, one of which nothing is taken goes. Rows equal in doc_id and text are
    one document here, which gets what all of them were dealt. n_chars, if there, is counted anew.
    """
    part = F.struct(F.col("nth"), F.col("lo"), F.col("end"))
    nth = F.row_number().over(Window.partitionBy("row_id", "block").orderBy("slot"))
    takes = taken_pieces(docs, block_words, shard_slots, seed).where("end > lo").withColumn("nth", nth)
    takes = written(takes.groupBy("key").agg(F.sort_array(F.collect_list(part)).alias("parts")), "takes")
    keyed = docs.withColumn("__key", _identity()).dropDuplicates(["__key"])
    joined = keyed.join(takes.withColumnRenamed("key", "__key").withColumnRenamed("parts", "__parts"), "__key")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    text = F.transform(
        F.array(words),
        lambda w: F.array_join(F.transform("__parts", lambda p: F.rtrim(F.array_join(F.slice(w, (p["lo"] + 1).cast("int"), (p["end"] - p["lo"]).cast("int")), ""))), " "),
    )[0]
    out = joined.withColumn("text", text).drop("__key", "__parts")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

"""Shards by jump consistent hashing (Lamping and Veach, 2014): a key walks to its shard, without a table of a ring.

A key seeds a generator; each draw gives the next shard count at which the key would move, and the walk ends at the last
such count up to the number of shards. So a key's shard depends on the key and the number of shards alone, and one more
shard only takes rows into itself: the share 1 / (shards + 1) of them.

Slots number the rows of a shard without gaps in the order of a hash of the row. The hash also parts each shard into
`PARTS` ranges of equal share, so sums over the ranges place a range's first row and no task ever sees a whole shard.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm._common import written

#: Multiplier of the published generator, modulo 2^64, whose upper 31 bits make a draw.
MULTIPLIER = Decimal(2862933555777941757)
MODULUS = Decimal(2**64)
LOW_BITS = Decimal(2**33)
#: Ranges of a shard; each gives one row of sums, so sums don't grow with the rows.
PARTS = 4096
#: Steps of a walk taken before it is looked at again; a walk has ln(shards) of them on average, `shards` at most.
STEPS = 8
#: Rows that equal one another in id and text get their slots in runs of so many, so a hot row is spread over tasks.
RUN = 100_000


def number(text: Column) -> Column:
    """60 bits of the MD5 of a text as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def key_of(doc_id: Column) -> Column:
    """The stable key of an id of any type: a hash of its text; that of '' for a null id."""
    return number(F.coalesce(doc_id.cast("string"), F.lit("")))


def _drawn(key: Column) -> Column:
    return ((key * F.lit(MULTIPLIER) + F.lit(Decimal(1))) % F.lit(MODULUS)).cast("decimal(20,0)")


def walk(key: Column, shards: int) -> Column:
    """struct(shard, next): the shard of a key (long, not negative) among `shards`, and the first count, `shards` or more, at which it moves."""
    if shards < 1:
        raise ValueError("there must be a shard")

    def step(s: Column, _: Column) -> Column:
        share = F.lit(2.0**31) / (F.call_function("div", s["key"], F.lit(LOW_BITS)) + 1).cast("double")
        to = ((s["next"] + 1).cast("double") * share).cast("long")
        return F.when(s["next"] < shards, F.struct(_drawn(s["key"]).alias("key"), s["next"].alias("shard"), to.alias("next"))).otherwise(s)

    def steps(s: Column, _: Column) -> Column:
        return F.when(s["next"] < shards, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), s, step)).otherwise(s)

    start = F.struct(_drawn(key.cast("decimal(20,0)")).alias("key"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(-(-shards // STEPS))), start, steps, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["next"].alias("next")))


def with_shard(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """docs with the column shard (int, from 0). A column of that name, in any case, is replaced. Nothing is shuffled.

    Rows of one key share a shard, those with a null key too.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]
    return docs.select(*rest, walk(key_of(F.col(f"`{key}`")), shards)["shard"].alias("shard"))


def write_shards(docs: DataFrame, path: str, shards: int, files: int = 1, key: str = "doc_id") -> None:
    """Writes docs as Parquet, a folder `shard=N` for each shard in use, of up to `files` files.

    Rows are dealt to files by a hash of the text, so a key that holds most rows still fills all files of its shard.
    """
    if files < 1:
        raise ValueError("a shard needs a file")
    out = with_shard(docs, shards, key)
    file = F.pmod(F.xxhash64("text"), F.lit(files)).alias("__file")
    out.select("*", file).repartition("shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard (its shard among shards + 1).

    size is the text's UTF-8 bytes and 16 more; a null text counts as an empty one. Slots of a shard go from 0 without
    gaps, in the order of a hash of id and text, so they depend neither on partitions nor on the order of rows. Rows
    with the same id, null included, share a shard; rows that are equal altogether get neighbouring slots. Columns
    other than doc_id and text are ignored. No rows give none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    place = number(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size"))
    at = walk(key_of(F.col("doc_id")), shards)
    rows = rows.withColumn("place", place).withColumn("at", at)
    rows = rows.select("doc_id", "size", "text_crc32", "n", "place", F.col("at.shard").alias("shard"), F.when(F.col("at.next") == shards, shards).otherwise(F.col("at.shard")).cast("int").alias("grown_shard"), F.floor(F.col("place") / (2**60 // PARTS)).cast("int").alias("part"))
    rows = written(rows, "placed")

    sums = rows.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("shard", "part", F.coalesce(F.sum("n").over(earlier.partitionBy("shard").orderBy("part")), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(earlier.partitionBy("shard", "part").orderBy("place", "doc_id", "text_crc32", "size")), F.lit(0))
    first = rows.withColumn("inside", inside).join(before, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("inside"))

    runs = first.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("run"))
    hot = F.col("n") > RUN
    runs = runs.where(~hot).union(runs.where(hot).repartition("doc_id", "text_crc32", "run"))
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
    each = runs.withColumn("step", F.explode(F.sequence(F.col("run") * RUN, last)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("step")).alias("slot"), "grown_shard")

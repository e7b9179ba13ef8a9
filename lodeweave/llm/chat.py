"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A logged conversation that another one continues is a snapshot of it and goes. Each turn gets a rolling hash of all turns
up to it; a conversation is a snapshot if its last rolling hash is one of the earlier rolling hashes of another. The rolling
hash is a sum over turns of hashes of (position, role, text), two of 64 bits with different seeds, so that it is a running
sum that a window streams, whatever a conversation's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands around a turn in the rendered text.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def _rolling(seed: int, window) -> Column:
    # exact sums in decimals: 64-bit terms cannot overflow 38 digits
    return F.sum(F.xxhash64("position", "role", "text", F.lit(seed)).cast("decimal(20,0)")).over(window)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, position, h1, h2, n_turns): the rolling hashes of each turn.

    Rows that repeat a row wholly count once. Turns are in order of turn (null first), then role, then text. Null role
    and text are empty. Rows with a null conv_id are one conversation.
    """
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    placed = clean.withColumn("position", F.row_number().over(in_order))
    hashed = placed.withColumn("h1", _rolling(17, so_far)).withColumn("h2", _rolling(91, so_far))
    return hashed.withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id")))


def maximal(hashed: DataFrame) -> DataFrame:
    """Rows (conv_id, n_copies): of equal conversations the one with the smallest id, unless a longer one starts with it.

    Both the ends and the prefixes are made distinct before they meet, so a beginning that many share is one row.
    """
    ends = hashed.where("position = n_turns").groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = hashed.where("position < n_turns").select("h1", "h2", F.col("position").alias("n_turns")).distinct()
    return ends.join(prefixes, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_copies", "n_turns")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """The maximal conversations, rendered: conv_id, n_turns, n_copies (equal ones, itself included), text.

    A null conv_id is an id like others. No turns give no rows; other columns are ignored.
    """
    hashed = prefix_hashes(turns)
    kept = maximal(hashed).withColumnRenamed("conv_id", "kept_id").withColumnRenamed("n_turns", "kept_turns")
    rendered = F.concat(F.lit(TURN_START), "role", F.lit("\n"), "text", F.lit(TURN_END), F.lit("\n"))
    # the window's rows are dealt by conv_id already: the join and the group-by below need no other exchange of them
    lines = hashed.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    by_conv = lines.groupBy("conv_id", "n_turns", "n_copies")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", rendered.alias("line")))), lambda x: x["line"]), "")
    return by_conv.agg(text.alias("text"))

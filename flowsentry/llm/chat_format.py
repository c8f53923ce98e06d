"""Chat formatting with cumulative-snapshot collapse (operator 7, native).

Chat logs often store each state of a conversation again: the rows of one
conversation id are then a prefix of a longer one.  A rolling hash over
the turns (128 bits: two position-salted sums of exclusive or) names every
turn prefix; conversations whose whole hash is a proper prefix of another
are removed by an anti-join, of equal conversations the smallest id stays,
and what remains is rendered.

Only DataFrame functions.  Prefix hashes are distinct before they are
joined, so a first turn that a third of all conversations share is one row;
texts are shuffled by conversation only, for the conversations that stay.

Defined cases: turns are ordered by (turn, role, text), nulls first, so
repeated turn numbers have a fixed order; an exactly repeated row is a turn
of its own.  Null roles and texts render as empty and differ from
empty ones in comparison.  Rows without a conversation id belong to no
conversation and give no result.  Columns other than the four named ones are
not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsentry.llm.common import Scratch


def _turn_hash(seed: int) -> Column:
    """A turn's hash at its place; nulls differ from empty strings."""
    return F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.lit(seed),
                      F.col("text").isNull(), F.coalesce("text", F.lit("")))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, pos, h1, h2, last) for every turn: hash of turns 1..pos."""
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    whole = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (turns.withColumn("pos", F.row_number().over(order))
            .select("conv", "turn", "role", "text", "pos", _turn_hash(17).alias("t1"), _turn_hash(71).alias("t2"))
            .select("conv", "pos", F.bit_xor("t1").over(whole).alias("h1"), F.bit_xor("t2").over(whole).alias("h2"),
                    F.lead("pos").over(order).isNull().alias("last")))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n_turns) of the conversations that stay."""
    prefixes = Scratch(turns.sparkSession, "chat").table(prefix_hashes(turns), "prefixes")
    whole = (prefixes.where("last").groupBy("pos", "h1", "h2").agg(F.min("conv").alias("conv")))
    proper = prefixes.where("not last").select("pos", "h1", "h2").distinct()
    return whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv", F.col("pos").alias("n_turns"))


def render(turns: DataFrame, before: str, between: str, after: str) -> DataFrame:
    """(conv, text): turns in order, each as before + role + between + text + after."""
    one = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(between), F.coalesce("text", F.lit("")), F.lit(after))
    return (turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("t"), one.alias("s")))).alias("x"))
            .select("conv", F.array_join(F.col("x.s"), "").alias("text")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", before: str = "<|im_start|>", between: str = "\n",
                 after: str = "<|im_end|>\n") -> DataFrame:
    """One row per maximal conversation: conv id, n_turns, rendered text."""
    turns = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                         F.col(text_col).alias("text")).where("conv is not null")
    stay = maximal(turns)
    out = render(turns.join(stay.select("conv"), "conv", "left_semi"), before, between, after)
    return out.join(stay, "conv").select(F.col("conv").alias(conv_col), F.col("n_turns").cast("long").alias("n_turns"), "text")

"""Chat formatting: collapse logs of the same conversation into the longest one, then render it.

Chat systems log a conversation again after every turn. A conversation that is a prefix of a longer one is dropped
by digest: each turn gets a 128-bit digest of its place, role and text, and the XOR of the digests up to a turn is
the digest of that prefix. Since the place is part of a turn's digest, equal prefix digests mean equal turn
sequences. Only digests move; prefixes are combined per (length, digest) on the map side before they meet, so a first
turn shared by a third of all conversations is one row per task.

Everything is DataFrame functions. No conversation is gathered whole: the running XOR is computed inside pieces of
PIECE turns and then across pieces, and a conversation is rendered in parts of as many turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turns of one conversation that are handled, and rendered, together.
PIECE = 256


def render_turn(role: Column, text: Column) -> Column:
    """A turn in ChatML form."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def prefix_digests(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """turns (conv_id, turn, role, text) with pos (1, 2, ...), d1, d2 (digest of the turns up to it) and part (from 0).

    Turns go in the order of turn (null first), then role and text; pos counts them. Positions and digests come
    from two levels, inside pieces of turn numbers and across pieces, so a very long conversation is spread out. Where a
    piece of turn numbers holds many more rows, as turns without a number or under one number do, these rows are
    sorted over all tasks, equal ones in any order, and cut by their running number.
    """
    t = turns.withColumn("_slot", F.coalesce(F.floor(F.col("turn") / piece), F.lit(-(2**62))))
    large = written(t.groupBy("conv_id", "_slot").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 4 * piece).drop("_n"), "chat-large")
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    many = t.join(large, ["conv_id", "_slot"], "left_semi").withColumn("_tie", F.monotonically_increasing_id())
    many = many.repartitionByRange("conv_id", *order, "_tie").sortWithinPartitions("conv_id", *order, "_tie")
    many = written(many.withColumn("_tie", F.monotonically_increasing_id()), "chat-many")
    few = t.join(large, ["conv_id", "_slot"], "left_anti").withColumn("_tie", F.lit(0).cast("long"))
    t = few.unionByName(many).withColumn("_piece", F.struct("_slot", F.floor(F.col("_tie") / piece).alias("cut"))).drop("_slot")
    inner = Window.partitionBy("conv_id", "_piece").orderBy(*order, "_tie")
    t = t.withColumn("_k", F.row_number().over(inner))
    sizes = t.groupBy("conv_id", "_piece").agg(F.max("_k").alias("_m"))
    across = Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(across), F.lit(0)))
    t = t.join(sizes.drop("_m"), ["conv_id", "_piece"]).withColumn("pos", (F.col("_before") + F.col("_k")).cast("long"))
    # A null and an empty text differ; so do null and empty roles.
    fields = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    t = t.withColumns({"_d1": F.xxhash64(*fields), "_d2": F.xxhash64(F.lit("second"), *fields, F.lit(2))})
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"_r1": F.bit_xor("_d1").over(running), "_r2": F.bit_xor("_d2").over(running)})
    sums = t.groupBy("conv_id", "_piece").agg(F.bit_xor("_d1").alias("_s1"), F.bit_xor("_d2").alias("_s2"))
    sums = sums.withColumns({c: F.coalesce(F.bit_xor(s).over(across), F.lit(0).cast("long")) for c, s in (("_b1", "_s1"), ("_b2", "_s2"))})
    t = t.join(sums.select("conv_id", "_piece", "_b1", "_b2"), ["conv_id", "_piece"])
    t = t.withColumns({"d1": F.col("_r1").bitwiseXOR(F.col("_b1")), "d2": F.col("_r2").bitwiseXOR(F.col("_b2")), "part": F.floor((F.col("pos") - 1) / piece)})
    return t.select("conv_id", "turn", "role", "text", "pos", "d1", "d2", "part")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that stay, from the output of prefix_digests.

    One that equals the first turns of a longer one goes; of equal ones, the smallest conv_id stays.
    """
    ends = turns.groupBy("conv_id").agg(F.max(F.struct("pos", "d1", "d2")).alias("e")).select("conv_id", "e.*")
    ends = written(ends, "chat-ends")
    n = ends.select("conv_id", F.col("pos").alias("n_turns"))
    # All proper prefixes, once each, and all whole conversations, once each with their first id.
    longer = turns.join(n, "conv_id").where(F.col("pos") < F.col("n_turns")).select("pos", "d1", "d2").distinct()
    first = ends.groupBy("pos", "d1", "d2").agg(F.min("conv_id").alias("conv_id"))
    return first.join(longer, ["pos", "d1", "d2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def format_chats(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """The conversations that are no prefix of another, rendered: conv_id, part, n_turns, text, parts in order.

    A conversation of up to `piece` turns is one row; a longer one has a row for each `piece` turns, and its parts
    joined are the whole text. n_turns counts the conversation's turns. Null roles and texts render as empty. Rows
    with a null conv_id belong to no conversation and are left out. Repeated rows are turns of their own; other
    columns are not used. Empty input gives an empty result.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id is not null")
    numbered = written(prefix_digests(rows, piece), "chat-turns")
    kept = maximal_conversations(numbered)
    said = numbered.join(kept, "conv_id").select("conv_id", "part", "n_turns", "pos", render_turn(F.col("role"), F.col("text")).alias("_t"))
    whole = said.groupBy("conv_id", "part").agg(F.max("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "_t"))).alias("_ts"))
    return whole.select("conv_id", "part", "n_turns", F.array_join(F.col("_ts._t"), "").alias("text"))

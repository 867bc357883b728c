"""Cumulative-snapshot collapse and rendering of logged conversations, in DataFrame functions only.

Chat logs often hold the same conversation many times, each snapshot one or
more turns longer.  Every turn gets a hash of its position, role and text; the
running exclusive-or of these along a conversation is the rolling hash of each
of its turn prefixes (two independent 64-bit hashes, 128 bits together, with
the length).  A conversation whose own hash occurs as a proper prefix of
another is a snapshot of it and goes by an anti-join; of equal conversations
the one with the smallest id stays.  Both sides of the anti-join are distinct
before they meet, after map-side aggregation, so a first turn or a whole
conversation that a third of the log shares is one row.  What is left is
rendered in turn order.

Cases: rows without a conversation id belong to none and are left out; a null
role reads ``unknown`` and a null text is empty; a null turn comes first, turns
that tie are ordered by role, then text; a row given twice counts once;
control markers inside texts are broken up so that they cannot pose as turns;
extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, role, text, h1, h2, last): rolling hashes of each turn prefix."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    indexed = rows.withColumn("idx", F.row_number().over(order))
    return indexed.select(
        "conv_id", "idx", "role", "text",
        F.bit_xor(F.xxhash64(F.lit(1), "idx", "role", "text")).over(running).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), "text", "idx", "role")).over(running).alias("h2"),
        F.lead("idx").over(order).isNull().alias("last"),
    )


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, copies) of the maximal conversations."""
    turns = prefix_hashes(conversations)
    whole = turns.where("last").groupBy("h1", "h2", "idx").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = turns.where("not last").select("h1", "h2", "idx").distinct()
    return whole.join(inner, ["h1", "h2", "idx"], "left_anti").select("conv_id", "copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, rendered) of the maximal conversations."""
    kept = collapse(conversations)
    turns = prefix_hashes(conversations).join(kept, "conv_id")
    safe = F.replace(F.replace("text", F.lit("<|im_"), F.lit("<| im_")), F.lit("\r\n"), F.lit("\n"))
    piece = F.concat(F.lit(OPEN), F.replace("role", F.lit("<|im_"), F.lit("<| im_")), F.lit("\n"), safe, F.lit(CLOSE))
    lines = turns.select("conv_id", "copies", "idx", piece.alias("piece"))
    got = lines.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("idx", "piece"))).alias("all"))
    return got.select("conv_id", "n_turns", "copies", F.array_join("all.piece", "\n").alias("rendered"))

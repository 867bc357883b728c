"""Connected components of an edge list by alternating star contractions.

Each round joins every node to the smallest neighbour it knows, first on the
side of larger neighbours, then on the other; rounds needed grow with the
logarithm of the longest chain, not with its length.  Both steps are one
aggregation, combined before the shuffle, and one equi-join with its result.
A star's centre has as many edges as its component has nodes: the smallest
neighbours are written before they are joined, so that both sides of the join
are plain shuffles (or the small one is broadcast below Spark's threshold), of
which adaptive execution splits a centre's part over many tasks.  The edge list
is rewritten under the shared folder each round, and older ones are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of (u, v), written: ``large`` moves greater neighbours of u, else the smaller ones (v < u in all rows)."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    near = edges.join(low, "u")
    if large:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    out = cut(moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    drop_cut(low)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id that occurs in edges (u, v), the smallest id reachable from it.

    Null ends and self-loops are ignored; repeated edges count once; an empty
    edge list gives an empty result.
    """
    flat = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()
    now = cut(flat)
    while True:
        half = _star(now, True)
        following = _star(half, False)
        drop_cut(half)
        state = lambda df: df.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        done = state(now) == state(following)
        drop_cut(now)
        now = following
        if done:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

"""Questions to the graph: degrees, sub-graphs, neighbours, paths.

nodes: (id, canonical_name, type, mention_count, ...); edges: (id, src_id,
dst_id, relation, weight, strength, confidence, ...).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import contains_ci
from graphloom.schemas import CO_OCCURS
from graphloom.session import drop, shared_dir

PATH = "step int, from_id bigint, to_id bigint, edge_id bigint, relation string"

#: Default names too general to lead a landing view.
GENERIC = ("ai", "artificial intelligence", "united states", "america", "washington", "pentagon")


def is_typed() -> Column:
    return F.col("relation") != CO_OCCURS


def edge_strength() -> Column:
    """Typed edges count in full."""
    return F.when(is_typed(), F.lit(1.0)).otherwise(F.coalesce("strength", F.lit(0.0)))


def endpoints(edges: DataFrame, *carry: str) -> DataFrame:
    """One row for each end of each edge."""
    return edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"), *carry)


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree, typed_degree)."""
    return endpoints(edges, "relation").groupBy("id").agg(F.count("*").alias("degree"), F.count_if(is_typed()).alias("typed_degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges).distinct(), "id", "left_anti")


def most_connected(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    return nodes.join(degree(edges), "id").select("id", "canonical_name", "degree").orderBy(F.desc("degree"), "id").limit(limit)


def top_nodes(nodes: DataFrame, limit: int = 20) -> DataFrame:
    return nodes.orderBy(F.desc("mention_count"), "id").limit(limit)


def _with_end_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    t = nodes.select("id", "type")
    return edges.join(t.select(F.col("id").alias("src_id"), F.col("type").alias("src_kind")), "src_id", "left").join(t.select(F.col("id").alias("dst_id"), F.col("type").alias("dst_kind")), "dst_id", "left")


def with_evidence(edges: DataFrame, nodes: DataFrame, min_confidence: float = 0.0, min_strength: float = 0.0, src_type: str | None = None, dst_type: str | None = None) -> DataFrame:
    """Edges that pass the evidence filters.

    Confidence concerns typed edges only, strength co-occurrence only; end types
    are directed for typed edges and either way round for co-occurrence.
    """
    out = edges
    if min_confidence > 0:
        out = out.where(~is_typed() | (F.coalesce("confidence", F.lit(-1.0)) >= min_confidence))
    if min_strength > 0:
        out = out.where(is_typed() | (F.coalesce("strength", F.lit(0.0)) >= min_strength))
    if src_type or dst_type:
        out = _with_end_types(out, nodes)
        a, b = F.col("src_kind"), F.col("dst_kind")
        both = a.isNotNull() & b.isNotNull()
        if src_type:
            both = both & F.when(is_typed(), a == src_type).otherwise((a == src_type) | (b == src_type))
        if dst_type:
            both = both & F.when(is_typed(), b == dst_type).otherwise((a == dst_type) | (b == dst_type))
        out = out.where(both).drop("src_kind", "dst_kind")
    return out


def find_focus(nodes: DataFrame, needle: str) -> DataFrame:
    """The first node by id whose name contains the needle."""
    return nodes.where(contains_ci(F.col("canonical_name"), needle)).orderBy("id").limit(1)


def resolve_name(nodes: DataFrame, name: str) -> DataFrame:
    """An exact name in any case, else the most mentioned one that contains it."""
    hits = nodes.where(contains_ci(F.col("canonical_name"), name))
    exact = F.lower("canonical_name") == name.lower()
    return hits.orderBy(F.desc(exact), F.desc(F.when(exact, F.lit(0)).otherwise(F.col("mention_count"))), "id").limit(1)


def subgraph(
    nodes: DataFrame, edges: DataFrame, focus: str | None = None, node_type: str | None = None, min_mentions: int = 0, max_nodes: int = 90, min_weight: int = 2, relations_only: bool = False,
    min_confidence: float = 0.0, min_strength: float = 0.0, src_type: str | None = None, dst_type: str | None = None, generic: Sequence[str] = GENERIC,
) -> tuple[DataFrame, DataFrame]:
    """The most telling nodes, or a focus and its strongest neighbours, with the edges among them.

    Returned nodes carry ``rank``; with a focus that nothing matches both frames are empty.
    """
    pool = nodes.where(F.col("mention_count") >= min_mentions)
    if node_type is not None:
        pool = pool.where(F.col("type") == node_type)
    sound = with_evidence(edges, nodes, min_confidence, min_strength, src_type, dst_type)
    shown = sound.where(is_typed() if relations_only else is_typed() | (F.col("weight") >= min_weight))
    if focus:
        centre = find_focus(nodes, focus).select(F.col("id").alias("centre"))
        both = shown.withColumn("score", edge_strength()).select(F.col("src_id").alias("centre"), F.col("dst_id").alias("id"), "score").unionByName(shown.withColumn("score", edge_strength()).select(F.col("dst_id").alias("centre"), F.col("src_id").alias("id"), "score"))
        near = both.join(centre, "centre").where("id <> centre").groupBy("id").agg(F.max("score").alias("score")).join(pool.select("id"), "id", "left_semi")
        best = near.orderBy(F.desc("score"), "id").limit(max_nodes - 1)
        kept = centre.select(F.col("centre").alias("id"), F.lit(2.0).alias("score")).unionByName(best)
        order = [F.desc("score"), F.asc("id")]
    else:
        ids = pool.select("id")
        inside = sound.where(is_typed()).join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
        typed = endpoints(inside).groupBy("id").agg(F.count("*").alias("typed_degree"))
        every = endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"))
        ranked = pool.join(typed, "id", "inner" if relations_only else "left").join(every, "id", "left")
        plain = ~F.lower("canonical_name").isin(*generic) if node_type is None and not relations_only else F.lit(True)
        order = [F.desc("plain"), F.desc("t"), F.desc("d"), F.desc("mention_count"), F.asc("id")]
        kept = ranked.select("id", plain.alias("plain"), F.coalesce("typed_degree", F.lit(0)).alias("t"), F.coalesce("degree", F.lit(0)).alias("d"), "mention_count").orderBy(*order).limit(max_nodes)
    # At most max_nodes rows: one small window.
    from pyspark.sql import Window

    numbered = kept.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    chosen = nodes.join(numbered, "id")
    ids = numbered.select("id")
    links = shown.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return chosen, links


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: int) -> DataFrame:
    """(other_id, name, type, direction, relation, weight, confidence, evidence), typed first, then by weight."""
    out = edges.where(F.col("src_id") == node_id).select(F.col("dst_id").alias("other_id"), F.lit("out").alias("direction"), "relation", "weight", "confidence", "evidence")
    inn = edges.where(F.col("dst_id") == node_id).select(F.col("src_id").alias("other_id"), F.lit("in").alias("direction"), "relation", "weight", "confidence", "evidence")
    named = out.unionByName(inn).join(nodes.select(F.col("id").alias("other_id"), F.col("canonical_name").alias("name"), "type"), "other_id")
    return named.orderBy(F.desc(is_typed()), F.desc("weight"), "other_id", "direction", "relation")


def adjacent(nodes: DataFrame, edges: DataFrame, node_id: int, limit: int = 6) -> DataFrame:
    """(id, name, type, shared_neighbors): two hops away, by the number of neighbours in between."""
    both = edges.select("src_id", "dst_id").unionByName(edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))).distinct()
    direct = both.where(F.col("src_id") == node_id).select(F.col("dst_id").alias("mid"))
    second = both.join(direct, both.src_id == F.col("mid")).where(F.col("dst_id") != node_id).groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("shared_neighbors"))
    far = second.join(direct.withColumnRenamed("mid", "id"), "id", "left_anti")
    return far.join(nodes.select("id", F.col("canonical_name").alias("name"), "type"), "id").orderBy(F.desc("shared_neighbors"), "id").limit(limit)


def shortest_path(edges: DataFrame, src: int, dst: int, max_hops: int | None = None) -> DataFrame:
    """(step, from_id, to_id, edge_id, relation) of a path with fewest edges; empty if there is none (of ``max_hops`` edges, if given) or ``src`` is ``dst``.

    Two breadth-first searches, one from each end, of which the one with fewer
    nodes at its rim goes on.  Every level is a folder of (at, hop): the hop is
    the smallest (co-occurrence?, edge id) that leads one step nearer to the end
    the search began at, so a row never holds more than one hop, and a plan reads
    one level and the nodes of one side, however far the search has come.  Where
    the rims meet, the nodes of the forward side that lie on a shortest path get
    their hops towards ``dst`` level by level; then the path is read from ``src``
    on, one row of each level.  All hops read point forward, so of equally short
    paths the one whose sequence of (co-occurrence?, edge id) is smallest comes
    out, whatever the partitions.  Edges with a null end take no part; those with a null relation count as co-occurrence.
    """
    spark = edges.sparkSession
    root = f"{shared_dir(spark)}/path-{uuid.uuid4().hex}"
    links = edges.select(F.when(is_typed(), 0).otherwise(1).alias("plain"), *(F.col(c).cast("long").alias(c) for c in ("id", "src_id", "dst_id")), "relation").where("src_id <> dst_id")
    hop = lambda to: F.struct("plain", F.col("id").alias("edge_id"), F.col(to).alias("to"), "relation").alias("hop")
    both = links.select(F.col("src_id").alias("at"), hop("dst_id")).unionByName(links.select(F.col("dst_id").alias("at"), hop("src_id")))
    schema = f"at bigint, hop {both.schema['hop'].dataType.simpleString()}"

    def level(side: str, i: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{root}/{side}/level={i}")

    def nearer(rim: DataFrame) -> DataFrame:
        """Nodes beside the rim, each with its smallest hop onto it."""
        return both.join(rim.select(F.col("at").alias("rim")), F.col("hop.to") == F.col("rim")).groupBy("at").agg(F.min("hop").alias("hop"))

    for side, end in (("forward", src), ("backward", dst)):
        spark.range(1).select(F.lit(int(end)).cast("long").alias("at")).withColumn("hop", F.lit(None).cast(both.schema["hop"].dataType)).write.parquet(f"{root}/{side}/level=0")
    depth, rim = {"forward": 0, "backward": 0}, {"forward": 1, "backward": 1}
    met = src == dst
    while not met and all(rim.values()) and (max_hops is None or sum(depth.values()) < max_hops):
        side, other = ("forward", "backward") if rim["forward"] <= rim["backward"] else ("backward", "forward")
        seen = spark.read.schema("at bigint").parquet(f"{root}/{side}").select("at")
        depth[side] += 1
        nearer(level(side, depth[side] - 1)).join(seen, "at", "left_anti").write.parquet(f"{root}/{side}/level={depth[side]}")
        # The rims were apart before, so what they share now is the middle of all shortest paths.
        common = level(other, depth[other]).select("at", F.lit(True).alias("common"))
        rim[side], shared = level(side, depth[side]).join(common, "at", "left").agg(F.count("*"), F.count("common")).first()
        met = shared > 0
    if not met or src == dst:
        drop(spark, root)
        return spark.createDataFrame([], PATH)

    # Nodes before the middle have hops towards ``src`` so far: those on a path get one onto the next such level.
    middle = level("forward", depth["forward"]).join(level("backward", depth["backward"]).select("at"), "at", "left_semi")
    middle.write.parquet(f"{root}/on/level={depth['forward']}")
    for i in range(depth["forward"] - 1, -1, -1):
        nearer(level("on", i + 1)).join(level("forward", i).select("at"), "at", "left_semi").write.parquet(f"{root}/on/level={i}")
    steps, at = [], int(src)
    for i in range(sum(depth.values())):
        here = level("on", i) if i < depth["forward"] else level("backward", sum(depth.values()) - i)
        h = here.where(F.col("at") == at).first()["hop"]
        steps.append((i + 1, at, h["to"], h["edge_id"], h["relation"]))
        at = h["to"]
    drop(spark, root)
    return spark.createDataFrame(steps, PATH).orderBy("step")


def two_hop_pairs(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, shared): for each asked node a, the nodes b two hops away that it is not linked to. asked: (id).

    The first hop is taken by the asked nodes alone, so a hub costs its
    neighbours for each asked node beside it, not the square of them.
    """
    both = edges.select("src_id", "dst_id").unionByName(edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))).distinct()
    direct = both.join(asked.select(F.col("id").alias("src_id")).distinct(), "src_id", "left_semi").select(F.col("src_id").alias("a"), F.col("dst_id").alias("m"))
    second = both.select(F.col("src_id").alias("m"), F.col("dst_id").alias("b"))
    # One aggregate by pairs counts what lies between and drops those that are linked: no join holds them once more.
    reached = direct.join(second, "m").where("a <> b").select("a", "b", F.lit(True).alias("far"))
    every = reached.unionByName(direct.select("a", F.col("m").alias("b"), F.lit(False).alias("far")))
    return every.groupBy("a", "b").agg(F.count("*").alias("shared"), F.bool_and("far").alias("far")).where("far").drop("far")


def tour(stops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tour, stop, name, id): ordered stops with the node of that name, or null. stops: (tour, names)."""
    each = stops.select("tour", F.posexplode("names").alias("i", "name"))
    known = nodes.groupBy(F.lower("canonical_name").alias("k")).agg(F.min("id").alias("id"))
    return each.join(known, F.lower("name") == F.col("k"), "left").select("tour", (F.col("i") + 1).alias("stop"), "name", "id").orderBy("tour", "stop")

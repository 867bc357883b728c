"""Search, capability cards, briefing and pulse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import contains_ci
from graphloom.operators.graph import endpoints, is_typed
from graphloom.schemas import CO_OCCURS


def search_entities(nodes: DataFrame, aliases: DataFrame, edges: DataFrame, q: str, limit: int = 20, since: str | None = None, relation: str | None = None) -> DataFrame:
    """Nodes whose name or any alias contains the query, most mentioned first."""
    by_alias = aliases.where(contains_ci(F.col("alias"), q)).select(F.col("node_id").alias("id")).distinct().withColumn("__hit", F.lit(True))
    hits = nodes.join(by_alias, "id", "left").where(contains_ci(F.col("canonical_name"), q) | F.col("__hit").isNotNull()).drop("__hit")
    if since:
        hits = hits.where(F.col("last_seen") >= F.lit(since).cast("date"))
    if relation:
        hits = hits.join(endpoints(edges.where(F.col("relation") == relation)).distinct(), "id", "left_semi")
    return hits.where(F.lit(q.strip() != "")).orderBy(F.desc("mention_count"), "id").limit(limit)


def search_documents(documents: DataFrame, q: str, limit: int = 20, since: str | None = None) -> DataFrame:
    """Documents with the query in the title, then in the body only, in corpus order; undated ones pass ``since``."""
    title, body = contains_ci(F.col("title"), q), contains_ci(F.col("raw_text"), q)
    hits = documents.where(title | body).withColumn("rank", F.when(title, 0).otherwise(1))
    if since:
        hits = hits.where(F.col("doc_date").isNull() | (F.col("doc_date") >= F.lit(since).cast("date")))
    return hits.where(F.lit(q.strip() != "")).orderBy("rank", "doc_ord").limit(limit)


def capability_cards(subfields: DataFrame, nodes: DataFrame, edges: DataFrame, concepts: int = 8, organizations: int = 5, least: int = 2) -> dict[str, DataFrame]:
    """Concepts and organizations by subfield. subfields: (subfield, concept)."""
    concept = nodes.where("type = 'concept'").select(F.lower("canonical_name").alias("k"), "id", "canonical_name", "mention_count")
    members = subfields.join(concept, F.lower("concept") == F.col("k")).select("subfield", "id", "canonical_name", "mention_count")
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("subfield").orderBy(F.desc("mention_count"), "id")))
    both = edges.select(F.col("src_id").alias("id"), F.col("dst_id").alias("org_id"), "weight").unionByName(edges.select(F.col("dst_id").alias("id"), F.col("src_id").alias("org_id"), "weight"))
    org = nodes.where("type = 'organization'").select(F.col("id").alias("org_id"), F.col("canonical_name").alias("organization"))
    weight = members.select("subfield", "id").join(both, "id").join(org, "org_id").groupBy("subfield", "org_id", "organization").agg(F.sum("weight").alias("weight"))
    best = weight.withColumn("rank", F.row_number().over(Window.partitionBy("subfield").orderBy(F.desc("weight"), "org_id")))
    cards = members.groupBy("subfield").agg(F.count("*").alias("concepts"), F.sum("mention_count").alias("mentions")).join(weight.groupBy("subfield").agg(F.count_if(F.col("weight") >= least).alias("organizations")), "subfield", "left").select("subfield", "concepts", "mentions", F.coalesce("organizations", F.lit(0)).alias("organizations"))
    return {"cards": cards, "concepts": ranked.where(F.col("rank") <= concepts), "organizations": best.where(F.col("rank") <= organizations)}


def scope(subfields: DataFrame, subfield: str, nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Concepts of a subfield and their neighbours, edges inside, documents that name a concept.

    The subfield's concepts (a curated list) become one pattern for documents.
    """
    mine = subfields.where(F.lower("subfield") == subfield.lower()).select(F.lower("concept").alias("k")).distinct()
    core = nodes.where("type = 'concept'").join(mine, F.lower("canonical_name") == F.col("k"), "left_semi").select("id")
    ids = core.unionByName(edges.join(core.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select(F.col("dst_id").alias("id"))).unionByName(edges.join(core.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(F.col("src_id").alias("id"))).distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    names = F.coalesce(mine.agg(F.collect_list("k").alias("ks")).scalar(), F.array().cast("array<string>"))
    text = F.lower(F.concat_ws(" ", "title", "raw_text"))
    return {"nodes": nodes.join(ids, "id", "left_semi"), "edges": inside, "documents": documents.withColumn("__names", names).withColumn("__text", text).where(F.exists("__names", lambda k: F.contains(F.col("__text"), k))).drop("__names", "__text")}


def briefing(nodes: DataFrame, edges: DataFrame, documents: DataFrame, as_of: str, days: int = 7, subfields: DataFrame | None = None, subfield: str | None = None) -> dict[str, DataFrame]:
    """Latest documents, strongest typed relations, new and busiest entities of a window and scope."""
    if subfields is not None and subfield:
        part = scope(subfields, subfield, nodes, edges, documents)
        nodes, edges, documents = part["nodes"], part["edges"], part["documents"]
    start = F.date_sub(F.lit(as_of).cast("date"), days)
    name = nodes.select("id", "canonical_name")
    typed = edges.where(is_typed()).join(name.select(F.col("id").alias("src_id"), F.col("canonical_name").alias("src")), "src_id").join(name.select(F.col("id").alias("dst_id"), F.col("canonical_name").alias("dst")), "dst_id")
    return {
        "documents": documents.where(F.col("fetched_at").cast("date") >= start).orderBy(F.desc("fetched_at"), "doc_ord").limit(12),
        "relations": typed.select("src", "relation", "dst", "weight", "evidence", "source", "id").orderBy(F.desc("weight"), "id").limit(12),
        "new_entities": nodes.where(F.col("first_seen") >= start).orderBy(F.desc("mention_count"), "id").limit(10),
        "people": leads(nodes),
    }


def leads(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """Persons by last appearance, then mentions."""
    return nodes.where("type = 'person'").orderBy(F.desc_nulls_last("last_seen"), F.desc("mention_count"), "id").limit(limit)


def funding(documents: DataFrame, data_source: str, since: str | None = None) -> DataFrame:
    """(awards, total) of structured documents of one data source. documents: (metadata, doc_date)."""
    mine = documents.where(F.element_at("metadata", F.lit("data_source")) == data_source)
    if since:
        mine = mine.where(F.col("doc_date") >= F.lit(since).cast("date"))
    return mine.agg(F.count("*").alias("awards"), F.coalesce(F.sum(F.element_at("metadata", F.lit("amount")).try_cast("double")), F.lit(0.0)).alias("total"))


def pulse(nodes: DataFrame, spikes: DataFrame, documents: DataFrame, as_of: str, days: int = 7, data_source: str = "awards") -> DataFrame:
    """One row: entities new in the window, the top spike, funding in the window."""
    start = F.date_sub(F.lit(as_of).cast("date"), days)
    new = nodes.where(F.col("first_seen") >= start).agg(F.count("*").alias("n")).scalar()
    top = spikes.orderBy(F.desc("ratio"), F.desc("recent"), "id").limit(1).select("name").scalar()
    mine = documents.where((F.element_at("metadata", F.lit("data_source")) == data_source) & (F.col("doc_date") >= start))
    total = mine.agg(F.coalesce(F.sum(F.element_at("metadata", F.lit("amount")).try_cast("double")), F.lit(0.0)).alias("t")).scalar()
    return documents.sparkSession.range(1).select(new.alias("new_entities"), top.alias("top_spike"), total.alias("funding"))


def node_documents(documents: DataFrame, bridge: DataFrame, node_id: int, limit: int = 50) -> DataFrame:
    """Documents of a node, latest fetched first, with a 240-character snippet."""
    mine = documents.join(bridge.where(F.col("node_id") == node_id).select("content_hash"), "content_hash", "left_semi")
    return mine.withColumn("snippet", F.left("raw_text", F.lit(240))).orderBy(F.desc("fetched_at"), "content_hash").limit(limit)


def cooccurring(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relation") == CO_OCCURS)

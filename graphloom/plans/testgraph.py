"""Graphs from the order tables.  In the first an order is a document, a part name an entity; the second, of trade, is sparse.

Nodes and edges are built once for an application and written to the shared
folder; queries read the tables, as they would those of a rebuild.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import resolve
from graphloom.schemas import CO_OCCURS
from graphloom.session import shared_dir, table
from graphloom.sources.corpus import exists


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("content_hash"), F.col("o_orderkey").alias("doc_ord"), F.col("o_orderdate").cast("date").alias("doc_date"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed mentions: the part name is its own key."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    name = F.col("p_name")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("content_hash"), F.col("l_orderkey").alias("doc_ord"), F.col("l_linenumber").alias("mention_ord"), name.alias("text"), name.alias("alias"), name.alias("canonical"), name.alias("node_key"), kind(name).alias("label"), F.lit(None).cast("string").alias("email"), F.col("l_returnflag").alias("flag"))


def kind(name):
    n = F.length(name) % 4
    return F.when(n == 0, "organization").when(n == 1, "person").when(n == 2, "concept").otherwise("misc")


def _built(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    at = f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}/graph-{hashlib.md5(sf_dir.encode()).hexdigest()}/{name}"
    if not exists(spark, f"{at}/_SUCCESS"):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, "nodes", lambda: make_nodes(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    return _built(spark, sf_dir, "edges", lambda: make_edges(spark, sf_dir, nodes(spark, sf_dir) if known is None else known))


def make_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.number(resolve.node_rollup(mentions(spark, sf_dir), documents(spark, sf_dir)), "node_key")


def make_edges(spark: SparkSession, sf_dir: str, known: DataFrame) -> DataFrame:
    """Co-occurrence, and typed edges from one line of an order to the next by return flag."""
    said = mentions(spark, sf_dir)
    ids = known.select("node_key", "id")
    cooc = resolve.with_strength(resolve.cooccurrence(said.select("content_hash", "node_key")), known)
    a, b = ids.select(F.col("node_key").alias("a"), F.col("id").alias("src_id")), ids.select(F.col("node_key").alias("b"), F.col("id").alias("dst_id"))
    plain = cooc.join(a, "a").join(b, "b").select("src_id", "dst_id", F.lit(CO_OCCURS).alias("relation"), "weight", "strength", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("string").alias("source"))
    x = said.where(F.col("flag").isin("R", "A")).select("content_hash", "doc_ord", F.col("node_key").alias("src"), F.when(F.col("flag") == "R", "supplies").otherwise("develops").alias("relation"), (F.col("mention_ord") + 1).alias("line"))
    y = said.select("content_hash", F.col("node_key").alias("dst"), F.col("mention_ord").alias("line"))
    rows = x.join(y, ["content_hash", "line"]).withColumn("evidence", F.concat_ws(" ", "src", F.lit("to"), "dst", F.lit("in"), "content_hash")).withColumn("s1", F.lit(0))
    typed = resolve.typed_edges(rows).join(ids.select(F.col("node_key").alias("src"), F.col("id").alias("src_id")), "src").join(ids.select(F.col("node_key").alias("dst"), F.col("id").alias("dst_id")), "dst").select("src_id", "dst_id", "relation", "weight", F.lit(1.0).alias("strength"), "confidence", "evidence", "source")
    return resolve.number(plain.unionByName(typed).withColumn("__typed", F.col("relation") != CO_OCCURS), "__typed", "src_id", "relation", "dst_id").drop("__typed")


def bridge(spark: SparkSession, sf_dir: str, known: DataFrame) -> DataFrame:
    return mentions(spark, sf_dir).select("node_key", "content_hash").distinct().join(known.select("node_key", F.col("id").alias("node_id")), "node_key").select("node_id", "content_hash")


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and customers; four of their keys follow each other as ids."""
    kinds = (("region", "r_regionkey", "r_name", "concept"), ("nation", "n_nationkey", "n_name", "place"), ("supplier", "s_suppkey", "s_name", "organization"), ("customer", "c_custkey", "c_name", "person"))
    parts = [table(spark, sf_dir, t).select((F.col(key).cast("long") * 4 + i).alias("id"), F.col(name).alias("canonical_name"), F.lit(kind).alias("type")) for i, (t, key, name, kind) in enumerate(kinds)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who lies where, and who buys from whom: a typed edge if more than once, else a co-occurrence."""
    return _built(spark, sf_dir, "trade", lambda: make_trade(spark, sf_dir))


def make_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda key, i: F.col(key).cast("long") * 4 + i
    lies = [table(spark, sf_dir, t).select(at(a, i).alias("src_id"), at(b, j).alias("dst_id"), F.lit("located_in").alias("relation"), F.lit(1).cast("long").alias("weight")) for t, a, i, b, j in (("nation", "n_nationkey", 1, "n_regionkey", 0), ("supplier", "s_suppkey", 2, "s_nationkey", 1), ("customer", "c_custkey", 3, "c_nationkey", 1))]
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    sold = l.join(o, l.l_orderkey == o.o_orderkey).groupBy(at("o_custkey", 3).alias("src_id"), at("l_suppkey", 2).alias("dst_id")).agg(F.count("*").alias("weight"))
    sold = sold.select("src_id", "dst_id", F.when(F.col("weight") > 1, "buys_from").otherwise(CO_OCCURS).alias("relation"), "weight")
    return lies[0].unionByName(lies[1]).unionByName(lies[2]).unionByName(sold).select((F.col("src_id") * (1 << 32) + F.col("dst_id")).alias("id"), "*")


#: The graph of trade in SQL; u has each edge either way round.
TRADE = """
WITH RECURSIVE nodes AS (SELECT 4 * r_regionkey::BIGINT AS id, r_name AS canonical_name, 'concept' AS type FROM region UNION ALL SELECT 4 * n_nationkey::BIGINT + 1, n_name, 'place' FROM nation UNION ALL SELECT 4 * s_suppkey + 2, s_name, 'organization' FROM supplier UNION ALL SELECT 4 * c_custkey + 3, c_name, 'person' FROM customer),
sold AS (SELECT 4 * o_custkey + 3 AS src_id, 4 * l_suppkey + 2 AS dst_id, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
e AS (SELECT 4 * n_nationkey::BIGINT + 1 AS src_id, 4 * n_regionkey::BIGINT AS dst_id, 'located_in' AS relation FROM nation UNION ALL SELECT 4 * s_suppkey + 2, 4 * s_nationkey::BIGINT + 1, 'located_in' FROM supplier UNION ALL SELECT 4 * c_custkey + 3, 4 * c_nationkey::BIGINT + 1, 'located_in' FROM customer
  UNION ALL SELECT src_id, dst_id, CASE WHEN weight > 1 THEN 'buys_from' ELSE 'co_occurs_with' END FROM sold),
u AS (SELECT src_id AS a, dst_id AS b, src_id * 4294967296 + dst_id AS id, relation FROM e UNION ALL SELECT dst_id, src_id, src_id * 4294967296 + dst_id, relation FROM e)
"""

#: The first graph in SQL.
SQL = """
WITH RECURSIVE m AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc, l_orderkey AS ord, p_name AS k, l_linenumber AS ln, l_returnflag AS rf FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc, o_orderkey AS ord, CAST(o_orderdate AS DATE) AS dt FROM orders),
nodes AS (SELECT row_number() OVER (ORDER BY k) AS id, k AS canonical_name, CASE length(k) % 4 WHEN 0 THEN 'organization' WHEN 1 THEN 'person' WHEN 2 THEN 'concept' ELSE 'misc' END AS type, count(*) AS mention_count, count(DISTINCT m.doc) AS document_count, min(dt) AS first_seen, max(dt) AS last_seen FROM m LEFT JOIN d ON m.doc = d.doc GROUP BY k),
dk AS (SELECT DISTINCT doc, k FROM m),
ok AS (SELECT doc FROM dk GROUP BY doc HAVING count(*) BETWEEN 2 AND 60),
co AS (SELECT a.k AS a, b.k AS b, count(*) AS weight FROM dk a JOIN dk b ON a.doc = b.doc AND a.k < b.k WHERE a.doc IN (SELECT doc FROM ok) GROUP BY 1, 2),
ty AS (SELECT x.k AS s, CASE x.rf WHEN 'R' THEN 'supplies' ELSE 'develops' END AS relation, y.k AS t, count(*) AS weight, CAST(min(x.ord) AS VARCHAR) AS source, x.k || ' to ' || y.k || ' in ' || CAST(min(x.ord) AS VARCHAR) AS evidence FROM m x JOIN m y ON x.doc = y.doc AND y.ln = x.ln + 1 WHERE x.rf IN ('R', 'A') AND x.k <> y.k GROUP BY 1, 2, 3),
e0 AS (SELECT na.id AS src_id, nb.id AS dst_id, 'co_occurs_with' AS relation, weight, round_even(weight / (na.document_count + nb.document_count - weight), 4) AS strength, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS evidence FROM co JOIN nodes na ON na.canonical_name = a JOIN nodes nb ON nb.canonical_name = b
  UNION ALL SELECT na.id, nb.id, relation, weight, 1.0, round_even(1 - 1.0::DOUBLE / (1 + weight), 3), source, evidence FROM ty JOIN nodes na ON na.canonical_name = s JOIN nodes nb ON nb.canonical_name = t),
edges AS (SELECT row_number() OVER (ORDER BY relation <> 'co_occurs_with', src_id, relation, dst_id) AS id, * FROM e0),
bridge AS (SELECT n.id AS node_id, dk.doc AS content_hash FROM dk JOIN nodes n ON n.canonical_name = dk.k),
ends AS (SELECT src_id AS id, relation FROM edges UNION ALL SELECT dst_id, relation FROM edges)
"""

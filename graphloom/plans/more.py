"""Further queries of the registry: scalar rules, stores, digests and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import dates, numeric, text
from graphloom.operators import curation, digest, extract, graph, quality, resolve, temporal
from graphloom.plans import testgraph as G
from graphloom.plans.registry import PEOPLE, READ, _awards, corpus_documents, people, query, runs, values
from graphloom.session import table
from graphloom.sources import corpus, records, stores

# ------------------------------------------------------------ scalar rules


@query("SELECT doc_id FROM documents WHERE length(text) < 400 AND source <> ''")
def q_short_bodies(spark, sf):
    return table(spark, sf, "documents").where(text.wants_body(F.col("text"), F.col("source"))).select("doc_id")


@query("SELECT * FROM (VALUES (1, 'T. body. x'), (2, 'T. .  a, b .  c'), (3, 'T.'), (4, '. b')) t(id, s)")
def q_document_text(spark, sf):
    rows = values(spark, "(1, 'T', 'body. x'), (2, 'T', 'Keywords: a, b Tags ： c'), (3, 'T', null), (4, null, 'b')", "id, t, b")
    return rows.select("id", text.document_text(F.col("t"), F.col("b")).alias("s"))


@query("SELECT * FROM (VALUES (1, 'Acme built it.'), (2, 'Acme built it and more'), (3, 'x y')) t(id, s)")
def q_evidence(spark, sf):
    rows = values(spark, "(1, 'Acme  built it. Then more', 0, 11), (2, 'Acme built it and more', 0, 10), (3, 'a x  y', 2, 6)", "id, t, a, b")
    return rows.select("id", text.evidence(F.col("t"), F.col("a"), F.col("b")).alias("s"))


@query("SELECT event_id, ts < TIMESTAMP '2024-01-28 12:00:00' AS stale, CAST(floor((epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(ts)) / 3600000000.0) AS BIGINT) AS hours FROM events")
def q_staleness(spark, sf):
    now, then = F.lit("2024-01-30 00:00:00"), F.col("ts")
    return table(spark, sf, "events").select("event_id", dates.is_stale(then, now, 36).alias("stale"), F.floor(dates.hours_since(then, now)).alias("hours"))


@query("SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 0.0 ELSE 100.0 * c_nationkey / c_acctbal END AS pct FROM customer")
def q_percent_guard(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numeric.percent(F.col("c_nationkey"), F.col("c_acctbal")).alias("pct"))


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS amount FROM orders UNION ALL SELECT * FROM (VALUES (-1, 1234.5::DOUBLE), (-2, NULL), (-3, 99.0::DOUBLE)) t")
def q_money(spark, sf):
    written = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("s"))
    odd = values(spark, "(-1L, '$1,234.50'), (-2L, 'n/a'), (-3L, 'USD 99')", "id, s")
    return written.unionByName(odd).select("id", numeric.money(F.col("s")).alias("amount"))


@query("SELECT * FROM (VALUES (1, true, 'Swarm'), (2, false, 'Swarm')) t(id, a, b)")
def q_compound(spark, sf):
    return values(spark, "(1, 'Swarm', 'Joint Swarm'), (2, 'Swarm', 'Swarm Lab')", "id, bare, full").select("id", text.is_compound(F.col("bare"), F.col("full")).alias("a"), F.col("bare").alias("b"))


@query("SELECT o_orderkey AS id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%dh %02dm', s // 3600, s % 3600 // 60) END AS d, CASE WHEN h < 1 THEN 'just now' WHEN h < 48 THEN CAST(floor(h) AS INT) || 'h ago' ELSE CAST(floor(h / 24) AS INT) || 'd ago' END AS a FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 9000 AS s, o_custkey / 10.0 AS h FROM orders) UNION ALL SELECT -1, NULL, 'never'")
def q_formats(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") % 9000).alias("s"), (F.col("o_custkey") / 10).alias("h"))
    return rows.unionByName(values(spark, "(-1L, null, null)", "id, s, h")).select("id", text.duration(F.col("s")).alias("d"), text.ago(F.col("h")).alias("a"))


# ------------------------------------------------------------ sources and stores

@query("SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT 'awards' FROM range(3)) GROUP BY 1")
def q_source_union(spark, sf):
    return corpus.union_sources(corpus_documents(spark, sf), records.award_documents(_awards(spark))).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT 'Swarm' AS award_title")
def q_relevant_awards(spark, sf):
    return records.relevant_awards(_awards(spark).withColumn("research_area_keywords", F.when(F.col("firm") == "Acme", "drone swarms")), ["drone"]).select("award_title")


@query("SELECT 'a' AS content_hash, 1 AS n")
def q_relevant_sections(spark, sf):
    docs = values(spark, r"('a', 'RDT&E book\nPE 01 Alpha\ncake\nPE 02 Beta\n machine learning'), ('b', 'PE 03 Gamma\nmachine learning')", "content_hash, text")
    return records.relevant_sections(records.sections(docs, r"PE \d\d [A-Za-z]+"), docs, "RDT&E", ["machine learning"]).select("content_hash", "n")


@query("SELECT DISTINCT CAST(ts AS DATE) AS day FROM events ORDER BY 1 DESC LIMIT 5")
def q_history_tail(spark, sf):
    return records.tail(runs(spark, sf), 5).select("day")


@query("SELECT max(CAST(ts AS DATE)) AS date FROM events")
def q_latest_daily(spark, sf):
    return records.latest_daily(runs(spark, sf).select(F.col("day").alias("date")))


@query(G.SQL + "SELECT id, round(12 + 40 * sqrt(mention_count / (SELECT max(mention_count) FROM nodes)), 4) AS size FROM nodes")
def q_node_sizes(spark, sf):
    return records.html_graph(G.nodes(spark, sf)).select("id", "size")


@query(G.SQL + "SELECT id, canonical_name FROM nodes WHERE id = 7")
def q_alias_lookup(spark, sf):
    n = G.nodes(spark, sf)
    return stores.node_of_alias(n, n.where("id >= 7").select(F.lit("same").alias("alias"), F.col("id").alias("node_id")), "same").select("id", "canonical_name")


@query(G.SQL + "SELECT content_hash FROM bridge WHERE node_id = 4")
def q_documents_of_node(spark, sf):
    return stores.documents_of(G.bridge(spark, sf, G.nodes(spark, sf)), 4)


PLANS = "('e', array(named_struct('url', 'u', 'title', 'On drones', 'source', 's', 'published', '', 'html', '<p>drones fly</p>'), named_struct('url', 'v', 'title', 'Cake', 'source', 's', 'published', '', 'html', 'cake')), named_struct('title', 'Sum', 'body', 'cake', 'source', 'x')), ('f', array(named_struct('url', 'w', 'title', 'Cake', 'source', 's', 'published', '', 'html', 'cake')), named_struct('title', 'Sum', 'body', 'about drones', 'source', 'x')), ('g', array(named_struct('url', 'w', 'title', 'Cake', 'source', 's', 'published', '', 'html', 'cake')), null)"


@query("SELECT * FROM (VALUES ('e', true, 'article 1', 'drones'), ('f', true, 'synthesis', 'drones'), ('g', false, NULL, '')) t(entity, relevant, location, terms)")
def q_plan_gate(spark, sf):
    return records.plan_gate(values(spark, PLANS, "entity, articles, synthesis"), ["drones"]).withColumn("terms", F.array_join("terms", ","))


@query("SELECT * FROM (VALUES ('e', 'u', 'drones fly'), ('f', 'generated:' || sha256('f|about drones'), 'about drones')) t(entity, url, raw_text)")
def q_enrichment(spark, sf):
    known = spark.range(0).select(F.lit("").alias("content_hash"))
    return records.enrichment(values(spark, PLANS, "entity, articles, synthesis"), known, ["drones"]).select("entity", "url", "raw_text")


# ------------------------------------------------------------ graph and digests

@query(G.SQL + "SELECT relation <> 'co_occurs_with' AS typed, count(*) AS n, CAST(sum(CASE WHEN relation = 'co_occurs_with' THEN 0 ELSE 1 END) AS BIGINT) AS full_strength FROM edges GROUP BY 1")
def q_edge_accessors(spark, sf):
    e = G.edges(spark, sf).withColumn("typed", graph.is_typed()).withColumn("s", graph.edge_strength())
    return e.groupBy("typed").agg(F.count("*").alias("n"), F.sum(F.when(F.col("typed"), F.col("s").cast("long")).otherwise(0)).alias("full_strength"))


@query(G.SQL + "SELECT min(id) AS id FROM nodes WHERE lower(canonical_name) LIKE '%re%'")
def q_focus(spark, sf):
    return graph.find_focus(G.nodes(spark, sf), "re").select("id")


@query(G.SQL + "SELECT id FROM edges JOIN (SELECT id AS a, type AS ka FROM nodes) x ON x.a = src_id JOIN (SELECT id AS b, type AS kb FROM nodes) y ON y.b = dst_id WHERE (relation <> 'co_occurs_with' AND confidence >= 0.6 AND ka = 'person') OR (relation = 'co_occurs_with' AND strength >= 0.02 AND (ka = 'person' OR kb = 'person'))")
def q_evidence_filters(spark, sf):
    n = G.nodes(spark, sf)
    return graph.with_evidence(G.edges(spark, sf, n), n, 0.6, 0.02, "person").select("id")


@query(G.SQL + ", c AS (SELECT id, canonical_name FROM nodes WHERE type = 'concept' ORDER BY id LIMIT 1), near AS (SELECT id FROM c UNION SELECT dst_id FROM edges JOIN c ON src_id = c.id UNION SELECT src_id FROM edges JOIN c ON dst_id = c.id) SELECT (SELECT count(*) FROM near) AS nodes, (SELECT count(*) FROM edges WHERE src_id IN (SELECT id FROM near) AND dst_id IN (SELECT id FROM near)) AS edges, (SELECT count(*) FROM part JOIN c ON contains(lower(p_name || ' ' || p_brand), lower(canonical_name))) AS documents")
def q_subfield_scope(spark, sf):
    """The first concept, what it is linked to, and the parts that name it."""
    n = G.nodes(spark, sf)
    first = n.where("type = 'concept'").orderBy("id").limit(1).select(F.lit("Field").alias("subfield"), F.col("canonical_name").alias("concept"))
    docs = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("content_hash"), F.col("p_name").alias("title"), F.col("p_brand").alias("raw_text"))
    part = digest.scope(first, "field", n, G.edges(spark, sf, n), docs)
    return spark.range(1).select(*(part[k].agg(F.count("*").alias("n")).scalar().alias(k) for k in ("nodes", "edges", "documents")))


@query(G.SQL + "SELECT (SELECT count(*) FROM nodes WHERE first_seen >= DATE '1995-06-01' - 7) AS new_entities, 'Top' AS top_spike, CAST(1333.5 AS DOUBLE) AS funding")
def q_pulse(spark, sf):
    spikes = values(spark, "(1L, 'Low', 3.0D, 5L), (2L, 'Top', 4.0D, 5L)", "id, name, ratio, recent")
    docs = records.award_documents(_awards(spark)).withColumn("doc_date", F.lit("1995-06-01").cast("date"))
    return digest.pulse(G.nodes(spark, sf), spikes, docs, "1995-06-01")


@query(G.SQL + "SELECT content_hash FROM bridge JOIN d ON d.doc = content_hash WHERE node_id = 9 ORDER BY dt DESC, content_hash LIMIT 50")
def q_node_documents(spark, sf):
    docs = G.documents(spark, sf).withColumn("fetched_at", F.col("doc_date")).withColumn("raw_text", F.col("content_hash"))
    return digest.node_documents(docs, G.bridge(spark, sf, G.nodes(spark, sf)), 9).select("content_hash")


@query("WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-07-29' AND DATE '2001-08-01') SELECT CAST(o_orderkey AS VARCHAR) AS content_hash FROM t WHERE dt >= CASE WHEN (SELECT count(*) FROM t WHERE dt >= DATE '2001-07-31') > 0 THEN DATE '2001-07-31' ELSE DATE '2001-07-29' END ORDER BY dt DESC, content_hash LIMIT 18")
def q_recent_fallback(spark, sf):
    return temporal.recent_with_fallback(G.documents(spark, sf), "2001-08-01").select("content_hash")


@query(G.SQL + "SELECT id, row_number() OVER (ORDER BY coalesce(c, 0) DESC, id) AS r FROM nodes LEFT JOIN (SELECT id, count(*) AS c FROM ends WHERE relation <> 'co_occurs_with' GROUP BY 1) USING (id) QUALIFY r <= 10")
def q_typed_degree(spark, sf):
    n = G.nodes(spark, sf)
    top = n.join(graph.degree(G.edges(spark, sf, n)), "id", "left").select("id", F.coalesce("typed_degree", F.lit(0)).alias("t")).orderBy(F.desc("t"), "id").limit(10)
    return resolve.number(top.withColumn("neg", -F.col("t")), "neg", "id", name="r").select("id", "r")


# ------------------------------------------------------------ curation

@query("SELECT * FROM (VALUES ('a', 1, false), ('b', 0, false), ('c', 3, false), ('d', NULL, false)) t(content_hash, read_count, read_fresh)")
def q_invalidate_reading(spark, sf):
    return curation.invalidate_reading(values(spark, READ, "content_hash, read_count, read_fresh, last_read")).drop("last_read")


@query("SELECT * FROM (VALUES ('b', 1), ('d', 2), ('c', 3)) t(content_hash, doc_ord)")
def q_stale_reading(spark, sf):
    rows = values(spark, "('a', 0, 1, true, '2024-01-02'), ('b', 1, 0, false, null), ('c', 3, 3, false, '2024-01-05'), ('d', 2, null, null, null)", "content_hash, doc_ord, read_count, read_fresh, last_read")
    return quality.stale_reading(rows).select("content_hash", "doc_ord")


@query("SELECT * FROM (VALUES ('hegseth', 'pete hegseth'), ('lockheed', 'lockheed martin'), ('smith', 'a. smith')) t(src, dst)")
def q_partial_duplicates(spark, sf):
    return quality.partial_duplicates(people(spark), "first")


@query(f"WITH n(node_key, canonical_name, type, mention_count, document_count, email) AS (VALUES {PEOPLE}) SELECT node_key FROM n WHERE length(canonical_name) < 3")
def q_noise_suggestions(spark, sf):
    return curation.noise_suggestions(people(spark), values(spark, "('red')", "node_key")).select("node_key")


@query("SELECT 3 AS awards, 1 AS protected")
def q_protected_rows(spark, sf):
    docs = records.award_documents(_awards(spark))
    return docs.agg(F.count_if(curation.protected(F.col("metadata"))).alias("awards"), F.count_if(curation.protected(F.col("metadata")) & F.contains("title", F.lit("Swarm"))).alias("protected"))


@query()
def q_mentions_hybrid(spark, sf):
    """Gazetteer hits first, then other proper nouns that overlap none."""
    from graphloom.plans.registry import lexicon

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("content_hash"), F.col("doc_id").alias("doc_ord"), "text")
    return extract.mentions(docs, lexicon(spark))



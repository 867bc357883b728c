"""One query for each operator, with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import dates, numeric, text
from graphloom.operators import curation, digest, extract, graph, incremental, quality, resolve, temporal
from graphloom.plans import testgraph as G
from graphloom.session import cut, shared_dir, table
from graphloom.sources import corpus, feeds, records
from graphloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
AS_OF = "2001-08-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name without the leading q_."""

    def add(f: Query) -> Query:
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc_ord"), F.sha2("text", 256).alias("content_hash"), "source", F.left("text", F.lit(60)).alias("title"), F.col("text").alias("raw_text"))


# ------------------------------------------------------------ co-occurrence and roll-ups

@query(G.SQL + "SELECT a, b, weight FROM co")
def q_cooc_edges(spark, sf):
    return resolve.cooccurrence(G.mentions(spark, sf).select("content_hash", "node_key"))


@query(G.SQL + "SELECT a, b, weight, round_even(weight / (x.document_count + y.document_count - weight), 4) AS strength FROM co JOIN nodes x ON x.canonical_name = a JOIN nodes y ON y.canonical_name = b")
def q_cooc_strength(spark, sf):
    said = G.mentions(spark, sf)
    frequency = resolve.document_frequency(said).select(F.col("alias").alias("node_key"), F.col("df").alias("document_count"))
    return resolve.with_strength(resolve.cooccurrence(said.select("content_hash", "node_key")), frequency)


@query("WITH dk AS (SELECT DISTINCT l_orderkey AS doc, p_name AS k FROM lineitem JOIN part ON l_partkey = p_partkey), ok AS (SELECT doc FROM dk GROUP BY doc HAVING count(*) BETWEEN 2 AND 3) SELECT a.k AS a, b.k AS b, count(*) AS weight FROM dk a JOIN dk b ON a.doc = b.doc AND a.k < b.k WHERE a.doc IN (SELECT doc FROM ok) GROUP BY 1, 2")
def q_cooc_capped(spark, sf):
    return resolve.cooccurrence(G.mentions(spark, sf).select("content_hash", "node_key"), most=3)


@query("SELECT p_name AS alias, count(DISTINCT l_orderkey) AS df FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def q_doc_freq(spark, sf):
    return resolve.document_frequency(G.mentions(spark, sf))


@query(G.SQL + ", em AS (SELECT k, arg_max(replace(k, ' ', '.') || '.' || ln || '@x.org', ord * 100 + ln) AS email FROM m WHERE rf = 'R' GROUP BY 1) SELECT canonical_name AS node_key, canonical_name, type, first_seen, last_seen, mention_count, document_count, email FROM nodes LEFT JOIN em ON k = canonical_name")
def q_node_rollup(spark, sf):
    email = F.when(F.col("flag") == "R", F.concat(F.replace("node_key", F.lit(" "), F.lit(".")), F.lit("."), F.col("mention_ord").cast("string"), F.lit("@x.org")))
    return resolve.node_rollup(G.mentions(spark, sf).withColumn("email", email), G.documents(spark, sf))


@query(G.SQL + "SELECT id, src_id, dst_id, relation, weight, strength, confidence, source, evidence FROM edges")
def q_graph_edges(spark, sf):
    return G.make_edges(spark, sf, G.make_nodes(spark, sf))


# ------------------------------------------------------------ topic gate and ingestion

PHRASES, ACRONYMS = ("apache license", "the", "license"), ("AI", "LLM")
_TOPIC = r"(regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])(?:apache license|license|the)(?:$|[^\p{L}\p{N}_])') OR regexp_matches(text, '(?:^|[^\p{L}\p{N}_])(?:LLM|AI)(?:$|[^\p{L}\p{N}_])'))"


@query(f"SELECT doc_id FROM documents WHERE {_TOPIC}")
def q_topic_filter(spark, sf):
    return table(spark, sf, "documents").where(text.is_relevant(F.col("text"), PHRASES, ACRONYMS)).select("doc_id")


_ONE = r"regexp_matches({t}, '(?:^|[^\p{{L}}\p{{N}}_])(?:{p})(?:$|[^\p{{L}}\p{{N}}_])')"


@query("SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join([f"CASE WHEN {_ONE.format(t='lower(text)', p=p)} THEN '{p}' END" for p in PHRASES] + [f"CASE WHEN {_ONE.format(t='text', p=p)} THEN '{p}' END" for p in ACRONYMS]) + "], lambda x: x IS NOT NULL)), ',') AS terms FROM documents")
def q_topic_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.matched_terms(F.col("text"), PHRASES, ACRONYMS), ",").alias("terms"))


@query(f"SELECT source, count(*) AS dropped FROM documents WHERE NOT {_TOPIC} GROUP BY 1")
def q_topic_drop_by_source(spark, sf):
    return quality.drop_counts(table(spark, sf, "documents"), text.is_relevant(F.col("text"), PHRASES, ACRONYMS))


@query("WITH b AS (SELECT text AS t FROM benchmark) SELECT min(doc_id) AS doc_ord, sha256(text) AS content_hash FROM documents WHERE text NOT IN (SELECT t FROM b) GROUP BY text")
def q_ingest_dedup(spark, sf):
    known = table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("content_hash"))
    return corpus.new_documents(corpus_documents(spark, sf), known).select("doc_ord", "content_hash")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def q_ingest_cap(spark, sf):
    return corpus.cap(table(spark, sf, "documents"), 5, order="doc_id").select("source", "doc_id")


@query(f"SELECT source, count(*) AS fetched, count_if(r = 1) AS added, count_if(n_chars >= 400) AS extracted, count_if(NOT {_TOPIC}) AS filtered FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) GROUP BY 1")
def q_ingest_scorecard(spark, sf):
    d = table(spark, sf, "documents")
    first = F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")) == 1
    rows = d.select("source", first.alias("added"), (F.col("n_chars") >= 400).alias("extracted"), text.is_relevant(F.col("text"), PHRASES, ACRONYMS).alias("relevant"), F.lit(None).cast("string").alias("error"))
    return quality.ingest_scorecard(rows).drop("error")


# ------------------------------------------------------------ names

SURFACES = "('The U.S. Army''s Drones'), ('  Acme   Corp.  '), ('an Office of Things'), ('glass'), ('R&D labs'), ('Ground-based Systems'), ('the the Agency'), ('x=1/y'), ('Bus'), ('buses'), ('.')"
_NORMAL = r"regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(replace(regexp_replace(translate(lower(trim(s)), '’', ''''), '''s\b', '', 'g'), '.', ''), '[^\w\s&-]', ' ', 'g'), '\s+', ' ', 'g')), '^((the|an|a)\s+)+', ''), '(^|\s)(\S{3,}[^s\s])s$', '\1\2')"


@query(f"SELECT s, {_NORMAL} AS alias FROM (SELECT DISTINCT p_name AS s FROM part UNION ALL SELECT DISTINCT c_name FROM customer UNION ALL SELECT * FROM (VALUES {SURFACES}))")
def q_normalize_surface(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_name").alias("s")).distinct().unionByName(table(spark, sf, "customer").select(F.col("c_name").alias("s")).distinct()).unionByName(values(spark, SURFACES.replace("''", r"\'"), "s"))
    return rows.select("s", text.normalize(F.col("s")).alias("alias"))


NAMES = "(1, 'Ann Bee Contact : ann@bee.org Links: Paper'), (2, 'Cee Dee'), (3, 'ann@bee.org'), (4, 'Eff Gee, Email: e@f.gov'), (5, 'Website Keywords'), (6, 'A=2 B=3'), (7, '12')"


@query("SELECT * FROM (VALUES (1, 'Ann Bee', 'ann@bee.org', false, false), (2, 'Cee Dee', NULL, false, false), (3, 'ann@bee.org', 'ann@bee.org', false, false), (4, 'Eff Gee', 'e@f.gov', false, false), (5, 'Website Keywords', NULL, true, false), (6, 'A=2 B=3', NULL, false, true), (7, '12', NULL, false, false)) t(id, name, email, boilerplate, bad)")
def q_entity_attributes(spark, sf):
    s = F.col("s")
    return values(spark, NAMES, "id, s").select("id", text.entity_name(s).alias("name"), text.entity_email(s).alias("email"), text.has_boilerplate(text.entity_name(s)).alias("boilerplate"), text.has_bad_characters(s).alias("bad"))


REASONS = "(1, 'ab', 5, false), (2, 'https://x.y', 5, false), (3, '1234', 5, false), (4, 'GPT-4', 1, false), (5, 'GPT-4', 3, false), (6, 'GPT-4', 1, true), (7, 'Acme Corp', 1, false)"


@query("SELECT * FROM (VALUES (1, 'too short'), (2, 'url or handle'), (3, 'no letters'), (4, 'version tag'), (5, NULL), (6, NULL), (7, NULL)) t(id, reason)")
def q_noise_reasons(spark, sf):
    return values(spark, REASONS, "id, s, n, ok").select("id", text.noise_reason(F.col("s"), F.col("n"), F.col("ok")).alias("reason"))


# ------------------------------------------------------------ extraction

LEXICON = "('the', 'The Article', 'concept'), ('apache license', 'Apache License', 'product'), ('license', 'Licence', 'concept'), ('than', 'Than', 'misc')"


def lexicon(spark: SparkSession) -> DataFrame:
    return values(spark, LEXICON, "surface, canonical, type")


@query(r"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(' ' || regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g') || ' ', '(?i)[^\p{L}\p{N}_](apache[^\p{L}\p{N}_]+license|license|than|the)[^\p{L}\p{N}_]', 1)) AS s FROM documents)
SELECT CASE lower(regexp_replace(s, '\s+', ' ', 'g')) WHEN 'the' THEN 'The Article' WHEN 'license' THEN 'Licence' WHEN 'than' THEN 'Than' ELSE 'Apache License' END AS text, count(*) AS n FROM h WHERE (s LIKE '% %' AND regexp_matches(s, '(?i)^apache  license$')) OR regexp_matches(s, '^\p{Lu}') AND s NOT LIKE '% %' GROUP BY 1""")
def q_gazetteer_mentions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("content_hash"), "text")
    return extract.gazetteer_mentions(d, lexicon(spark)).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('a', 'Apache License', 'product', 8, 22), ('a', 'The Article', 'concept', 0, 3), ('b', 'Licence', 'concept', 4, 11), ('b', 'The Article', 'concept', 0, 3)) t(content_hash, text, label, start_char, end_char)")
def q_gazetteer_offsets(spark, sf):
    d = values(spark, "('a', 'The old apache license of the license.'), ('b', 'The-License other'), ('c', 'nothing here')", "content_hash, text")
    return extract.gazetteer_mentions(d, lexicon(spark))


@query()
def q_proper_nouns(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("content_hash"), "text")
    return extract.proper_noun_mentions(d)


@query("WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS content_hash, l_linenumber * 10 AS start_char, l_linenumber * 10 + CAST(l_quantity AS INT) AS end_char, l_returnflag AS f FROM lineitem) SELECT content_hash, start_char, end_char FROM a WHERE f = 'N' AND NOT EXISTS (SELECT 1 FROM a b WHERE b.f = 'R' AND b.content_hash = a.content_hash AND a.start_char < b.end_char AND b.start_char < a.end_char)")
def q_span_overlap_anti(spark, sf):
    start = F.col("l_linenumber") * 10
    spans = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("content_hash"), start.alias("start_char"), (start + F.col("l_quantity").cast("int")).alias("end_char"), F.col("l_returnflag").alias("f"))
    return extract.without_overlaps(spans.where("f = 'N'").drop("f"), spans.where("f = 'R'"))


#: What the relation query reads a gap for.
SALES = (extract.Cue("supplies", "sell/sold", "", "", ("organization",), ("product",)), extract.Cue("located_in", "stand/stood", "store depot", "in", ("organization",), ("place",)))


@query("""WITH l AS (SELECT DISTINCT s_name AS s, p_name AS p, n_name AS n, l_returnflag AS f, l_linestatus AS st FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
t AS (SELECT *, CASE f WHEN 'R' THEN s || ' sells the ' || p || '.' WHEN 'A' THEN 'The ' || p || ' was sold, as they say, by ' || s || '.' ELSE s || ' saw the ' || p || '. It sells well.' END AS head FROM l),
d AS (SELECT *, sha256(head || CASE WHEN st = 'F' THEN ' ' || s || ' has a depot in ' || n || '.' ELSE '' END) AS content_hash FROM t)
SELECT content_hash, s AS subject, 'supplies' AS relation, p AS object, CASE f WHEN 'A' THEN substr(head, 5) ELSE head END AS evidence FROM d WHERE f <> 'N'
UNION ALL SELECT content_hash, s, 'located_in', n, s || ' has a depot in ' || n || '.' FROM d WHERE st = 'F'""")
def q_relations_typed(spark, sf):
    """Lines of orders as texts of one or two sentences about supplier, part and nation, each text once."""
    l, p, s, n = (table(spark, sf, t) for t in ("lineitem", "part", "supplier", "nation"))
    line = l.join(p, F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    # What the text is made of travels instead of the text.
    kind = F.when(F.col("l_returnflag").isin("R", "A"), F.col("l_returnflag"))
    said_once = line.select("s_name", "p_name", "n_name", kind.alias("flag"), F.coalesce(F.col("l_linestatus") == "F", F.lit(False)).alias("more")).distinct()
    flag = F.col("flag")
    head = F.when(flag == "R", F.concat("s_name", F.lit(" sells the "), "p_name", F.lit("."))).when(flag == "A", F.concat(F.lit("The "), "p_name", F.lit(" was sold, as they say, by "), "s_name", F.lit("."))).otherwise(F.concat("s_name", F.lit(" saw the "), "p_name", F.lit(". It sells well.")))
    tail = F.when(F.col("more"), F.concat(F.lit(" "), "s_name", F.lit(" has a depot in "), "n_name", F.lit("."))).otherwise("")
    docs = said_once.select(F.sha2(F.concat(head, tail), 256).alias("content_hash"), F.concat(head, tail).alias("text"), F.length(head).alias("head"), "s_name", "p_name", "n_name", "more")
    at = lambda name, label, start: F.struct(F.col(name).alias("text"), F.lit(label).alias("label"), start.cast("int").alias("start_char"), (start + F.length(name)).cast("int").alias("end_char"))
    once = [at("s_name", "organization", F.expr("locate(s_name, text)") - 1), at("p_name", "product", F.expr("locate(p_name, text)") - 1)]
    later = [at("s_name", "organization", F.col("head") + 1), at("n_name", "place", F.length("text") - F.length("n_name") - 1)]
    said = docs.select("content_hash", F.explode(F.when(F.col("more"), F.array(*once, *later)).otherwise(F.array(*once))).alias("m")).select("content_hash", "m.*")
    return extract.relations(docs.select("content_hash", "text"), said, SALES).drop("s1", "s2")


@query("SELECT upper(left(p_name, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) AS acronym, p_name AS expansion, count(*) AS documents FROM part GROUP BY p_name HAVING count(*) > 1")
def q_acronym_pairs(spark, sf):
    """Each part as a text that defines its name's initials, in brackets behind or before it."""
    p = table(spark, sf, "part")
    letters = F.upper(F.concat(F.left("p_name", F.lit(1)), F.substr(F.split("p_name", " ")[1], F.lit(1), F.lit(1))))
    said = F.when(F.col("p_size") > 25, F.concat(F.lit("They sell the "), "p_name", F.lit(" ("), letters, F.lit(") here."))).otherwise(F.concat(F.lit("They sell the "), letters, F.lit(" ("), "p_name", F.lit(") here.")))
    return extract.acronyms(p.select(F.col("p_partkey").alias("doc_ord"), said.alias("text")))


# ------------------------------------------------------------ incremental

_AMENDED = """WITH m AS (SELECT DISTINCT l_orderkey AS d, CASE WHEN p_name = (SELECT min(p_name) FROM part) THEN (SELECT max(p_name) FROM part) ELSE p_name END AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
n AS (SELECT k, count(*) AS n FROM m GROUP BY k), ok AS (SELECT d FROM m GROUP BY d HAVING count(*) BETWEEN 2 AND 60)"""


def amended(spark: SparkSession, sf_dir: str) -> str:
    """The state of three runs: orders up to 1997, later ones, then a correction that folds the first part name into the last."""
    root = f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}"
    rows = cut(G.mentions(spark, sf_dir).drop("text", "flag").join(G.documents(spark, sf_dir).select("content_hash", "doc_date"), "content_hash"))
    for some in ("doc_date < '1998-01-01'", "doc_date >= '1998-01-01' or doc_date is null"):
        incremental.take(spark, root, rows.where(some), G.documents(spark, sf_dir).where(some).select("content_hash"))
    low, high = table(spark, sf_dir, "part").agg(F.min("p_name"), F.max("p_name")).first()
    about = rows.where(F.col("node_key") == low).select("content_hash").distinct()
    folded = rows.join(about, "content_hash", "left_semi").withColumns({c: F.when(F.col(c) == low, high).otherwise(F.col(c)) for c in ("alias", "canonical", "node_key")})
    incremental.take(spark, root, folded, about)
    return root


@query(_AMENDED + " , co AS (SELECT x.k AS a, y.k AS b, count(*) AS weight FROM m x JOIN m y ON x.d = y.d AND x.k < y.k WHERE x.d IN (SELECT d FROM ok) GROUP BY 1, 2) SELECT a, b, weight, round_even(weight / (na.n + nb.n - weight), 4) AS strength FROM co JOIN n na ON na.k = a JOIN n nb ON nb.k = b")
def q_incremental_edges(spark, sf):
    root = amended(spark, sf)
    return incremental.edges(spark, root, incremental.rollups(spark, root))


@query("""WITH m AS (SELECT l_orderkey AS d, CAST(o_orderdate AS DATE) AS dt, CASE WHEN p_name = (SELECT min(p_name) FROM part) THEN (SELECT max(p_name) FROM part) ELSE p_name END AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
SELECT k AS node_key, count(*) AS mention_count, count(DISTINCT d) AS document_count, min(dt) AS first_seen, max(dt) AS last_seen FROM m GROUP BY k""")
def q_incremental_nodes(spark, sf):
    return incremental.rollups(spark, amended(spark, sf)).select("node_key", "mention_count", "document_count", "first_seen", "last_seen")


# ------------------------------------------------------------ resolution

PEOPLE = "('pete hegseth', 'Pete Hegseth', 'person', 9, 5, 'pete@x.gov'), ('hegseth', 'Hegseth', 'person', 3, 2, NULL), ('lockheed martin', 'Lockheed Martin', 'organization', 8, 4, NULL), ('lockheed', 'Lockheed', 'organization', 2, 2, NULL), ('ann smith', 'Ann Smith', 'person', 4, 3, 'a@b.org'), ('bob smith', 'Bob Smith', 'person', 4, 3, NULL), ('smith', 'Smith', 'person', 2, 1, NULL), ('a. smith', 'A. Smith', 'person', 1, 1, 'A@b.org'), ('press one', 'Press One', 'person', 3, 1, 'press@b.org'), ('press two', 'Press Two', 'person', 3, 1, 'press@b.org'), ('red', 'Red', 'organization', 2, 2, NULL), ('red hat', 'Red Hat', 'organization', 2, 2, NULL), ('designs', 'designs', 'misc', 3, 3, NULL), ('vision', 'Vision', 'misc', 1, 1, NULL), ('darpa', 'DARPA', 'organization', 1, 1, NULL)"
_PEOPLE = f"WITH n(node_key, canonical_name, type, mention_count, document_count, email) AS (VALUES {PEOPLE})"


def people(spark: SparkSession) -> DataFrame:
    return values(spark, PEOPLE, "node_key, canonical_name, type, mention_count, document_count, email")


@query(_PEOPLE + ", w AS (SELECT *, string_split(canonical_name, ' ') AS p FROM n), l AS (SELECT type, lower(CASE type WHEN 'person' THEN p[-1] ELSE p[1] END) AS t, min(node_key) AS dst, count(*) AS c FROM w WHERE len(p) > 1 AND type IN ('person', 'organization') GROUP BY 1, 2) SELECT node_key AS src, dst FROM w JOIN l ON w.type = l.type AND lower(p[1]) = t AND c = 1 WHERE len(p) = 1 AND (w.type = 'person' OR length(p[1]) >= 4)")
def q_coref_unique(spark, sf):
    return resolve.unique_partial_names(people(spark))


@query(_PEOPLE + ", m AS (SELECT *, lower(email) AS mail FROM n WHERE type = 'person' AND email IS NOT NULL AND split_part(lower(email), '@', 1) NOT IN ('press', 'info')), b AS (SELECT mail, arg_max(node_key, mention_count * 1000 + length(canonical_name)) AS dst FROM m GROUP BY 1) SELECT node_key AS src, dst FROM m JOIN b USING (mail) WHERE node_key <> dst")
def q_coref_email(spark, sf):
    return resolve.shared_email(people(spark))


@query("SELECT 'n' || n_nationkey AS src, 'n24' AS dst FROM nation WHERE n_nationkey < 24 UNION ALL SELECT 'r' || r_regionkey, 'r0' FROM region WHERE r_regionkey > 0")
def q_merge_chain(spark, sf):
    """A chain over all nations, and a cycle over all regions, which ends in its smallest member."""
    n, r = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf, "region").select(F.col("r_regionkey").alias("k"))
    name = lambda c, k: F.concat(F.lit(c), k.cast("string"))
    chain = n.where("k < 24").select(name("n", F.col("k")).alias("src"), name("n", F.col("k") + 1).alias("dst"))
    return resolve.closed(chain.unionByName(r.select(name("r", F.col("k")).alias("src"), name("r", (F.col("k") + 1) % 5).alias("dst"))))


@query(f"WITH e AS (SELECT p_brand AS a, p_type AS b, count(*) AS weight FROM part GROUP BY 1, 2), m(src, dst) AS (VALUES ('Brand#11', 'Brand#12'), ('Brand#12', 'Brand#13'), ('Brand#13', 'Brand#14')), x AS (SELECT CASE WHEN a IN (SELECT src FROM m) THEN 'Brand#14' ELSE a END AS x, b AS y, weight FROM e) SELECT least(x, y) AS a, greatest(x, y) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM x WHERE x <> y GROUP BY 1, 2")
def q_merge_edges(spark, sf):
    e = table(spark, sf, "part").groupBy(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).agg(F.count("*").alias("weight"))
    return resolve.merge_edges(e, resolve.closed(values(spark, "('Brand#11', 'Brand#12'), ('Brand#12', 'Brand#13'), ('Brand#13', 'Brand#14')", "src, dst")))


@query(_PEOPLE + " SELECT node_key FROM n WHERE canonical_name LIKE '% %' OR node_key = 'darpa' OR (regexp_matches(canonical_name, '^[A-Z]') AND document_count >= 2)")
def q_prune_weak(spark, sf):
    return resolve.prune_weak(people(spark), values(spark, "('DARPA')", "canonical")).select("node_key")


@query(_PEOPLE + " SELECT node_key FROM n WHERE canonical_name LIKE '% %' AND type = 'person' AND document_count >= 3 AND mention_count >= 4 AND node_key <> 'ann smith'")
def q_curation_candidates(spark, sf):
    misc = people(spark).withColumn("type", F.when(F.col("type") == "person", "misc").otherwise("typed"))
    return curation.candidates(misc, values(spark, "('ann smith')", "node_key"), 3, 4).select("node_key")


@query("SELECT * FROM (VALUES ('darpa', 'DARPA', 'organization', 1, 1), ('navy drone', 'Navy Drones', 'organization', 3, 2)) t(node_key, canonical_name, type, mention_count, document_count)")
def q_keyed_mentions(spark, sf):
    rows = values(spark, r"('d1', 1, 1, 'the Navy Drones', 'organization'), ('d1', 1, 2, 'Website Keywords', 'misc'), ('d2', 2, 1, 'Navy Drone\'s', 'misc'), ('d2', 2, 2, 'Vision', 'misc'), ('d2', 2, 3, 'N.L.B.', 'misc'), ('d3', 3, 1, 'DARPA', 'organization'), ('d3', 3, 2, 'x', 'person'), ('d3', 3, 3, 'News', 'organization')", "content_hash, doc_ord, mention_ord, text, label")
    fixes = values(spark, "('merge', 'N.L.B.', 'NavyD'), ('merge', 'NavyD', 'Navy Drone'), ('ignore', 'Reuters', null)", "kind, surface, canonical")
    return resolve.node_rollup(resolve.keyed_mentions(rows, fixes)).select("node_key", "canonical_name", "type", "mention_count", "document_count")


@query()
def q_rebuild(spark, sf):
    """The whole way from documents to a graph; returns its nodes."""
    docs = cut(corpus.first_of_each(corpus_documents(spark, sf)).select("content_hash", "doc_ord", text.document_text(F.col("title"), F.col("raw_text")).alias("text")))
    found = cut(extract.mentions(docs, lexicon(spark)))
    keyed = resolve.keyed_mentions(found)
    dated = docs.select("content_hash", "doc_ord", F.lit(None).cast("date").alias("doc_date"))
    return resolve.graph(keyed, extract.relations(docs, found), dated)["nodes"].drop("first_seen", "last_seen")


# ------------------------------------------------------------ graph

@query(G.SQL + "SELECT n.id, canonical_name, count(*) AS degree FROM ends JOIN nodes n ON n.id = ends.id GROUP BY 1, 2 ORDER BY degree DESC, n.id LIMIT 10")
def q_degree_topk(spark, sf):
    n = G.nodes(spark, sf)
    return graph.most_connected(n, G.edges(spark, sf, n))


@query(G.SQL + "SELECT id, canonical_name, mention_count FROM nodes ORDER BY mention_count DESC, id LIMIT 10")
def q_top_nodes(spark, sf):
    return graph.top_nodes(G.nodes(spark, sf), 10).select("id", "canonical_name", "mention_count")


@query(G.SQL + "SELECT id FROM nodes WHERE id NOT IN (SELECT src_id FROM edges WHERE weight >= 40 UNION SELECT dst_id FROM edges WHERE weight >= 40)")
def q_isolated(spark, sf):
    n = G.nodes(spark, sf)
    return graph.isolated(n, G.edges(spark, sf, n).where("weight >= 40")).select("id")


_RANK = ", td AS (SELECT id, count(*) AS t FROM ends WHERE relation <> 'co_occurs_with' GROUP BY 1), dg AS (SELECT id, count(*) AS g FROM ends GROUP BY 1), keep AS (SELECT id FROM nodes LEFT JOIN td USING (id) LEFT JOIN dg USING (id) ORDER BY coalesce(t, 0) DESC, coalesce(g, 0) DESC, mention_count DESC, id LIMIT 12)"


@query(G.SQL + _RANK + " SELECT id FROM keep")
def q_subgraph_nodes(spark, sf):
    n = G.nodes(spark, sf)
    return graph.subgraph(n, G.edges(spark, sf, n), max_nodes=12)[0].select("id")


@query(G.SQL + _RANK + " SELECT id, src_id, dst_id, relation, weight FROM edges WHERE src_id IN (SELECT id FROM keep) AND dst_id IN (SELECT id FROM keep) AND (relation <> 'co_occurs_with' OR weight >= 2)")
def q_subgraph_edges(spark, sf):
    n = G.nodes(spark, sf)
    return graph.subgraph(n, G.edges(spark, sf, n), max_nodes=12)[1].select("id", "src_id", "dst_id", "relation", "weight")


@query(G.SQL + ", f AS (SELECT min(id) AS c FROM nodes WHERE lower(canonical_name) LIKE '%e%'), s AS (SELECT CASE WHEN src_id = c THEN dst_id ELSE src_id END AS id, max(CASE WHEN relation = 'co_occurs_with' THEN strength ELSE 1.0 END) AS sc FROM edges, f WHERE (src_id = c OR dst_id = c) AND src_id <> dst_id AND (relation <> 'co_occurs_with' OR weight >= 2) AND (relation = 'co_occurs_with' OR confidence >= 0.6) GROUP BY 1) SELECT c AS id FROM f UNION ALL (SELECT id FROM s ORDER BY sc DESC, id LIMIT 9)")
def q_subgraph_focus(spark, sf):
    n = G.nodes(spark, sf)
    return graph.subgraph(n, G.edges(spark, sf, n), focus="e", max_nodes=10, min_confidence=0.6)[0].select("id")


@query(G.SQL + ", x AS (SELECT e.* FROM edges e JOIN nodes a ON a.id = src_id JOIN nodes b ON b.id = dst_id WHERE relation <> 'co_occurs_with' AND a.type = 'organization' AND b.type = 'concept'), td AS (SELECT id, count(*) AS t FROM (SELECT src_id AS id FROM x UNION ALL SELECT dst_id FROM x) GROUP BY 1), dg AS (SELECT id, count(*) AS g FROM ends GROUP BY 1), keep AS (SELECT id FROM nodes JOIN td USING (id) LEFT JOIN dg USING (id) ORDER BY t DESC, g DESC, mention_count DESC, id LIMIT 15) SELECT id, src_id, dst_id, relation FROM x WHERE src_id IN (SELECT id FROM keep) AND dst_id IN (SELECT id FROM keep)")
def q_subgraph_typed(spark, sf):
    n = G.nodes(spark, sf)
    return graph.subgraph(n, G.edges(spark, sf, n), max_nodes=15, relations_only=True, src_type="organization", dst_type="concept")[1].select("id", "src_id", "dst_id", "relation")


@query(G.SQL + "SELECT dst_id AS other_id, n.canonical_name AS name, n.type, 'out' AS direction, relation, weight, confidence, evidence FROM edges JOIN nodes n ON n.id = dst_id WHERE src_id = 5 UNION ALL SELECT src_id, n.canonical_name, n.type, 'in', relation, weight, confidence, evidence FROM edges JOIN nodes n ON n.id = src_id WHERE dst_id = 5")
def q_neighbours(spark, sf):
    n = G.nodes(spark, sf)
    return graph.neighbours(n, G.edges(spark, sf, n), 5)


@query(G.TRADE + " SELECT y.b AS id, canonical_name AS name, type, count(*) AS shared_neighbors FROM u x JOIN u y ON x.b = y.a JOIN nodes n ON n.id = y.b WHERE x.a = 5 AND y.b <> 5 AND y.b NOT IN (SELECT b FROM u WHERE a = 5) GROUP BY 1, 2, 3 ORDER BY shared_neighbors DESC, y.b LIMIT 6")
def q_adjacent(spark, sf):
    """What lies two hops from a nation."""
    return graph.adjacent(G.trade_nodes(spark, sf), G.trade_edges(spark, sf), 5)


@query(G.TRADE + " SELECT x.a AS a, y.b AS b, count(*) AS shared FROM u x JOIN u y ON x.b = y.a JOIN nodes n ON n.id = x.a WHERE n.type = 'place' AND x.a <> y.b AND NOT EXISTS (SELECT 1 FROM u z WHERE z.a = x.a AND z.b = y.b) GROUP BY 1, 2")
def q_two_hop_pairs(spark, sf):
    """What lies two hops from every nation."""
    return graph.two_hop_pairs(G.trade_edges(spark, sf), G.trade_nodes(spark, sf).where("type = 'place'").select("id"))


@query(G.TRADE + """, far AS (SELECT max(id) AS node, 0 AS d FROM nodes WHERE type = 'concept' UNION SELECT u.b, d + 1 FROM far JOIN u ON u.a = node WHERE d < 8),
left_over AS (SELECT node, min(d) AS d FROM far GROUP BY 1),
walk AS (SELECT 0 AS step, CAST(NULL AS BIGINT) AS from_id, min(id) AS to_id, CAST(NULL AS BIGINT) AS edge_id, CAST(NULL AS VARCHAR) AS relation FROM nodes WHERE type = 'concept'
  UNION ALL (SELECT w.step + 1, w.to_id, u.b, u.id, u.relation FROM walk w JOIN left_over h ON h.node = w.to_id JOIN u ON u.a = w.to_id JOIN left_over n ON n.node = u.b AND n.d = h.d - 1 QUALIFY row_number() OVER (ORDER BY u.relation = 'co_occurs_with', u.id) = 1))
SELECT * FROM walk WHERE step > 0""")
def q_shortest_path(spark, sf):
    """From the first region to the last."""
    ends = table(spark, sf, "region").agg(F.min("r_regionkey") * 4, F.max("r_regionkey") * 4).first()
    return graph.shortest_path(G.trade_edges(spark, sf), *ends)


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 5) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), w AS (SELECT 0 AS node, 0 AS d UNION SELECT b, d + 1 FROM w JOIN u ON a = node WHERE d < 8) SELECT CAST(min(d) AS BIGINT) AS hops FROM w WHERE node = 11")
def q_path_length(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    e = n.select("k", F.explode(F.array(F.lit(5), F.lit(7))).alias("s")).select((F.col("k") * 2 + F.when(F.col("s") == 7, 1).otherwise(0)).alias("id"), F.col("k").alias("src_id"), ((F.col("k") + F.col("s")) % 25).alias("dst_id"), F.lit("co_occurs_with").alias("relation"))
    return graph.shortest_path(e, 0, 11).agg(F.count("*").alias("hops"))


@query(G.SQL + "SELECT id, canonical_name FROM nodes WHERE id = (SELECT id FROM nodes WHERE lower(canonical_name) LIKE '%re%' ORDER BY mention_count DESC, id LIMIT 1)")
def q_resolve_name(spark, sf):
    return graph.resolve_name(G.nodes(spark, sf), "RE").select("id", "canonical_name")


@query(G.SQL + ", s AS (SELECT 't' AS tour, 1 AS stop, (SELECT upper(min(p_name)) FROM part) AS name UNION ALL SELECT 't', 2, 'x' UNION ALL SELECT 'u', 1, (SELECT max(p_name) FROM part)) SELECT tour, stop, name, (SELECT min(id) FROM nodes WHERE lower(canonical_name) = lower(name)) AS id FROM s")
def q_tour(spark, sf):
    ends = table(spark, sf, "part").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    tours = ends.select(F.explode(F.array(F.struct(F.lit("t").alias("tour"), F.array(F.upper("a"), F.lit("x")).alias("names")), F.struct(F.lit("u").alias("tour"), F.array("b").alias("names")))).alias("t")).select("t.*")
    return graph.tour(tours, G.nodes(spark, sf))


# ------------------------------------------------------------ time

@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders GROUP BY 1")
def q_monthly_volume(spark, sf):
    return temporal.monthly_volume(G.documents(spark, sf))


@query(G.SQL + f", g AS (SELECT strftime(unnest(generate_series(DATE '2000-09-01', DATE '2001-08-01', INTERVAL 1 MONTH)), '%Y-%m') AS month), dm AS (SELECT strftime(dt, '%Y-%m') AS month, count(*) AS c FROM d GROUP BY 1), nm AS (SELECT strftime(first_seen, '%Y-%m') AS month, count(*) AS c FROM nodes GROUP BY 1), em AS (SELECT strftime(dt, '%Y-%m') AS month, count(*) AS c FROM edges JOIN d ON source = d.doc WHERE relation <> 'co_occurs_with' GROUP BY 1) SELECT g.month, coalesce(dm.c, 0) AS documents, coalesce(nm.c, 0) AS new_entities, coalesce(em.c, 0) AS typed_relations FROM g LEFT JOIN dm USING (month) LEFT JOIN nm USING (month) LEFT JOIN em USING (month)")
def q_trajectory(spark, sf):
    n = G.nodes(spark, sf)
    return temporal.trajectory(G.documents(spark, sf), n, G.edges(spark, sf, n), AS_OF).select("month", "documents", "new_entities", "typed_relations")


@query(G.SQL + "SELECT id, canonical_name, first_seen FROM nodes ORDER BY first_seen DESC, id LIMIT 15")
def q_new_entities(spark, sf):
    return temporal.newest(G.nodes(spark, sf)).select("id", "canonical_name", "first_seen")


@query(G.SQL + "SELECT id, canonical_name, last_seen FROM nodes ORDER BY last_seen DESC, mention_count DESC, id LIMIT 15")
def q_active_entities(spark, sf):
    return temporal.active(G.nodes(spark, sf)).select("id", "canonical_name", "last_seen")


@query(G.SQL + f"SELECT 'documents' AS what, count(*) AS n FROM d WHERE dt >= DATE '{AS_OF}' - 30 UNION ALL SELECT 'new_entities', count(*) FROM nodes WHERE first_seen >= DATE '{AS_OF}' - 30 UNION ALL SELECT 'active_entities', count(*) FROM nodes WHERE last_seen >= DATE '{AS_OF}' - 30")
def q_recent_totals(spark, sf):
    return temporal.recent(G.documents(spark, sf), G.nodes(spark, sf), AS_OF, days=30)["totals"]


_CUST = "FROM orders JOIN customer ON o_custkey = c_custkey"


def _customers(spark, sf):
    docs = G.documents(spark, sf)
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    known = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"), F.lit("organization").alias("type"), F.lit(None).cast("date").alias("first_seen"))
    return docs, known, o.select(F.col("o_custkey").alias("node_id"), F.col("o_orderkey").cast("string").alias("content_hash"))


@query(f"WITH x AS (SELECT c_custkey AS id, c_name AS name, CAST(o_orderdate AS DATE) AS dt {_CUST} WHERE CAST(o_orderdate AS DATE) <= DATE '2000-01-01'), g AS (SELECT id, name, count(*) AS total, count_if(dt >= DATE '2000-01-01' - 180) AS recent, DATE '2000-01-01' - min(dt) AS span FROM x GROUP BY 1, 2) SELECT id, name, recent, round_even(total * 180 / span, 2) AS baseline, round_even(recent / (total * 180 / span), 2) AS ratio FROM g WHERE recent >= 2 AND span >= 60 AND recent / (total * 180 / span) >= 1.5 ORDER BY ratio DESC, recent DESC, id LIMIT 20")
def q_spikes(spark, sf):
    docs, known, link = _customers(spark, sf)
    return temporal.spikes(docs, known, link, "2000-01-01", 180, 2, 1.5).select("id", "name", "recent", "baseline", "ratio")


@query(f"WITH x AS (SELECT o_custkey AS node_id, CAST(o_orderdate AS DATE) AS dt FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2000-01-01'), g AS (SELECT node_id, count_if(dt >= DATE '2000-01-01' - 300) AS recent, count_if(dt < DATE '2000-01-01' - 300 AND dt >= DATE '2000-01-01' - 600) AS prior FROM x GROUP BY 1) SELECT *, CASE WHEN recent < 3 THEN 'too few mentions' WHEN recent >= 1.5 * prior THEN 'rising' WHEN 1.5 * recent <= prior THEN 'cooling' ELSE 'steady' END AS label FROM g")
def q_momentum(spark, sf):
    docs, _, link = _customers(spark, sf)
    return temporal.momentum(docs, link, "2000-01-01", 300)


@query(G.SQL + "SELECT strftime(dt, '%Y-%m') AS month, count(*) AS count FROM bridge JOIN d ON d.doc = content_hash WHERE node_id = 3 GROUP BY 1")
def q_node_monthly(spark, sf):
    n = G.nodes(spark, sf)
    return temporal.node_monthly(G.documents(spark, sf), G.bridge(spark, sf, n), 3)


# ------------------------------------------------------------ quality

@query("SELECT p_brand, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM part GROUP BY 1")
def q_type_share(spark, sf):
    return quality.share(table(spark, sf, "part"), "p_brand")


RANGES = ((1000.0, "small"), (50000.0, "medium"), (200000.0, "large"), (9e9, "huge"), (None, "rest"))


@query("SELECT position, label, (SELECT count(*) FROM orders WHERE o_totalprice > lo AND o_totalprice <= hi) AS n FROM (VALUES (0, 'small', -1e18, 1000), (1, 'medium', 1000, 50000), (2, 'large', 50000, 200000), (3, 'huge', 200000, 9e9), (4, 'rest', 9e9, 1e18)) t(position, label, lo, hi)")
def q_bucket_dist(spark, sf):
    return numeric.distribution(table(spark, sf, "orders"), F.col("o_totalprice"), RANGES)


@query(G.SQL + "SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM m) AS entities, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE relation <> 'co_occurs_with') AS typed_relations, (SELECT round_even((SELECT count(*) FROM m) / (SELECT count(*) FROM nodes), 2)) AS mentions_per_node, (SELECT count(*) FROM nodes WHERE mention_count = 1) AS singletons, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM ends)) AS isolated, (SELECT round_even(100.0 * count_if(mention_count = 1) / count(*), 1) FROM nodes) AS singleton_pct, (SELECT round_even(100.0 * count_if(id NOT IN (SELECT id FROM ends)) / count(*), 1) FROM nodes) AS isolated_pct")
def q_overview(spark, sf):
    n = G.nodes(spark, sf)
    return quality.overview(G.documents(spark, sf), G.mentions(spark, sf), n, G.edges(spark, sf, n))


DATES = "('a', 'Wed, 02 Oct 2024 13:00:00 GMT'), ('a', '2024-10-02T13:00:00Z'), ('a', '2024-10-02'), ('a', '2024'), ('b', 'FY2026'), ('b', ''), ('b', NULL), ('b', '2 Jan 2023 00:00:00 +0900'), ('c', '2024-13-45'), ('c', 'yesterday')"


@query("SELECT source, documents, parsed, missing, unparseable, CAST(pct AS DOUBLE) AS unparseable_pct FROM (VALUES ('c', 2, 0, 0, 2, 100.0), ('b', 4, 1, 2, 1, 25.0), ('a', 4, 4, 0, 0, 0.0), (NULL, 10, 5, 2, 3, 30.0)) t(source, documents, parsed, missing, unparseable, pct)")
def q_date_quality(spark, sf):
    return quality.date_quality(values(spark, DATES, "source, published"))


@query("SELECT * FROM (VALUES (1, DATE '2024-10-02'), (2, DATE '2024-10-02'), (3, DATE '2024-01-01'), (4, DATE '2023-01-02'), (5, DATE '2020-05-05'), (6, NULL)) t(id, day)")
def q_effective_dates(spark, sf):
    rows = values(spark, "(1, 'Wed, 02 Oct 2024 23:00:00 -0500', 'x'), (2, '2024-10-02T23:00:00-05:00', 'x'), (3, '2024', 'x'), (4, '2 Jan 2023 00:00:00 +0900', 'x'), (5, 'FY2026', '2020-05-05T01:02:03'), (6, '', '')", "id, p, f")
    return rows.select("id", dates.effective_date(F.col("p"), F.col("f")).alias("day"))


_RUNS = "SELECT CAST(ts AS DATE) AS day, event_type AS source, count(*) AS fetched, count_if(value > 50) AS added FROM events GROUP BY 1, 2"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run for each day; event types are feeds, and one fails on some days."""
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("source"), "value")
    each = e.groupBy("day", "source").agg(F.count("*").alias("fetched"), F.count_if(F.col("value") > 50).alias("added"))
    error = F.when(F.col("fetched") % 3 == 0, F.concat(F.lit("timeout "), F.col("fetched").cast("string")))
    feed = F.struct(F.col("fetched"), F.col("added"), F.col("fetched").alias("extracted"), F.lit(0).cast("long").alias("filtered"), error.alias("error"))
    return each.groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", feed.alias("f"))))).alias("feeds"), F.sum("fetched").alias("documents"), F.sum("added").alias("entities")).withColumn("finished_at", F.col("day").cast("timestamp"))


@query(f"WITH r AS ({_RUNS}), l AS (SELECT DISTINCT day FROM r ORDER BY day DESC LIMIT 14) SELECT source, count(*) AS failures, max(day) AS last_failure, arg_max('timeout ' || fetched, day) AS error FROM r WHERE day IN (SELECT day FROM l) AND fetched % 3 = 0 GROUP BY 1")
def q_broken_sources(spark, sf):
    return quality.broken_sources(runs(spark, sf), 14).withColumn("last_failure", F.to_date("last_failure"))


@query(f"WITH r AS ({_RUNS}), l AS (SELECT DISTINCT day FROM r ORDER BY day DESC LIMIT 14), a AS (SELECT source, count_if(added > 0) AS n FROM r WHERE day IN (SELECT day FROM l) GROUP BY 1), h AS (SELECT event_type AS source, count(*) AS documents, max(ts) AS t FROM events GROUP BY 1) SELECT source, documents, n AS runs_with_adds, (t < TIMESTAMP '2024-01-17 00:00:00') AND n = 0 AS stale FROM h JOIN a USING (source)")
def q_source_health(spark, sf):
    docs = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("fetched_at"))
    return quality.source_health(docs, runs(spark, sf), "2024-01-31").select("source", "documents", "runs_with_adds", "stale")


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS documents, count_if(value > 50) AS entities FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 2), x AS (SELECT 'documents' AS kpi, arg_min(documents, day) AS p, arg_max(documents, day) AS c FROM d UNION ALL SELECT 'entities', arg_min(entities, day), arg_max(entities, day) FROM d) SELECT kpi, CAST(p AS DOUBLE) AS previous, CAST(c AS DOUBLE) AS current, CAST(c - p AS DOUBLE) AS delta, round_even(100.0 * (c - p) / p, 1) AS pct, abs(round_even(100.0 * (c - p) / p, 1)) >= 10 AS flagged FROM x")
def q_run_diff(spark, sf):
    return quality.run_diff(runs(spark, sf), ("documents", "entities"))


@query("WITH x AS (SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1), y AS (SELECT 'no mentions' AS kind, * FROM x WHERE text NOT LIKE '%the%' UNION ALL SELECT 'short body', * FROM x WHERE length(text) BETWEEN 1 AND 299), z AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS r FROM y) SELECT kind, count(*) AS n, string_agg(sha256(text), ',' ORDER BY r) FILTER (r <= 5) AS examples FROM z GROUP BY 1")
def q_signal_coverage(spark, sf):
    docs = corpus.first_of_each(corpus_documents(spark, sf))
    return quality.signal_coverage(docs, docs.where(F.contains("raw_text", F.lit("the"))).select("content_hash")).withColumn("examples", F.array_join("examples", ","))


READ = "('a', 1, true, '2024-01-02'), ('b', 0, false, NULL), ('c', 3, false, '2024-01-05'), ('d', NULL, NULL, NULL)"


@query("SELECT 4 AS documents, 2 AS ever, 1 AS fresh, 1 AS stale, 2 AS never, 4 AS reads, '2024-01-05' AS last_read")
def q_reading(spark, sf):
    return quality.reading(values(spark, READ, "content_hash, read_count, read_fresh, last_read"))


# ------------------------------------------------------------ digest

@query(G.SQL + ", s AS (SELECT id, canonical_name, mention_count, substr(canonical_name, 1, 1) AS subfield FROM nodes WHERE type = 'concept'), b AS (SELECT src_id AS id, dst_id AS o, weight FROM edges UNION ALL SELECT dst_id, src_id, weight FROM edges), w AS (SELECT subfield, o, CAST(sum(weight) AS BIGINT) AS weight FROM s JOIN b USING (id) JOIN nodes n ON n.id = o AND n.type = 'organization' GROUP BY 1, 2) SELECT s.subfield, count(*) AS concepts, CAST(sum(mention_count) AS BIGINT) AS mentions, coalesce(any_value(k.c), 0) AS organizations FROM s LEFT JOIN (SELECT subfield, count_if(weight >= 2) AS c FROM w GROUP BY 1) k USING (subfield) GROUP BY 1")
def q_capability_cards(spark, sf):
    n = G.nodes(spark, sf)
    fields = n.where("type = 'concept'").select(F.left("canonical_name", F.lit(1)).alias("subfield"), F.col("canonical_name").alias("concept"))
    return digest.capability_cards(fields, n, G.edges(spark, sf, n))["cards"]


@query(G.SQL + ", s AS (SELECT id, substr(canonical_name, 1, 1) AS subfield FROM nodes WHERE type = 'concept'), b AS (SELECT src_id AS id, dst_id AS o, weight FROM edges UNION ALL SELECT dst_id, src_id, weight FROM edges), w AS (SELECT subfield, o AS org_id, n.canonical_name AS organization, CAST(sum(weight) AS BIGINT) AS weight FROM s JOIN b USING (id) JOIN nodes n ON n.id = o AND n.type = 'organization' GROUP BY 1, 2, 3) SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY subfield ORDER BY weight DESC, org_id) <= 5")
def q_capability_orgs(spark, sf):
    n = G.nodes(spark, sf)
    fields = n.where("type = 'concept'").select(F.left("canonical_name", F.lit(1)).alias("subfield"), F.col("canonical_name").alias("concept"))
    return digest.capability_cards(fields, n, G.edges(spark, sf, n))["organizations"].drop("rank")


@query(G.SQL + "SELECT id, canonical_name, mention_count FROM nodes WHERE lower(canonical_name) LIKE '%re%' AND id IN (SELECT src_id FROM edges WHERE relation = 'supplies' UNION SELECT dst_id FROM edges WHERE relation = 'supplies') ORDER BY mention_count DESC, id LIMIT 20")
def q_search_entities(spark, sf):
    n = G.nodes(spark, sf)
    aliases = n.select(F.lower("canonical_name").alias("alias"), F.col("id").alias("node_id"))
    return digest.search_entities(n, aliases, G.edges(spark, sf, n), "RE", relation="supplies").select("id", "canonical_name", "mention_count")


@query("SELECT doc_id AS doc_ord, CASE WHEN lower(left(text, 60)) LIKE '%license%' THEN 0 ELSE 1 END AS rank FROM documents WHERE lower(text) LIKE '%license%' ORDER BY rank, doc_id LIMIT 20")
def q_search_documents(spark, sf):
    docs = corpus_documents(spark, sf).withColumn("doc_date", F.lit(None).cast("date"))
    return digest.search_documents(docs, "License", since="2024-01-01").select("doc_ord", "rank")


@query(G.SQL + "SELECT a.canonical_name AS src, relation, b.canonical_name AS dst, weight FROM edges JOIN nodes a ON a.id = src_id JOIN nodes b ON b.id = dst_id WHERE relation <> 'co_occurs_with' ORDER BY weight DESC, edges.id LIMIT 12")
def q_briefing_relations(spark, sf):
    n = G.nodes(spark, sf)
    docs = G.documents(spark, sf).withColumn("fetched_at", F.col("doc_date"))
    return digest.briefing(n, G.edges(spark, sf, n), docs, AS_OF)["relations"].select("src", "relation", "dst", "weight")


@query(G.SQL + "SELECT id, canonical_name, last_seen FROM nodes WHERE type = 'person' ORDER BY last_seen DESC, mention_count DESC, id LIMIT 10")
def q_leads(spark, sf):
    return digest.leads(G.nodes(spark, sf)).select("id", "canonical_name", "last_seen")


AWARDS = "('Acme', 'Swarm', 'DOX', 'Navy', '$1,234.50', 'T-1', NULL, 'C-9', '2024-01-02', NULL), ('Beta', 'Lens', 'DOX', NULL, NULL, 'T-2', 'https://b.example/2', NULL, NULL, '2023'), ('Gamma', 'Net', 'DOX', 'Army', '99', NULL, NULL, NULL, '', '2022')"


@query("SELECT * FROM (VALUES ('Swarm', 'https://awards.invalid/T-1', '2024-01-02', 'Acme received an award from DOX, Navy. The award is worth $1,234. Contract C-9. abs'), ('Lens', 'https://b.example/2', '2023', 'Beta received an award from DOX. abs'), ('Net', 'https://awards.invalid/' || sha256('Gamma|Net'), '2022', 'Gamma received an award from DOX, Army. The award is worth $99. abs')) t(title, url, published, raw_text)")
def q_award_documents(spark, sf):
    return records.award_documents(_awards(spark)).select("title", "url", "published", "raw_text")


def _awards(spark: SparkSession) -> DataFrame:
    rows = values(spark, AWARDS, "firm, award_title, agency, branch, award_amount, agency_tracking_number, award_link, contract, proposal_award_date, award_year")
    none = F.lit(None).cast("string")
    return rows.select("*", *[none.alias(c) for c in ("phase", "program", "state", "ri_name", "pi_name")], F.lit("abs").alias("abstract"))


@query("SELECT 3 AS awards, CAST(1333.5 AS DOUBLE) AS total")
def q_funding_total(spark, sf):
    return digest.funding(records.award_documents(_awards(spark)), "awards")


# ------------------------------------------------------------ sources

@query("SELECT * FROM (VALUES ('a', 0, 'PE 01 Alpha', 'one'), ('a', 1, 'PE 02 Beta', 'two'), ('b', 0, 'Program section', 'plain text')) t(content_hash, n, title, body)")
def q_sections(spark, sf):
    rows = values(spark, r"('a', 'intro\nPE 01 Alpha\none\nPE 02 Beta\n two'), ('b', 'plain text')", "content_hash, text")
    return records.sections(rows, r"PE \d\d [A-Za-z]+")


FEED = "<rss><channel><item><title>One</title><link>http://a/1</link><pubDate>Wed, 02 Oct 2024 13:00:00 GMT</pubDate><description>short</description><encoded>&lt;p&gt;Longer &amp;amp; body&lt;/p&gt;</encoded></item><item><title></title></item><item><title>Two</title></item></channel></rss>"


@query("SELECT * FROM (VALUES ('f', 0, 'One', 'http://a/1', 'Wed, 02 Oct 2024 13:00:00 GMT', 'Longer & body'), ('f', 2, 'Two', '', '', '')) t(source, feed_pos, title, url, published, raw_text)")
def q_feed_entries(spark, sf):
    return feeds.parse(values(spark, f"('f', '{FEED}'), ('g', 'not xml')", "source, raw"))


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages")
def q_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", feeds.html_to_text_native(F.col("html")).alias("text"))


@query("SELECT * FROM (VALUES ('http://h.org/x/i.html', 0, 'http://h.org/x/a.pdf'), ('http://h.org/x/i.html', 1, 'http://h.org/b.PDF?v=1'), ('http://h.org/x/i.html', 2, 'https://o.net/c.pdf')) t(url, position, link)")
def q_pdf_links(spark, sf):
    return feeds.links(values(spark, """('http://h.org/x/i.html', '<a href="a.pdf">1</a> <a href="/b.PDF?v=1">2</a> <a href="https://o.net/c.pdf"> <a href="a.pdf"> <a href="d.html">')""", "url, html"))


@query("SELECT * FROM (VALUES ('s1', 'http://a.org/rss'), ('s2', 'http://b.org/feed')) t(seed, url)")
def q_feed_discovery(spark, sf):
    return feeds.discover(values(spark, "('s1', 'http://a.org/'), ('s2', 'http://b.org'), ('s3', 'http://c.org')", "seed, home"), values(spark, "(2, '{home}/rss'), (1, '{home}/feed')", "rank, template"), values(spark, "('http://a.org/rss'), ('http://b.org/feed'), ('http://b.org/rss')", "url"))


# ------------------------------------------------------------ curation

@query(f"SELECT doc_id AS doc_ord, NOT {_TOPIC} AS archived FROM documents")
def q_archive_prune(spark, sf):
    kept, gone = curation.prune(corpus_documents(spark, sf), text.is_relevant(F.col("raw_text"), PHRASES, ACRONYMS), "2024-01-01")
    return kept.select("doc_ord", F.lit(False).alias("archived")).unionByName(gone.select("doc_ord", F.lit(True).alias("archived")))


@query("WITH act AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0), arc AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0 AND text NOT IN (SELECT text FROM act)) SELECT (SELECT count(*) FROM act) + (SELECT count(DISTINCT text) FROM arc WHERE length(text) > 500) AS active, (SELECT count(*) FROM arc WHERE length(text) <= 500) AS archive")
def q_archive_reinstate(spark, sf):
    d = corpus_documents(spark, sf)
    active, archive = curation.reinstate(d.where("doc_ord % 3 = 0"), d.where("doc_ord % 3 <> 0"), F.length("raw_text") > 500)
    return spark.range(1).select(active.agg(F.count("*").alias("n")).scalar().alias("active"), archive.agg(F.count("*").alias("n")).scalar().alias("archive"))


@query("SELECT * FROM (VALUES ('merge', 'dod', 'Department'), ('merge', 'us', 'United States'), ('ignore', 'news', NULL)) t(kind, surface, canonical)")
def q_corrections_upsert(spark, sf):
    return curation.upsert_corrections(values(spark, "('merge', 'dod', 'Old'), ('ignore', 'news', null)", "kind, surface, canonical"), values(spark, "(1, 'merge', 'us', 'United States'), (2, 'merge', 'dod', 'Department'), (3, 'ignore', 'news', null)", "ord, kind, surface, canonical"))


@query("SELECT * FROM (VALUES ('b', 2), ('c', 3)) t(surface, n)")
def q_review_append(spark, sf):
    return curation.append_new(values(spark, "('a', 1)", "surface, n"), values(spark, "('a', 9), ('b', 2), ('c', 3), ('c', 3)", "surface, n"), "surface")


@query("SELECT * FROM (VALUES ('a', 2, true, '2025'), ('b', 1, true, '2025'), ('c', 3, false, '2024-01-05'), ('d', 0, false, NULL)) t(content_hash, read_count, read_fresh, last_read)")
def q_mark_read(spark, sf):
    return curation.mark_read(values(spark, READ, "content_hash, read_count, read_fresh, last_read"), values(spark, "('a'), ('b'), ('zz')", "content_hash"), "2025")


@query("SELECT doc_id AS doc_ord, CASE WHEN length(text) * 3 > greatest(2 * length(text), 400) THEN length(text) * 3 ELSE length(text) END AS n FROM documents")
def q_backfill(spark, sf):
    docs = corpus_documents(spark, sf)
    return curation.backfill(docs, docs.select("content_hash", F.repeat("raw_text", F.lit(3)).alias("body"))).select("doc_ord", F.length("raw_text").cast("long").alias("n"))


@query(_PEOPLE + " SELECT 'hegseth' AS src, 'pete hegseth' AS dst UNION ALL SELECT 'lockheed', 'lockheed martin'")
def q_duplicate_suggestions(spark, sf):
    return curation.duplicate_suggestions(people(spark)).select("src", "dst")


# ------------------------------------------------------------ events as streams

@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def q_stream_dedup(spark, sf):
    e = table(spark, sf, "events")
    return ingest.dedup(e.unionByName(e), "event_id").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_stream_volume(spark, sf):
    return ingest.volume(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def q_stream_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = ingest.sessions(e)
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})

"""Operators on small inputs: edges, nulls, ties, round trips."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import dates, numeric, text
from graphloom.operators import curation, extract, graph, resolve, temporal
from graphloom.sources import corpus, feeds, records
from graphloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("surface", "key"), [("U.S.", "us"), ("the Drone Swarms", "drone swarm"), ("Glass", "glass"), ("Acme’s", "acme"), (None, ""), ("A  B", "b"), ("bus", "bus")])
def test_normalize(spark, surface, key):
    assert one(spark, text.normalize(F.lit(surface).cast("string"))) == key


def test_topic_gate_on_null(spark):
    assert one(spark, text.is_relevant(F.lit(None).cast("string"), ["a"])) is False
    assert one(spark, text.is_relevant(F.lit("said AIs"), [], ["AI"])) is False
    assert one(spark, text.is_relevant(F.lit("(AI)"), [], ["AI"])) is True


def test_evidence_stops_at_a_sentence(spark):
    assert one(spark, text.evidence(F.lit("Acme  built it. Then more"), F.lit(0), F.lit(11))) == "Acme built it."


def test_better_body(spark):
    assert len(one(spark, text.better_body(F.lit("a" * 300), F.lit("b" * 601)))) == 601
    assert len(one(spark, text.better_body(F.lit("a" * 300), F.lit("b" * 600)))) == 300


def test_money_and_ratio(spark):
    assert one(spark, numeric.money(F.lit("$1,200.5"))) == 1200.5
    assert one(spark, numeric.money(F.lit("n/a"))) is None
    assert one(spark, numeric.percent(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, numeric.confidence(F.lit(2))) == 0.667


def test_durations(spark):
    assert [one(spark, text.duration(F.lit(s))) for s in (45, 125, 3720)] == ["45s", "2m 05s", "1h 02m"]
    assert one(spark, dates.is_stale(F.lit(None), F.lit("2024-01-01"))) is True


@pytest.mark.parametrize(("said", "names"), [
    ("we met Dr. Ann Bee of Acme Corp today", [("Ann Bee of Acme Corp", "organization")]),
    ("BREAKING NEWS from the Office of the Director now", [("Office of the Director", "misc")]),
    ("We saw Gen. John Low. Acme won", [("Gen", "misc"), ("John Low", "person"), ("Acme", "misc")]),
    ("", []), (None, []),
])
def test_proper_nouns(said, names):
    assert [(n, label) for n, label, _, _ in extract.proper_nouns(said)] == names


def test_proper_noun_offsets():
    said = "see Blue Sky, then"
    name, _, a, b = extract.proper_nouns(said)[0]
    assert name == "Blue Sky" and said[a:b] == "Blue Sky,"


@pytest.mark.parametrize(("acronym", "phrase", "fits"), [("DOD", "Department of Defense", True), ("MIT", "Massachusetts Institute of Technology", True), ("ABC", "Alpha Beta", False), ("ISR", "intelligence surveillance and reconnaissance", True), ("A", "Alpha", False)])
def test_acronyms_spell(acronym, phrase, fits):
    assert extract.spells(acronym, phrase.split()) is fits


def test_register_extractor(spark):
    extract.register_extractor("none", lambda t: [])
    docs = spark.createDataFrame([("a", 1, "Big Blue thing")], "content_hash string, doc_ord bigint, text string")
    lexicon = spark.createDataFrame([("big blue", "Big Blue", "organization")], "surface string, canonical string, type string")
    assert [r["text"] for r in extract.mentions(docs, lexicon, "none").collect()] == ["Big Blue"]
    assert extract.gazetteer_mentions(docs, lexicon.limit(0)).count() == 0


def test_relations_in_long_documents(spark):
    body = "x " * 500 + "Acme acquired Beta" + " y" * 500
    at = body.index("Acme")
    docs = spark.createDataFrame([("d", body)], "content_hash string, text string")
    rows = spark.createDataFrame([("d", "Acme", "organization", at, at + 4), ("d", "Beta", "organization", at + 14, at + 18), ("d", "Far", "organization", 0, 3), ("d", "No", "organization", None, None)], "content_hash string, text string, label string, start_char int, end_char int")
    got = extract.relations(docs, rows).collect()
    assert [(r["subject"], r["relation"], r["object"]) for r in got] == [("Acme", "acquires", "Beta")]


def test_number_is_dense_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    got = resolve.number(df, "k").orderBy("k").collect()
    assert [r["id"] for r in got] == list(range(1, 1001))
    assert resolve.number(df.limit(0), "k").count() == 0


def test_whole_graph(spark):
    docs = spark.createDataFrame([("a", 1, "Acme Corp built Falcon Drone. Ann Bee leads Acme Corp"), ("b", 2, "Acme Corp built Falcon Drone today"), ("c", 3, "")], "content_hash string, doc_ord bigint, text string")
    lexicon = spark.createDataFrame([("acme corp", "Acme Corp", "organization"), ("falcon drone", "Falcon Drone", "product")], "surface string, canonical string, type string")
    found = extract.mentions(docs, lexicon)
    made = resolve.graph(resolve.keyed_mentions(found), extract.relations(docs, found), docs.select("content_hash", "doc_ord", F.lit("2024-01-01").cast("date").alias("doc_date")))
    nodes = {r["canonical_name"]: r for r in made["nodes"].collect()}
    assert nodes["Acme Corp"]["mention_count"] == 3 and nodes["Acme Corp"]["document_count"] == 2
    edges = {(r["relation"], r["weight"]) for r in made["edges"].collect()}
    assert ("develops", 2) in edges and ("co_occurs_with", 2) in edges
    assert made["node_documents"].count() == sum(r["document_count"] for r in nodes.values())


def test_two_hops_over_all_relations(spark):
    import itertools

    links = [(a, (a * 5 + k) % 17, ("co_occurs_with", "builds")[k % 2]) for a in range(17) for k in (1, 4) if a != (a * 5 + k) % 17]
    e = spark.createDataFrame(links, "src_id bigint, dst_id bigint, relation string")
    near = {i: {b for a, b, _ in links if a == i} | {a for a, b, _ in links if b == i} for i in range(17)}
    want = {(a, b): len(near[a] & near[b]) for a, b in itertools.combinations(range(17), 2) if near[a] & near[b] and b not in near[a]}
    assert {(r["a"], r["b"]): r["shared"] for r in graph.two_hop_pairs(e, spark.range(17)).collect() if r["a"] < r["b"]} == want
    assert {(r["a"], r["b"]) for r in graph.two_hop_pairs(e, spark.range(3, 4)).collect()} == {(3, a + b - 3) for a, b in want if 3 in (a, b)}
    n = spark.createDataFrame([(i, f"n{i}", "t") for i in range(17)], "id bigint, canonical_name string, type string")
    assert {r["id"]: r["shared_neighbors"] for r in graph.adjacent(n, e, 3, 17).collect()} == {a + b - 3: s for (a, b), s in want.items() if 3 in (a, b)}


def test_shortest_path_has_no_hop_limit(spark):
    e = spark.createDataFrame([(i, i, i + 1, "co_occurs_with") for i in range(1, 21)], "id bigint, src_id bigint, dst_id bigint, relation string")
    assert [r["edge_id"] for r in graph.shortest_path(e, 1, 21).orderBy("step").collect()] == list(range(1, 21))
    assert graph.shortest_path(e, 1, 21, max_hops=19).count() == 0


def test_path_same_node_and_unreachable(spark):
    e = spark.createDataFrame([(1, 1, 2, "x"), (2, 5, 6, "x")], "id bigint, src_id bigint, dst_id bigint, relation string")
    assert graph.shortest_path(e, 1, 1).count() == 0
    assert graph.shortest_path(e, 1, 6).count() == 0
    assert graph.shortest_path(e, 2, 1).count() == 1
    assert graph.shortest_path(e, 1, 77).count() == 0
    assert graph.shortest_path(e.where("false"), 1, 2).count() == 0


def test_path_prefers_typed_edges(spark):
    rows = [(1, 1, 2, "co_occurs_with"), (2, 2, 3, "co_occurs_with"), (3, 4, 1, "co_occurs_with"), (4, 3, 4, "builds"), (5, 3, 5, "co_occurs_with"), (6, 4, 5, "builds"), (7, 5, 6, "builds"), (8, 8, 9, "builds")]
    e = spark.createDataFrame(rows, "id bigint, src_id bigint, dst_id bigint, relation string")
    assert [tuple(r) for r in graph.shortest_path(e, 1, 6).collect()] == [(1, 1, 4, 3, "co_occurs_with"), (2, 4, 5, 6, "builds"), (3, 5, 6, 7, "builds")]


def plain_path(links, src, dst):
    """Breadth first with whole paths: the smallest sequence of (co-occurrence?, edge id) among the shortest."""
    best, rim = {src: ()}, {src: ()}
    while rim and dst not in best:
        found = {}
        for i, a, b, relation in links:
            hop = (int(relation in ("co_occurs_with", None)), i)
            for x, y in ((a, b), (b, a)):
                if x in rim and y not in best:
                    found[y] = min(found.get(y, ((2, 0),)), (*rim[x], hop))
        best |= found
        rim = found
    return [i for _, i in best.get(dst, ())]


def test_paths_equal_plain_search(spark):
    rng = random.Random(11)
    links = [(i, rng.randrange(40), rng.randrange(40), rng.choice(("co_occurs_with", "builds", None))) for i in range(70)]
    links += [(70 + i, a, b, r) for i, (_, a, b, r) in enumerate(links[:20])] + [(90, 5, 5, "builds"), (91, None, 3, "builds")]
    e = spark.createDataFrame(links, "id bigint, src_id bigint, dst_id bigint, relation string").withColumn("at", F.lit("x")).withColumn("hop", F.lit(1)).cache()
    known = [r for r in links if r[1] is not None]
    for src, dst in ((0, 39), (3, 17), (22, 8), (39, 0)):
        rows = graph.shortest_path(e, src, dst).collect()
        assert [r["edge_id"] for r in rows] == plain_path(known, src, dst)
        assert [r["step"] for r in rows] == list(range(1, len(rows) + 1))
        assert all(x["to_id"] == y["from_id"] for x, y in zip(rows, rows[1:])) and (not rows or (rows[0]["from_id"], rows[-1]["to_id"]) == (src, dst))


def test_path_past_a_hub_reads_the_small_side(spark):
    """One end is a hub of 5,000 leaves: the search goes on from the other end, and leaves its folder empty."""
    e = spark.range(5000).selectExpr("id", "0L AS src_id", "id + 1 AS dst_id", "'builds' AS relation").unionByName(spark.createDataFrame([(9000, 7, 9001, "builds"), (9001, 9001, 9002, "builds")], "id bigint, src_id bigint, dst_id bigint, relation string"))
    assert [r["to_id"] for r in graph.shortest_path(e, 0, 9002).collect()] == [7, 9001, 9002]
    assert [r["to_id"] for r in graph.shortest_path(e, 9002, 0).collect()] == [9001, 7, 0]
    assert graph.shortest_path(e, 0, 9002, max_hops=2).count() == 0


def test_subgraph_with_unknown_focus(spark):
    n = spark.createDataFrame([(1, "Acme", "organization", 5)], "id bigint, canonical_name string, type string, mention_count bigint")
    e = spark.createDataFrame([], "id bigint, src_id bigint, dst_id bigint, relation string, weight bigint, strength double, confidence double")
    nodes, edges = graph.subgraph(n, e, focus="zzz")
    assert nodes.count() == 0 and edges.count() == 0
    assert graph.subgraph(n, e)[0].count() == 1


def test_recent_fallback(spark):
    d = spark.createDataFrame([("a", "2024-01-08"), ("b", "2024-01-09"), ("c", "2024-01-01")], "content_hash string, d string").withColumn("doc_date", F.to_date("d"))
    assert [r[0] for r in temporal.recent_with_fallback(d, "2024-01-10").collect()] == ["b"]
    assert [r[0] for r in temporal.recent_with_fallback(d, "2024-01-11").collect()] == ["b", "a"]


def test_corpus_round_trip(spark, tmp_path):
    path = str(tmp_path / "corpus")
    assert corpus.load(spark, path).count() == 0
    row = spark.createDataFrame([("s", "t", "h", "body")], "source string, title string, content_hash string, raw_text string")
    corpus.append(row, path)
    first = corpus.load(spark, path)
    assert first.first()["read_count"] == 0 and first.first()["url"] == ""
    corpus.append(corpus.new_documents(first, first), path)
    assert corpus.load(spark, path).count() == 1
    corpus.replace(curation.mark_read(corpus.load(spark, path), first.select("content_hash"), "2025"), path)
    assert corpus.load(spark, path).first()["read_count"] == 1


def test_feed_atom_and_garbage():
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="http://x/1"/><updated>2024-01-02T00:00:00Z</updated><summary>s</summary></entry></feed>'
    assert feeds.entries(atom) == [{"feed_pos": 0, "title": "T", "url": "http://x/1", "published": "2024-01-02T00:00:00Z", "html": "s"}]
    assert feeds.entries("<rss") == [] and feeds.entries(None) == []


def test_html_forms_agree(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p><script>x</script><b>c</b>",), (None,)], "h string")
    assert [tuple(r) for r in df.select(feeds.html_to_text(F.col("h")), feeds.html_to_text_native(F.col("h"))).collect()] == [("a & b c", "a & b c"), ("", "")]


def test_enrichment_plan(spark):
    plan = spark.sql("SELECT 'e' AS entity, array(named_struct('url', 'u', 'title', 'On drones', 'source', 's', 'published', '', 'html', '<p>drones fly</p>'), named_struct('url', 'v', 'title', 'Cake', 'source', 's', 'published', '', 'html', 'cake')) AS articles, named_struct('title', 'Sum', 'body', 'cake only', 'source', 'x') AS synthesis")
    got = records.enrichment(plan, spark.createDataFrame([], "content_hash string"), ["drones"]).collect()
    assert [r["url"] for r in got] == ["u"]
    assert records.plan_gate(plan, ["drones"]).first()["location"] == "article 1"


def test_run_history_skips_malformed(spark, tmp_path):
    f = tmp_path / "runs.jsonl"
    f.write_text('{"finished_at": "2024-01-01T00:00:00Z", "fetched": 3}\nnot json\n{"finished_at": "2024-01-02T00:00:00Z"}\n')
    assert records.tail(records.run_history(spark, str(f)), 1).first()["fetched"] is None


def test_snapshot_round_trip(spark, tmp_path):
    records.snapshot({"a": spark.range(3)}, str(tmp_path))
    assert records.restore(spark, str(tmp_path), ["a"])["a"].count() == 3


def test_streaming_append(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:10:00'), ('b', timestamp'2024-01-01 00:20:00') AS t(content_hash, ts)").write.parquet(src)
    stream = spark.readStream.schema("content_hash string, ts timestamp").parquet(src)
    ingest.append_to(ingest.dedup(stream), out, str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def fake_service(agency, year, start, rows):
    import os

    from graphloom.sources.awards import Busy

    flag = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"busy-{os.getpid()}-{agency}")
    if start == 2 and not os.path.exists(flag):
        open(flag, "w").close()
        raise Busy
    return [{"firm": f"{agency}{i}", "award_year": year} for i in range(start, min(start + rows, 5))]


def test_paged_award_source(spark):
    from graphloom.sources.awards import AwardSource

    spark.dataSource.register(AwardSource)
    read = spark.read.format("awards").option("agencies", "A, B").option("year", 2024).option("pageSize", 2).option("waitSeconds", 0).option("fetcher", "tests.test_operators:fake_service")
    assert sorted(r["firm"] for r in read.load().collect()) == [f"{a}{i}" for a in "AB" for i in range(5)]
    assert read.option("maxRecords", 3).load().where("firm like 'A%'").count() == 3


def test_daily_store_and_reset(spark, tmp_path):
    from graphloom.sources import stores

    folder = str(tmp_path / "daily")
    assert stores.load_daily(spark, folder, "date string, text string").count() == 0
    for day, said in (("2024-01-01", "a"), ("2024-01-02", "b"), ("2024-01-02", "c")):
        stores.save_daily(spark.createDataFrame([(day, said)], "date string, text string"), folder)
    got = stores.load_daily(spark, folder, "date string, text string")
    assert records.latest_daily(got).first()["text"] == "c" and got.count() == 2
    with pytest.raises(ValueError):
        stores.reset(spark, str(tmp_path), ("daily",))
    assert stores.reset(spark, str(tmp_path), ("daily", "none"), confirmed=True) == ["daily"]

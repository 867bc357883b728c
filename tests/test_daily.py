"""The daily run, the corpus by versions, re-resolution and the verbs around them."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from graphloom import __main__ as cli
from graphloom.operators import curation, extract, quality, resolve
from graphloom.plans import daily, serve
from graphloom.plans.api import rebuild
from graphloom.sources import corpus, feeds, records

FEED = """<?xml version="1.0"?><rss><channel>%s</channel></rss>"""
ITEM = "<item><title>%s</title><link>%s</link><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate><description>%s</description></item>"


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "feeds"
    f.mkdir()
    (f / "one.xml").write_text(FEED % "".join(ITEM % x for x in [("Drone news", "http://a/1", "Acme Corp built Falcon Drone."), ("Cake", "http://a/2", "Sugar."), ("Drone news", "http://a/1", "Acme Corp built Falcon Drone.")]))
    (f / "two.xml").write_text(FEED % (ITEM % ("More drones", "http://b/1", "Beta Labs supplies drones. Ann Bee leads Beta Labs.")))
    (f / "bad.xml").write_text("no xml")
    return f


def test_corpus_keeps_the_order_of_ingestion(spark, tmp_path):
    path = str(tmp_path / "c")
    for i in (3, 1, 2):
        corpus.append(spark.createDataFrame([(f"h{i}{j}", i * 10 + j) for j in (2, 1)], "content_hash string, doc_ord bigint").repartition(2), path)
    got = [r["content_hash"] for r in corpus.load(spark, path).orderBy("doc_ord").collect()]
    assert got == ["h31", "h32", "h11", "h12", "h21", "h22"]


def test_versions_replace_a_corpus(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text(json.dumps({"content_hash": "a"}) + "\n" + json.dumps({"content_hash": "b"}) + "\n")
    at = str(path)
    assert [r["content_hash"] for r in corpus.load(spark, at).orderBy("doc_ord").collect()] == ["a", "b"]
    corpus.replace(corpus.load(spark, at).where("content_hash = 'b'"), at)
    assert not path.exists() and corpus.exists(spark, at)
    corpus.append(spark.createDataFrame([("c",)], "content_hash string"), at)
    corpus.replace(corpus.load(spark, at), at)
    assert [r["content_hash"] for r in corpus.load(spark, at).orderBy("doc_ord").collect()] == ["b", "c"]
    # A writer that dies before its commit leaves data that nobody reads.
    (tmp_path / "c.jsonl.versions" / "data-dead").mkdir()
    assert corpus.load(spark, at).count() == 2 and corpus.load(spark, str(tmp_path / "none")).count() == 0


def test_daily_run(spark, folder, tmp_path):
    path, runs = str(tmp_path / "c"), str(tmp_path / "runs")
    lexicon = spark.createDataFrame([("acme corp", "Acme Corp", "organization"), ("beta labs", "Beta Labs", "organization")], "surface string, canonical string, type string")
    for day in ("2024-05-02", "2024-05-03"):
        land, card = daily.run(spark, path, daily.feed_batch(spark, str(folder)), lexicon, ["drone", "drones"], [], day, runs)
    assert corpus.load(spark, path).count() == 2 and land.nodes.count() >= 2
    history = records.run_history(spark, runs).orderBy("finished_at").collect()
    assert [(r["fetched"], r["added"], r["filtered"]) for r in history] == [(4, 2, 1), (4, 0, 1)]
    assert history[0]["feeds"]["one"]["added"] == 1 and history[0]["kpis"]["partial_name_dups"] == 0
    assert {r["kpi"]: r["delta"] for r in quality.run_diff(records.run_history(spark, runs)).collect()}["documents"] == 0
    got = {(r["figure"], r["bucket"]): r["count"] for r in quality.distributions(land.nodes, land.edges).collect()}
    assert sum(n for (figure, _), n in got.items() if figure == "degree") == land.nodes.count()


def test_corrections_resolve_the_graph_anew(spark):
    docs = spark.createDataFrame([("d1", 1, "Acme Corp met Beta Labs."), ("d2", 2, "Acme Corp met Beta Labs.")], "content_hash string, doc_ord bigint, raw_text string").selectExpr("*", "'' AS title", "'2024' AS published", "'2024' AS fetched_at")
    lexicon = spark.createDataFrame([("acme corp", "Acme Corp", "organization"), ("beta labs", "Beta Labs", "organization")], "surface string, canonical string, type string")
    none = spark.createDataFrame([], "kind string, surface string, canonical string")
    land = rebuild(docs, lexicon, "2024-05-02", corrections=none)
    assert land.nodes.count() == 2
    again = land.resolved(land.correct("merge", "Beta Labs", "Acme Corp"))
    assert [r["canonical_name"] for r in again.nodes.collect()] == ["Acme Corp"] and again.edges.count() == 0


@pytest.mark.parametrize("n", [1, 2, 100])
def test_merge_chains_of_any_length(spark, n):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n)], "src string, dst string")
    assert {(r["src"], r["dst"]) for r in resolve.closed(links).collect()} == {(f"n{i:03d}", f"n{n:03d}") for i in range(n)}


def test_merge_cycles_end_in_their_smallest_member(spark):
    links = spark.createDataFrame([("b", "c"), ("c", "a"), ("a", "b"), ("x", "c"), ("w", "x"), ("p", "q"), ("s", "s")], "src string, dst string")
    assert {(r["src"], r["dst"]) for r in resolve.closed(links).collect()} == {("b", "a"), ("c", "a"), ("x", "a"), ("w", "a"), ("p", "q")}
    fixes = spark.createDataFrame([("merge", f"Name {i:02d}", f"Name {i + 1:02d}") for i in range(40)] + [("merge", "usa", "USA"), ("merge", "Ping", "Pong"), ("merge", "Pong", "Ping")], "kind string, surface string, canonical string")
    got = {r["alias"]: r["merged"] for r in resolve.merge_map(fixes).collect()}
    assert all(got[f"name {i:02d}"] == "Name 40" for i in range(40)) and got["usa"] == "USA" and got["ping"] == got["pong"] == "Ping"


def test_gazetteer_of_any_size(spark):
    names = [(f"surface {i}", f"S{i}", "concept") for i in range(50_000)] + [("C++", "C++", "concept"), ("AT&T labs", "AT&T Labs", "organization"), ("at&t", "AT&T", "organization"), ("...", "Dots", "misc")]
    lexicon = spark.createDataFrame(names, "surface string, canonical string, type string")
    docs = spark.createDataFrame([("a", "We know Surface 17 and surface 49999, not surfaces 3. AT&T labs; AT&T!"), ("b", "C++ (or C) ... at&t"), ("c", None), ("d", "")], "content_hash string, text string")
    got = sorted((r["content_hash"], r["text"], r["start_char"], r["end_char"]) for r in extract.gazetteer_mentions(docs, lexicon).collect())
    assert got == [("a", "AT&T", 65, 69), ("a", "AT&T Labs", 54, 63), ("a", "S17", 8, 18), ("a", "S49999", 23, 36), ("b", "C++", 0, 3)]


def test_cues_and_acronyms():
    assert extract.inflected("supply make/made free") == ["supply", "supplies", "supplying", "supplied", "make", "makes", "making", "made", "free", "frees", "freeing", "freed"]
    assert extract.acronym_pairs([("the Department of Defense ", "DoD")]) == []
    assert extract.acronym_pairs([("see the Department of Defense ", "DOD"), ("one LLM ", "large language model"), ("research, development and test ", "RDT"), ("ABC ", "x"), ("", "")]) == [("DOD", "Department of Defense"), ("LLM", "large language model"), ("RDT", "research development and test")]


def test_feed_checks_and_main_text(spark):
    answers = spark.createDataFrame([("u1", FEED % (ITEM % ("t", "l", "d"))), ("u2", "<html><p>no</p></html>"), ("u3", None), ("u4", "<feed xmlns='x'><entry/><entry/></feed>")], "url string, raw string")
    got = {r["url"]: (r["alive"], r["entries"]) for r in feeds.health(answers.select(F.col("url").alias("source"), "url"), answers).collect()}
    assert got == {"u1": (True, 1), "u2": (False, 0), "u3": (False, 0), "u4": (True, 2)}
    seeds = spark.createDataFrame([("s", "http://h/", "drones")], "seed string, home string, topic string")
    templates = spark.createDataFrame([(1, "{home}/feed"), (2, "{home}/tag/{topic}/feed")], "rank int, template string")
    alive = spark.createDataFrame([("http://h/tag/drones/feed",)], "url string")
    assert feeds.discover(seeds, templates, alive).first()["url"] == "http://h/tag/drones/feed"
    pages = spark.createDataFrame([("<nav>menu</nav><p>one</p><div>two</div><footer>f</footer>",), ("<p>only paragraphs</p>",), ("<nav>all there is</nav>",), (None,)], "h string")
    assert [r[0] for r in pages.select(feeds.main_text(F.col("h"))).collect()] == ["one two", "only paragraphs", "all there is", ""]


def test_suggestions_become_corrections(spark):
    merges = spark.createDataFrame([("acme", "Acme Corp")], "bare string, full string")
    noise = spark.createDataFrame([("12",)], "canonical_name string")
    old = spark.createDataFrame([("merge", "acme", "Other")], "kind string, surface string, canonical string")
    got = {(r["kind"], r["surface"]): r["canonical"] for r in curation.upsert_corrections(old, curation.accepted(merges, noise)).collect()}
    assert got == {("merge", "acme"): "Acme Corp", ("ignore", "12"): None}


def test_verbs(spark, folder, tmp_path, capsys):
    at = {n: str(tmp_path / n) for n in ("corpus", "archive", "corrections", "graph", "runs", "daily")}
    flags = [x for k, v in at.items() for x in (f"--{k}", v)] + ["--as-of", "2024-05-02"]
    gazetteer = tmp_path / "g.csv"
    gazetteer.write_text("surface,canonical,type\nacme corp,Acme Corp,organization\nbeta labs,Beta Labs,organization\nann bee,Ann Bee,person\nbee,Bee,person\n")
    flags += ["--gazetteer", str(gazetteer)]
    cli.main(["run", "drone", "drones", "--feeds", str(folder), *flags])
    assert corpus.load(spark, at["corpus"]).count() == 2 and records.run_history(spark, at["runs"]).count() == 1
    awards = tmp_path / "a.json"
    awards.write_text(json.dumps([{"firm": "Acme", "award_title": "Drone swarm", "abstract": "Drones that fly.", "agency": "NASA", "agency_tracking_number": "N1"}, {"firm": "Cake", "award_title": "Cake", "abstract": "Sugar."}]))
    cli.main(["sbir", "drone", "--awards", str(awards), *flags])
    books = tmp_path / "books"
    books.mkdir()
    (books / "b.txt").write_text("RDT&E book\nPE 01A: Alpha\nCake.\nPE 02B: Beta\nA drone that flies.\n")
    cli.main(["jbooks", "drone", "--books", str(books), *flags])
    rows = {r["source"]: r for r in corpus.load(spark, at["corpus"]).collect()}
    assert set(rows) == {"one", "two", "awards", "budget"} and "flies" in rows["budget"]["raw_text"]
    page = tmp_path / "p.json"
    page.write_text(json.dumps({"content_hash": rows["one"]["content_hash"], "html": "<p>" + "Acme Corp built a longer body. " * 40 + "</p>"}))
    cli.main(["backfill", str(page), *flags])
    assert max(len(r["raw_text"]) for r in corpus.load(spark, at["corpus"]).collect()) > 1000
    cli.main(["rebuild", *flags])
    cli.main(["snapshot", str(tmp_path / "s"), *flags])
    assert spark.read.parquet(str(tmp_path / "s" / "corpus")).count() == 4
    cli.main(["correct", "merge", "Beta Labs", "Acme Corp", *flags])
    assert "Beta Labs" not in [r["canonical_name"] for r in spark.read.parquet(f"{at['graph']}/nodes").collect()]
    cli.main(["correct-from-review", "--yes", *flags])
    cli.main(["review", *flags])
    note = tmp_path / "note.txt"
    note.write_text("What happened.")
    cli.main(["synthesize-daily", str(note), *flags])
    cli.main(["overview", *flags])
    cli.main(["run", "drone", "--feeds", str(folder), *flags])
    cli.main(["overview", "--diff", *flags])
    for name, rows in (("seeds.csv", "seed,home\ns,http://h/\n"), ("t.csv", "rank,template\n1,{home}/feed\n"), ("a2.json", json.dumps({"url": "http://h/feed", "raw": FEED % (ITEM % ("t", "l", "d"))}))):
        (tmp_path / name).write_text(rows)
    cli.main(["discover-feeds", *(str(tmp_path / n) for n in ("seeds.csv", "t.csv", "a2.json"))])
    cli.main(["demo"])
    said = capsys.readouterr().out
    assert "What happened." in said and "http://h/feed" in said and "Falcon Drone" in said
    with pytest.raises(ValueError):
        cli.main(["run", "x", *flags])


def test_http(spark):
    docs = spark.createDataFrame([("d1", 1, "Acme Corp met Beta Labs.")], "content_hash string, doc_ord bigint, raw_text string").selectExpr("*", "'' AS title", "'2024-05-01' AS published", "'2024-05-01' AS fetched_at", "'s' AS source")
    lexicon = spark.createDataFrame([("acme corp", "Acme Corp", "organization"), ("beta labs", "Beta Labs", "organization")], "surface string, canonical string, type string")
    land = rebuild(docs, lexicon, "2024-05-02")
    with serve.server(land, 0) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()

        def get(path):
            with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}{path}", timeout=60) as r:
                return json.loads(r.read())

        assert {n["canonical_name"] for n in get("/api/graph?min_weight=1")["nodes"]} == {"Acme Corp", "Beta Labs"}
        assert get("/api/search?q=acme")["entities"] and get("/api/path?from=acme&to=beta")["rows"] and get("/api/document/d1")["rows"]
        for path, code in (("/api/nothing", 404), ("/api/node/99", 404), ("/api/graph?max_nodes=9999", 422), ("/api/path?from=acme&to=nobody", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path)
            assert e.value.code == code
        http.shutdown()

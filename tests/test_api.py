"""The query surface end to end on a small corpus."""

import json

import pytest

from graphloom import __main__ as cli
from graphloom.plans.api import NotFound, rebuild
from graphloom.sources import corpus


@pytest.fixture(scope="module")
def land(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("c") / "corpus.jsonl"
    body = ["Acme Corp built Falcon Drone. Ann Bee leads Acme Corp.", "Acme Corp bought Beta Labs in spring. Falcon Drone flew.", "Beta Labs supplies Falcon Drone parts.", "Nothing of note."]
    path.write_text("\n".join(json.dumps({"content_hash": f"h{i}", "title": f"Title {i}", "raw_text": b, "published": f"2024-0{i + 1}-05", "fetched_at": "2024-05-01T00:00:00", "source": "s"}) for i, b in enumerate(body)) + "\n\n")
    lexicon = spark.createDataFrame([("acme corp", "Acme Corp", "organization"), ("falcon drone", "Falcon Drone", "product"), ("beta labs", "Beta Labs", "organization"), ("ann bee", "Ann Bee", "person")], "surface string, canonical string, type string")
    fields = spark.createDataFrame([("drones", "Falcon Drone")], "subfield string, concept string")
    tours = spark.createDataFrame([("t", ["Acme Corp", "Nobody"])], "tour string, names array<string>")
    fixes = spark.createDataFrame([], "kind string, surface string, canonical string")
    return rebuild(corpus.load(spark, str(path)), lexicon, "2024-05-02", corrections=fixes, subfields=fields, tours=tours)


def ids(land):
    return {r["canonical_name"]: r["id"] for r in land.nodes.collect()}


def test_graph_and_node(land):
    known = ids(land)
    assert {"Acme Corp", "Falcon Drone", "Beta Labs", "Ann Bee"} <= set(known)
    nodes, edges = land.graph(min_weight=1)
    assert nodes.count() == len(known) and edges.where("relation = 'acquires'").count() == 1
    got = land.node(known["Acme Corp"])
    assert got["neighbours"].where("relation = 'develops' and direction = 'out'").count() == 1
    with pytest.raises(NotFound):
        land.node(999)
    assert land.adjacent(known["Ann Bee"]).count() >= 1
    assert land.tours().where("id is null").count() == 1


def test_path_by_name(land):
    steps = land.path("ann bee", "beta").collect()
    assert [s["from_name"] for s in steps][0] == "Ann Bee" and steps[-1]["to_name"] == "Beta Labs"
    with pytest.raises(NotFound):
        land.path("nobody", "acme")


def test_search_and_time(land):
    found = land.search("acme")
    assert found["entities"].count() == 1 and found["documents"].count() == 2
    assert [r["count"] for r in land.trends()["document_volume"].collect()] == [1, 1, 1, 1]
    assert land.trajectory(5).count() == 5
    with pytest.raises(ValueError):
        land.trajectory(1)
    assert land.recent(days=30)["documents"].count() == 1
    assert land.spikes().count() == 0 and land.pulse().first()["new_entities"] == 0
    assert land.node_documents(ids(land)["Acme Corp"])["documents"].count() == 2
    assert land.document("h0").count() == 1


def test_overview_and_briefing(land):
    got = land.overview()
    assert got["figures"].first()["documents"] == 4
    assert all(df.count() >= 1 for name, df in got.items() if name != "partial")
    assert land.briefing()["people"].count() == 1
    assert land.briefing(subfield="drones")["documents"].count() >= 0
    assert land.capabilities()["cards"].count() == 0  # the concept is typed as a product
    assert land.narrative_inputs()["documents"].count() == 0


def test_curation(land, spark):
    assert land.correct("merge", "acme", "Acme Corp").count() == 1
    with pytest.raises(ValueError):
        land.correct("drop", "x")
    none = spark.createDataFrame([], "node_key string")
    assert set(land.review(none, none)) == {"merges", "noise", "candidates", "acronyms"}
    kept, gone, by = land.audit(["drone"], [], "2024")
    assert kept.count() == 3 and gone.count() == 1 and by.first()["dropped"] == 1


def test_command_line(land, tmp_path, spark, capsys):
    from graphloom.sources import records

    records.snapshot({n: land.tables[n] for n in cli.TABLES}, str(tmp_path / "g"))
    for verb in (["search", "acme"], ["graph"], ["trends"], ["path", "ann", "beta"], ["types"], ["digest"]):
        cli.main([*verb, "--graph", str(tmp_path / "g"), "--as-of", "2024-05-02"])
    assert "Acme Corp" in capsys.readouterr().out


def test_command_line_on_a_corpus(spark, tmp_path):
    path, archive, fixes, graph = (str(tmp_path / n) for n in ("c", "a", "f", "g"))
    rows = [("h1", "Drone news", "Acme Corp flies. Acme Corp wins."), ("h2", "Cake", "Sugar.")]
    corpus.append(spark.createDataFrame(rows, "content_hash string, title string, raw_text string").selectExpr("*", "'s' AS source"), path)
    at = ["--corpus", path, "--archive", archive, "--corrections", fixes, "--graph", graph, "--as-of", "2024-01-01"]
    count = lambda: corpus.load(spark, path).count()
    cli.main(["audit", "drone", *at])
    assert count() == 2
    cli.main(["audit", "drone", "--prune", *at])
    assert count() == 1
    cli.main(["audit", "sugar", "--reinstate", *at])
    assert count() == 2
    cli.main(["reading", "h1", *at])
    assert corpus.load(spark, path).where("read_fresh").count() == 1
    cli.main(["reading", "--reset", *at])
    assert corpus.load(spark, path).where("read_fresh").count() == 0
    cli.main(["correct", "merge", "acme", "Acme Corp", *at])
    cli.main(["correct", "ignore", "sugar", *at])
    assert spark.read.json(corpus.current(spark, fixes)).count() == 2
    plan = tmp_path / "plan.json"
    plan.write_text('{"entity": "e", "articles": [{"url": "u", "title": "drones", "html": "<p>x</p>"}]}')
    cli.main(["enrich", str(plan), "drones", *at])
    cli.main(["enrich", str(plan), "drones", *at])
    assert count() == 3
    cli.main(["rebuild", *at])
    assert spark.read.parquet(f"{graph}/nodes").count() >= 1
    with pytest.raises(ValueError):
        cli.main(["reset", *at])
    cli.main(["reset", "--yes", *at])
    assert not corpus.exists(spark, f"{graph}/nodes")

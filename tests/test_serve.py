"""The HTTP surface: whole answers, and posted changes."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from graphloom.plans import serve
from graphloom.plans.api import rebuild
from graphloom.sources import corpus


@pytest.fixture(scope="module")
def http(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("s") / "corpus.jsonl"
    body = ["Acme Corp built Falcon Drone.", "Acme Corp bought Beta Labs in spring.", "Beta Labs built Falcon Drone parts for Acme Works."]
    path.write_text("\n".join(json.dumps({"content_hash": f"h{i}", "title": f"Title {i}", "raw_text": b, "published": "2024-01-05", "fetched_at": "2024-05-01T00:00:00", "source": "s"}) for i, b in enumerate(body)))
    lexicon = spark.createDataFrame([("acme corp", "Acme Corp", "organization"), ("acme works", "Acme Works", "organization"), ("falcon drone", "Falcon Drone", "product"), ("beta labs", "Beta Labs", "organization")], "surface string, canonical string, type string")
    fixes = spark.createDataFrame([], "kind string, surface string, canonical string")
    changes = []
    with serve.server(rebuild(corpus.load(spark, str(path)), lexicon, "2024-05-02", corrections=fixes), 0, on_change=lambda name, df: changes.append((name, df.count()))) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()

        def ask(path, sent=None):
            data = None if sent is None else sent if isinstance(sent, bytes) else json.dumps(sent).encode()
            try:
                with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/{path}", data=data), timeout=300) as r:
                    return r.status, json.loads(r.read())
            except urllib.error.HTTPError as e:
                return e.code, json.loads(e.read())

        yield ask, changes
        server.shutdown()


def test_answers_are_whole(spark):
    frames = {"edges": spark.range(5000), "none": spark.range(0), "null": spark.sql("SELECT cast(null AS int) AS a, 'é\"' AS b")}
    got = json.loads("".join(serve.body(frames)))
    assert sorted(r["id"] for r in got["edges"]) == list(range(5000)) and got["none"] == [] and got["null"] == [{"b": 'é"'}]
    assert json.loads("".join(serve.body({}))) == {}


def test_marking_a_document_read(http):
    ask, changes = http
    assert ask("document/h1")[1]["rows"][0]["read_count"] == 0
    assert ask("document/mark-read", {"content_hash": "h1", "at": "2024-05-02"}) == (200, {"ok": True, "changed": "documents"})
    assert ask("document/mark-read", {"content_hash": ["h1", "h1"]})[0] == 200
    row = ask("document/h1")[1]["rows"][0]
    assert row["read_count"] == 2 and row["read_fresh"] is True
    assert ask("document/mark-read", {"content_hash": "absent"})[0] == 404 and ask("document/h0")[1]["rows"][0]["read_count"] == 0
    assert changes[:2] == [("documents", 3), ("documents", 3)]


def test_a_correction_changes_the_graph(http):
    ask, changes = http
    names = lambda: {n["canonical_name"] for n in ask("graph?min_weight=1")[1]["nodes"]}
    assert {"Acme Corp", "Acme Works"} <= names()
    assert ask("correct", {"action": "merge", "surface": "Acme Works", "canonical": "Acme Corp"})[0] == 200
    assert "Acme Works" not in names() and "Acme Corp" in names()
    assert ask("correct", {"action": "ignore", "surface": "Beta Labs"})[0] == 200
    assert "Beta Labs" not in names()
    assert [c for c in changes if c[0] == "corrections"] == [("corrections", 1), ("corrections", 2)]


def test_refusals(http):
    ask, _ = http
    assert ask("correct", {"action": "rename", "surface": "x"})[0] == 422
    assert ask("correct", {})[0] == 404 and ask("nothing", {})[0] == 404 and ask("nothing")[0] == 404
    assert ask("correct", b"[]")[0] == 422 and ask("correct", b"{")[0] == 422

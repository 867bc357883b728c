"""The jobs over growing input: two runs, restarts between write and checkpoint, empty and odd rows."""

import os
import shutil

import pytest

from jobs import ingest_documents, update_graph
from jobs.common import default_config

CONFIG = default_config(ingest_documents.__file__)


@pytest.fixture
def box(tmp_path):
    os.makedirs(tmp_path / "in")
    return {"source": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "ck")}


def put(spark, box, name, rows):
    spark.createDataFrame(rows, ingest_documents.SOURCE).coalesce(1).write.parquet(f"{box['source']}/{name}")
    part = next(f for f in os.listdir(f"{box['source']}/{name}") if f.startswith("part"))
    shutil.move(f"{box['source']}/{name}/{part}", f"{box['source']}/{name}.parquet")
    shutil.rmtree(f"{box['source']}/{name}")


def ran(spark, box, **config):
    got = ingest_documents.run(spark, **box, config=CONFIG | config)
    return sorted((r["doc_id"], r["feed"], r["terms"], r["batch"]) for r in got.collect())


FIRST = [(3, "the first", "en", "a", 9), (1, "the first", "en", "b", 9), (2, "nothing here", "en", "a", 12), (4, None, None, None, None), (5, "", "en", "", 0), (6, "AI, the license", "en", None, 15)]


def test_ingest_takes_only_what_is_new(spark, box):
    put(spark, box, "one", FIRST)
    once = [(1, "b", "the", 0), (6, "unknown", "AI,license,the", 0)]
    assert ran(spark, box) == once
    assert ran(spark, box) == once  # nothing new
    put(spark, box, "two", [(7, "the first", "en", "a", 9), (8, "the second", "en", "a", 10), (8, "the second", "en", "a", 10)])
    assert ran(spark, box) == [*once, (8, "a", "the", 1)]
    cards = spark.read.parquet(f"{box['output']}/scorecard").select("batch", "feed", "fetched", "added", "filtered", "known").collect()
    assert sorted(map(tuple, cards)) == [(0, "a", 2, 0, 1, 1), (0, "b", 1, 1, 0, 0), (0, "unknown", 3, 1, 2, 0), (1, "a", 3, 1, 0, 2)]


@pytest.mark.parametrize("marked", [False, True])
def test_ingest_repeats_a_batch_that_was_written_but_not_marked(spark, box, marked):
    put(spark, box, "one", FIRST)
    put(spark, box, "two", [(8, "the second", "en", "a", 10)])
    once = ran(spark, box)
    done = f"{box['checkpoint']}/commits/0"
    os.remove(done)
    os.remove(f"{box['checkpoint']}/commits/.0.crc")
    if marked:  # the writer died in the middle: half of its folder, and files of its own beside
        feed = f"{box['output']}/documents/batch=0/feed=a"
        shutil.copytree(feed, f"{box['output']}/documents/batch=0/feed=left")
        shutil.rmtree(feed)
    assert ran(spark, box) == once
    assert os.path.exists(done)


def test_ingest_in_several_batches(spark, box):
    for i in range(4):
        put(spark, box, f"f{i}", [(i, f"the {i // 2}", "en", "a", 5), (10 + i, f"the {i}", "en", "b", 5)])
    got = ran(spark, box, files_per_batch=1)
    assert len(got) == 4 and len({b for *_, b in got}) == 4


def test_ingest_of_an_empty_table(spark, box):
    put(spark, box, "none", [])
    assert ran(spark, box) == [] and ran(spark, box) == []


def tables(spark, at, rows, parts):
    spark.createDataFrame([(o, d) for o, d, _ in rows], "o_orderkey bigint, o_orderdate string").selectExpr("o_orderkey", "cast(o_orderdate as timestamp) as o_orderdate", "'x' as a", "'y' as content_hash").write.mode("overwrite").parquet(f"{at}/orders")
    lines = [(o, p, n) for o, _, ps in rows for n, p in enumerate(ps)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int").write.mode("overwrite").parquet(f"{at}/lineitem")
    spark.createDataFrame(parts, "p_partkey bigint, p_name string").write.mode("overwrite").parquet(f"{at}/part")


def test_graph_over_growing_orders(spark, tmp_path):
    parts = [(1, "bolt"), (2, "nut"), (3, "rod"), (4, None), (5, "bolt")]
    rows = [(1, "2001-01-01", [1, 2, 2]), (2, "2001-01-02", [1, 2, 3]), (3, None, []), (4, "2001-01-03", [4, 1])]
    more = [(9, "2001-02-01", [2, 3]), (12, "2001-02-02", [5, 3])]

    def run(at, state):
        got = update_graph.run(spark, f"{at}/orders", f"{at}/lineitem", f"{at}/part", state, default_config(update_graph.__file__))
        return sorted((r["a"], r["b"], r["weight"], r["strength"]) for r in got.collect())

    tables(spark, tmp_path / "t1", rows, parts)
    tables(spark, tmp_path / "t2", rows + more, parts)
    state = str(tmp_path / "state")
    first = run(tmp_path / "t1", state)
    assert first == [("bolt", "nut", 2, 0.6667), ("bolt", "rod", 1, 0.3333), ("nut", "rod", 1, 0.5)]
    assert run(tmp_path / "t1", state) == first
    second = run(tmp_path / "t2", state)
    assert second == run(tmp_path / "t2", str(tmp_path / "whole"))
    assert sorted(os.listdir(f"{state}/pairs")) == ["_SUCCESS", "run=1", "run=2"] or {"run=1", "run=2"} <= set(os.listdir(f"{state}/pairs"))
    # A run that died before its mark is made again under its number.
    shutil.rmtree(f"{state}/marks/run=2")
    assert run(tmp_path / "t2", state) == second
    tables(spark, tmp_path / "t0", [], parts)
    assert run(tmp_path / "t0", str(tmp_path / "none")) == []

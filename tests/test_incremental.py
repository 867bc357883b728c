"""The incremental graph equals a full resolution after any sequence of changes."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import incremental, resolve

MENTION = "content_hash string, doc_ord bigint, mention_ord int, text string, label string, doc_date date"
NAMES = [("Ann Bee", "person"), ("Bee", "person"), ("Carl Dee", "person"), ("Dee", "person"), ("Eve Dee", "person"), ("Acme Works", "organization"), ("Acme", "organization"), ("Rover", "misc"), ("Lander", "misc"), ("Deep Field", "concept"), ("The Deep Fields", "misc"), ("Orbit", "misc"), ("Zenith", "misc")]


def document(rng, i):
    day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(200))
    picks = [rng.choice(NAMES) for _ in range(rng.randrange(0, 6))]
    return [(f"d{i}", i, k, n, t, day) for k, (n, t) in enumerate(picks)]


def whole(spark, docs, corrections):
    rows = spark.createDataFrame([r for d in docs.values() for r in d], MENTION)
    keyed = resolve.keyed_mentions(rows, corrections)
    first = resolve.node_rollup(keyed)
    merges = resolve.closed(resolve.unique_partial_names(first).unionByName(resolve.shared_email(first)))
    moved = resolve.apply_merges(keyed, merges)
    nodes = resolve.prune_weak(resolve.node_rollup(moved).drop("canonical_name", "type").join(first.select("node_key", "canonical_name", "type"), "node_key"))
    return nodes, resolve.with_strength(resolve.cooccurrence(moved), nodes)


def plain(df):
    cols = sorted(df.columns)
    return sorted(map(str, df.select(*cols).collect()))


def same(spark, path, docs, corrections):
    nodes, edges = whole(spark, docs, corrections)
    got = incremental.nodes(spark, path)
    assert plain(got) == plain(nodes)
    assert plain(incremental.edges(spark, path, got)) == plain(edges)


def corrected(spark, rows):
    return spark.createDataFrame(rows, "kind string, surface string, canonical string")


def test_runs_equal_a_full_resolution(spark, tmp_path):
    rng, path, docs = random.Random(5), str(tmp_path / "state"), {}

    def take(changed, corrections=None, drop=()):
        docs.update(changed)
        for d in drop:
            docs[d] = []
        rows = spark.createDataFrame([r for c in changed.values() for r in c], MENTION)
        listed = spark.createDataFrame([(c,) for c in [*changed, *drop]], "content_hash string")
        incremental.update(spark, path, rows, listed, corrections)
        same(spark, path, docs, corrections)

    take({f"d{i}": document(rng, i) for i in range(12)})
    take({f"d{i}": document(rng, i) for i in (3, 12, 13, 14)}, drop=["d5"])  # one changed, three new, one emptied
    one = corrected(spark, [("merge", "Rover", "Lander"), ("ignore", "Zenith", None)])
    incremental.update(spark, path, corrections=one)
    same(spark, path, docs, one)
    two = corrected(spark, [("merge", "Eve Dee", "Carl Dee")])  # frees the partial name Dee, takes the first merge back
    incremental.update(spark, path, corrections=two)
    same(spark, path, docs, two)
    # Nothing changed: nothing is written but the mark.
    run = incremental.update(spark, path, corrections=two)
    assert spark.read.parquet(f"{path}/pairs/run={run}").count() == 0 == spark.read.parquet(f"{path}/nodes/run={run}").count()
    same(spark, path, docs, two)
    incremental.compacted(spark, path, str(tmp_path / "new"))
    same(spark, str(tmp_path / "new"), docs, two)
    incremental.update(spark, str(tmp_path / "new"), corrections=None)
    same(spark, str(tmp_path / "new"), docs, None)


def test_a_correction_touches_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = [(f"d{i}", i, k, f"Name{(i + k) % 40} Word", "concept", None) for i in range(80) for k in range(3)]
    incremental.update(spark, path, spark.createDataFrame(rows, MENTION), spark.createDataFrame([(f"d{i}",) for i in range(80)], "content_hash string"))
    run = incremental.update(spark, path, corrections=corrected(spark, [("merge", "Name7 Word", "Name8 Word")]))
    assert spark.read.parquet(f"{path}/rekeyed/run={run}").count() == 6
    assert {r[0] for r in spark.read.parquet(f"{path}/nodes/run={run}").select("node_key").collect()} <= {f"name{i} word" for i in range(4, 12)}


@pytest.mark.parametrize("lost", ["marks"])
def test_a_run_without_its_mark_is_made_again(spark, tmp_path, lost):
    rng, path = random.Random(8), str(tmp_path / "state")
    docs = {f"d{i}": document(rng, i) for i in range(8)}
    rows = spark.createDataFrame([r for d in docs.values() for r in d], MENTION)
    listed = spark.createDataFrame([(d,) for d in docs], "content_hash string")
    incremental.update(spark, path, rows, listed)
    before = plain(incremental.nodes(spark, path))
    corrections = corrected(spark, [("merge", "Orbit", "Zenith")])
    run = incremental.update(spark, path, corrections=corrections)
    os.rename(f"{path}/{lost}/run={run}", tmp_path / "taken away")
    assert plain(incremental.nodes(spark, path)) == before
    assert incremental.update(spark, path, corrections=corrections) == run
    same(spark, path, docs, corrections)


def test_an_empty_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert incremental.update(spark, path) == 1
    assert incremental.nodes(spark, path).count() == 0
    assert incremental.edges(spark, path, incremental.nodes(spark, path)).select(F.sum("weight")).first()[0] is None

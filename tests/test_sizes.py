"""What travels and what a task holds: the shape of plans, and rows shuffled, with results against brute force."""

import re
import uuid
from collections import Counter
from itertools import combinations

from graphloom.operators import extract, graph, incremental, resolve
from graphloom.plans import testgraph as G


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(spark):
    """Rows written to shuffles since the session began."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_cooccurrence_is_one_sort(spark):
    rows = [("a", "x"), ("a", "y"), ("a", "y"), ("a", "z"), ("b", "y"), ("b", "x"), ("c", "x"), ("d", None), ("d", "x"), ("e", None), ("e", "x"), ("e", "y"), (None, "x"), (None, "z"), *(("f", f"k{i}") for i in range(5))]
    df = spark.createDataFrame(rows, "content_hash string, node_key string")
    got = resolve.cooccurrence(df, most=4)
    want = Counter()
    for d in {r[0] for r in rows}:
        keys = {k for x, k in rows if x == d}
        if 2 <= len(keys) <= 4:
            want.update(combinations(sorted(k for k in keys if k), 2))
    assert {(r.a, r.b): r.weight for r in got.collect()} == dict(want)
    assert "ObjectHashAggregate" not in plan(got) and plan(got).count("- Sort [") == 1 and "REPARTITION_BY_NUM" in plan(got)


def test_texts_of_typed_edges_and_nodes_come_from_few_rows(spark, sf):
    rows = spark.createDataFrame([("a", "r", "b", "late", "h2", 2, 0), ("a", "r", "b", "second", "h1", 1, 5), ("a", "r", "b", "first", "h1", 1, 3), ("a", "r", "a", "self", "h0", 0, 0), ("b", "r", "a", "none", "h9", None, 1), ("b", "r", "a", "one", "h1", 1, 1)], "src string, relation string, dst string, evidence string, content_hash string, doc_ord bigint, s1 int")
    got = resolve.typed_edges(rows)
    assert sorted((r.src, r.dst, r.weight, r.evidence, r.source) for r in got.collect()) == [("a", "b", 3, "first", "h1"), ("b", "a", 2, "none", "h9")]
    nodes = resolve.node_rollup(G.mentions(spark, sf), G.documents(spark, sf))
    for text in (plan(got), plan(nodes)):
        # The aggregate of texts stands above the join that leaves few rows.
        assert "Join" in text[text.rindex("partial_min_by") :]


def test_two_hop_pairs_are_aggregated_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (2, 1), (5, 5), (1, 5)], "src_id bigint, dst_id bigint")
    got = graph.two_hop_pairs(edges, spark.createDataFrame([(1,), (5,)], "id bigint"))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 2), (5, 2, 1), (5, 4, 1)]
    assert "LeftAnti" not in plan(got)


def test_relations_shuffle_mentions_once(spark):
    docs = spark.createDataFrame([("d", "Acme sells Lens and Net. Bolt sells Gear.")], "content_hash string, text string")
    said = [("Acme", "organization"), ("Lens", "product"), ("Net", "product"), ("Bolt", "organization"), ("Gear", "product")]
    text = docs.first().text
    mentions = spark.createDataFrame([("d", t, l, text.index(t), text.index(t) + len(t)) for t, l in said] + [("d", "Gone", "product", None, None)], "content_hash string, text string, label string, start_char int, end_char int")
    got = extract.relations(docs, mentions)
    assert sorted((r.subject, r.relation, r.object) for r in got.collect()) == [("Acme", "supplies", "Lens"), ("Acme", "supplies", "Net"), ("Bolt", "supplies", "Gear")]
    assert "RangeFrame" in plan(got.select("*")) and "bucket" not in plan(got.select("*"))


def test_new_documents_are_shuffled_few_times(spark, sf, tmp_path):
    """A first run shuffles its mentions once for the roll-ups and once for the pairs; the pairs of four tasks add 1.3 rows a mention here."""
    rows = G.mentions(spark, sf).join(G.documents(spark, sf).select("content_hash", "doc_date"), "content_hash").localCheckpoint()
    docs = G.documents(spark, sf).select("content_hash").localCheckpoint()
    before = shuffled(spark)
    incremental.take(spark, f"{tmp_path}/{uuid.uuid4().hex}", rows, docs)
    assert shuffled(spark) - before < 4.2 * rows.count()


def test_rules_of_names_are_evaluated_once_a_text(spark):
    rows = [("d1", 1, i, t, "person") for i, t in enumerate(["Ann Bee", "Ann Bee", None, "Ann Bee Contact : ann@bee.org", "x"] * 3)]
    mentions = spark.createDataFrame(rows, "content_hash string, doc_ord bigint, mention_ord int, text string, label string")
    names = resolve.named_texts(mentions)
    assert names.count() == 3
    got = resolve.keyed_mentions(mentions)
    assert sorted((r.text, r.name, r.email, r.node_key, r.canonical) for r in got.collect()) == 3 * [("Ann Bee", "Ann Bee", None, "ann bee", "Ann Bee")] * 2 + 3 * [("Ann Bee Contact : ann@bee.org", "Ann Bee", "ann@bee.org", "ann bee", "Ann Bee")]


def test_words_no_surface_begins_with_stay_in_the_text(spark):
    docs = spark.createDataFrame([("d", "élan İstanbul the ÉTÉ été zoo")], "content_hash string, text string")
    got = extract._starts(docs, 1, 0, 0, frozenset({"the", "été"}))
    assert [(r.start, r.word) for r in got.collect()] == [(5, "İstanbul"), (14, "the"), (18, "ÉTÉ"), (22, "été")]


def test_relations_read_pieces_of_long_texts(spark):
    sells, filler = "𝄞 Acme sells Lens é . ", "word 𝄞 é\n" * 7
    texts = {"long": "".join(filler[: i % 61] + sells for i in range(400)), "edge": "x" * (extract.PIECE - 6) + sells, "empty": "", "none": None}
    rows = [(d, w, l, m.start(), m.end()) for d, t in texts.items() for w, l in (("Acme", "organization"), ("Lens", "product"), ("word", "misc")) for m in re.finditer(w, t or "")]
    docs = spark.createDataFrame(list(texts.items()), "content_hash string, text string")
    mentions = spark.createDataFrame([*rows, ("empty", "Acme", "organization", 3, 7), ("empty", "Lens", "product", 9, 13)], "content_hash string, text string, label string, start_char int, end_char int")
    got = extract.relations(docs, mentions)
    want = []
    for d, _, l1, s1, e1 in rows:
        for d2, _, l2, s2, e2 in rows:
            if d == d2 and l1 == "organization" and l2 != "misc" and 0 < s2 - e1 <= extract.MAX_GAP and "sells" in (gap := texts[d][e1:s2]) and ". " not in gap:
                tail = texts[d][e2 : e2 + extract.TAIL]
                said = texts[d][s1:e2] + tail[: m.start() + 1 if (m := re.search(r"[.!?]\s", tail)) else None]
                want.append((d, "supplies", re.sub(r"\s+", " ", said).strip()[:240], s1))
    assert len(want) > 400 and sorted((r.content_hash, r.relation, r.evidence, r.s1) for r in got.collect()) == sorted(want)
    # No pair counts its place from the start of the text.
    assert "regexp_extract_all" in plan(got) and "substr(body" not in plan(got)


def test_numbered_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    got = resolve.number(spark.range(100, numPartitions=3).mapInArrow(count, "id bigint").withColumnRenamed("id", "k"), "k")
    assert sorted((r.k, r.id) for r in got.collect()) == [(i, i + 1) for i in range(100)]
    assert made.value == 100

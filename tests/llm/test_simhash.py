"""Fingerprints, covering and groups against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import components, neardup, simhash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def closure(ids, near):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_native_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ab cd"))).first()[0] == np.uint64(xxhash.xxh64_intdigest(b"ab cd", 42)).astype(np.int64)


def test_groups(docs, rows):
    rows = [r for r in rows if r[0] is not None]
    fp = {i: slow_fingerprint(t) for i, t in rows}
    near = [(a, b) for a in fp for b in fp if (fp[a] ^ fp[b]).bit_count() <= 3]
    want = closure(fp, near)
    got = simhash.groups(docs.where("doc_id is not null")).collect()
    assert {(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got} == {(i, fp[i], want[i]) for i in fp}
    assert len(got) == len(rows)


def test_ids_that_are_null(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, t), (7, t), (None, "alone here"), (3, t + " x"), (None, None), (5, "")], "doc_id bigint, text string")
    fps = {r: slow_fingerprint(r) for r in (t, "alone here", t + " x", None, "")}
    near = (fps[t] ^ fps[t + " x"]).bit_count() <= 3
    got = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.groups(df).collect()), key=str)
    low = 3 if near else 7
    assert got == sorted([(None, fps[t], low), (7, fps[t], low), (None, fps["alone here"], None), (3, fps[t + " x"], 3), (None, 0, 5), (5, 0, 5)], key=str)


@pytest.mark.parametrize("limit", [1 << 12, 5, 2])
def test_every_pair_meets_at_an_anchor(spark, limit):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base:
        for _ in range(6):
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            fps.add(int(x) ^ int(sum(1 << int(b) for b in bits)))
    # One dense group: all of it at the same anchors.
    for _ in range(60):
        fps.add(int(base[0]) ^ int(sum(1 << int(b) for b in rng.choice(32, 3, replace=False))))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    links = simhash.link(simhash.place(spark.createDataFrame([(s,) for s in signed], "fp bigint")), limit=limit)
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    got = [(r["a"], r["b"]) for r in links.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in got)
    assert closure(signed, got) == closure(signed, pairs)


def test_hamming_code_covers():
    rng = np.random.default_rng(1)
    half = rng.integers(0, 1 << 32, 500, dtype=np.uint32)
    anchors = simhash.home(half)
    assert (np.bitwise_count(anchors ^ half) <= 1).all() and (simhash.syndrome(anchors) == 0).all()
    assert (np.bitwise_count(simhash.replicas(half) ^ half[:, None]) <= 2).all()


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_chain(spark, n):
    e = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1, 0), (7, 7)], "u bigint, v bigint")
    assert {(r["id"], r["component"]) for r in components.components(e).collect()} == {(i, 0) for i in range(n + 1)}
    assert components.components(e.limit(0)).count() == 0


def test_empty(docs):
    assert simhash.groups(docs.limit(0)).count() == 0
    assert neardup.dedup(docs.limit(0)).count() == 0


def jaccard(a, b):
    s = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        s.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(s[0] & s[1]) / len(s[0] | s[1]) if s[0] | s[1] else 1.0


def test_near_dedup_keeps_one_of_each_group(docs, rows):
    known = [r for r in rows if r[0] is not None]
    text = dict(known)
    near = [(a, b) for a in text for b in text if (text[a] or "") == (text[b] or "") or jaccard(text[a], text[b]) >= 0.8]
    want = closure(text, near)
    got = neardup.dedup(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in set(ids) if i is not None) == sorted({want[i] for i in text})
    assert ids.count(2) == 2 and ids.count(None) == 1


def test_near_dedup_of_a_large_group_of_near_copies(spark):
    import random

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    base = [word() for _ in range(160)]
    texts = {}
    for i in range(150):
        w = base[:]
        for _ in range(1 + i % 7):
            w[rng.randrange(160)] = word()
        texts[i] = " ".join(w)
    texts |= {i: " ".join(word() for _ in range(100)) for i in range(200, 240)}
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    near = [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    want = set(closure(texts, near).values())
    got = {r["doc_id"] for r in neardup.dedup(df).collect()}
    assert want <= got and len(got - want) <= 0.05 * (len(texts) - len(want))


def test_links_of_a_large_group_are_few(spark):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in base)) for i in range(250)]
    marked = neardup.sketches(spark.createDataFrame(rows, "doc_id bigint, text string")).select("ones", "two").distinct()
    links = [(r["a"], r["b"]) for r in neardup.candidates(marked).collect()]
    ids = [r["two"] for r in marked.collect()]
    assert len(set(closure(ids, links).values())) < 10  # nearly all are joined
    assert len(links) < 2 * len(ids)


def test_thinned_links_join_the_same(spark):
    rng = np.random.default_rng(9)
    ends = rng.integers(-(2**63), 2**63 - 1, 300)
    links = {(int(min(a, b)), int(max(a, b))) for i in range(0, 300, 60) for a, b in rng.choice(ends[i : i + 60], (200, 2)) if a != b}
    links |= {(int(ends[:60].min()), int(x)) for x in ends[1:60] if x != ends[:60].min()}
    df = spark.createDataFrame([*links, *links], "parent bigint, child bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # a child's parents lie in several batches
    try:
        got = [(r["a"], r["b"]) for r in neardup.thin(df).collect()]
        assert neardup.thin(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    ids = ends.tolist()
    assert closure(ids, got) == closure(ids, links)
    assert len(got) < len(links)


def test_near_dedup_finds_every_block_edit(spark, monkeypatch):
    import random

    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 1)  # every shingle known to repeat is dealt over blocks
    rng = random.Random(11)
    texts, want = {}, set()
    for i in range(450):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 300))]
        n = len(w) // 6 - 4
        more = [f"w{rng.randrange(4000)}" for _ in range(n)]
        at = rng.randrange(len(w) - n // 2)
        edited = (w + more, w[: len(w) - n], w[:at] + more[: n // 2] + w[at + n // 2 :])[i % 3]
        line = ["one", "line", "that", "all", "have", "in", "common"]
        texts[2 * i], texts[2 * i + 1] = " ".join(line + w), " ".join(line + edited)
        want |= {2 * i} | ({2 * i + 1} if jaccard(texts[2 * i], texts[2 * i + 1]) < 0.8 else set())
    assert len(want) < 600
    got = [r["doc_id"] for r in neardup.dedup(spark.createDataFrame([*texts.items()], "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(want)


def test_no_pair_depends_on_the_sample_of_shingles(spark, monkeypatch):
    import random

    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(3000)}"
    line, texts = ["a", "line", "that", "all", "of", "them", "have"], {}
    for i in range(60):
        w = line + [word() for _ in range(rng.randrange(5, 120))]
        cut = rng.randrange(len(w) // 5 + 2)
        texts[3 * i], texts[3 * i + 1], texts[3 * i + 2] = (" ".join(t) for t in (w, w[: len(w) - cut], w + [word() for _ in range(cut)]))
    want = closure(texts, [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8])
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    common = neardup.common_shingles

    def upside_down(data, n):
        keys, counts = common(data, n)
        return keys, counts.max() + 1 - counts

    # Without fingerprints, whatever is joined comes from leading shingles.
    monkeypatch.setattr(neardup, "candidates", lambda distinct: spark.createDataFrame([], "a bigint, b bigint"))
    for known in (common, upside_down, lambda data, n: (np.array([], np.uint64), np.array([], np.int64))):
        monkeypatch.setattr(neardup, "common_shingles", known)
        got = {r["doc_id"]: r["component_id"] for r in neardup.duplicates(df).collect()}
        assert got == {i: c for i, c in want.items() if i != c} and len(got) > 60


def test_clusters_are_compared_in_blocks(spark):
    rng = np.random.default_rng(2)
    sets = {i: sorted(set(rng.choice(60, 25, replace=False).tolist())) for i in range(60)}
    sets |= {100 + i: sorted({*sets[i][:-1], 77}) for i in range(0, 60, 3)}
    near = [(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})]
    pairs = [(i, np.array(s, np.int64)) for i, s in sets.items()]
    assert closure(sets, neardup._similar(pairs, pairs, True)) == closure(sets, near)
    wide = {i: [x + 1000 * k for x in s for k in range(200)] for i, s in sets.items()}  # several blocks
    members = spark.createDataFrame([(7, i, s) for i, s in wide.items()], "cluster bigint, node bigint, shingles array<bigint>")
    assert sum(map(len, wide.values())) / neardup.BLOCK > 0.5
    got = [(r["u"], r["v"]) for r in neardup.inside_clusters(members.unionByName(members.selectExpr("8 AS cluster", "node + 1000 AS node", "shingles"))).collect()]
    both = near + [(a + 1000, b + 1000) for a, b in near]
    assert closure([*sets, *(i + 1000 for i in sets)], got) == closure([*sets, *(i + 1000 for i in sets)], both)


def test_ids_of_all_64_bits(spark):
    text, other = "one two three four five six", "another text that stands alone here"
    rows = [(2**62, text), (2**63 - 1, text), (-(2**63), other), (None, "no id has this text at all"), (None, text)]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(2**62, 2**62), (2**63 - 1, 2**62), (-(2**63), -(2**63)), (None, None), (None, 2**62)}

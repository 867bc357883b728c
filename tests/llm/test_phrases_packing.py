"""Collocations and packing against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import packing, phrases

# ------------------------------------------------------------- collocations


def brute_collocations(rows, least=10, longest=3, top=2000, covered=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= covered * counts[p[i : i + m]]:
                        gone.add(p[i : i + m])
        scored = []
        for p, a in good.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def texts(seed, documents=60):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "é", "ab", "Cd", "ef", "gh", "a|b", "日本", "x'y", "zz", "is", "onhe"]
    weights = [9, 9, 6, 3, 3, 3, 2, 2, 1, 1, 1, 1, 5, 5]
    gaps = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! ", "\r\n", "\x0b"]
    out = [("en", None), (None, "null lang here " * 12), ("en", ""), ("de", " \t. ,"), ("en", "again " * 40), ("und", "null lang here.null lang")]
    for _ in range(documents):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 120))
        out.append((rng.choice(["en", "en", "de", None]), "".join(w + rng.choice(gaps) for w in words)))
    return out + [out[-1]] * 3


@pytest.mark.parametrize(("shard", "longest"), [(40, 3), (1 << 20, 3), (300, 5)])
def test_collocations_equal_brute_force(spark, shard, longest):
    rows = texts(shard)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "'x' AS shard", "'y' AS words", "1 AS h", "'z' AS phrase").repartition(3)
    got = sorted(map(tuple, phrases.collocations(df, words=shard, longest=longest).collect()))
    assert got == brute_collocations(rows, longest=longest) and len(got) > 30


def test_collocations_top_and_ties(spark):
    rows = [("en", "b a. c a. a b. a c.") for _ in range(12)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), top=3)
    assert [(r["rank"], r["phrase"]) for r in got.orderBy("rank").collect()] == [(1, "a b"), (2, "a c"), (3, "b a")]


def test_collocations_of_long_texts_and_none(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdef") for _ in range(30_000))
    rows = [("en", long), ("en", "x" * 50_000)]
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), words=1000).collect())) == brute_collocations(rows)
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_counts_beyond_64_bits(spark):
    a = 3 * 10**12
    counts = spark.createDataFrame([("en", "p q", a)], "lang string, phrase string, a bigint")
    single = spark.createDataFrame([("en", "p", a + 7), ("en", "q", a + 11)], "lang string, phrase string, a bigint")
    total = spark.createDataFrame([("en", 9 * a)], "lang string, n bigint")
    assert phrases.scored(counts, single, total, None, 50).first()["score"] == 1000000 * a * a // ((a + 7) * (a + 11))


# ------------------------------------------------------------------ packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def pieces(tokenizer, rows, limit):
    out = Counter()
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        n = len(ids)
        cuts = [0, n] if n <= limit else [0, *range(n % limit or limit, n + 1, limit)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[(key, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    return out


def check_places(rows, limit):
    """Gapless sequences of at most ``limit`` tokens; returns how many."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


@pytest.mark.parametrize("limit", [64, 2048])
def test_packing_equals_brute_force(docs, rows, tokenizer, limit):
    got = packing.pack(docs, PATH, limit=limit).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces(tokenizer, rows, limit)
    used, tokens = check_places(got, limit), sum(r["length"] for r in got)
    assert used <= 1.03 * -(-tokens // limit) + 1


def test_packing_of_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_chunks_give_the_tokenizers_ids(tokenizer):
    rng, chunks = random.Random(1), packing.Chunks(PATH)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\xa0", " ", "a", "word", "1", "12", ".", ",", "'s", "'", "é", "日本", "<|endoftext|>", "...", "\r\n", "½", "²", "_", "\x85", "​", " the", " of", " x"]
    for _ in range(60):
        batch = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(20)]
        assert chunks.encode(batch) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]


def test_bytes_that_are_not_utf8_are_replaced(spark, tokenizer):
    df = spark.sql("SELECT 1L AS doc_id, cast(x'61ff62' AS string) AS text")
    n = packing.pack(df, PATH).first()["length"]
    assert n == len(tokenizer.encode("a�b", add_special_tokens=False).ids) + 1


def best_fit_decreasing(hist, limit):
    import bisect

    rooms, n = [], 0
    for s in sorted(hist, reverse=True):
        for _ in range(hist[s]):
            i = bisect.bisect_left(rooms, s)
            r = rooms.pop(i) if i < len(rooms) else limit
            n += r == limit
            if r > s:
                bisect.insort(rooms, r - s)
    return n


@pytest.mark.parametrize(("seed", "n", "low", "high"), [(1, 50, 1, 2048), (2, 3000, 1, 2048), (3, 3000, 300, 1500), (4, 4000, 650, 720), (5, 1, 5, 5), (6, 5000, 1, 100), (7, 2000, 2048, 2048), (8, 3000, 1025, 1100)])
def test_plan_places_each_rank_once(seed, n, low, high):
    rng = random.Random(seed)
    hist = Counter(rng.randint(low, high) for _ in range(n))
    plan = packing.plan(dict(hist))
    ranks, fill = defaultdict(list), defaultdict(list)
    for i in plan:
        ranks[i.size].append((i.rank, i.count))
        for j in range(i.count):
            fill[i.sequence + j].append((i.offset, i.size))
    for size, count in hist.items():
        at = 0
        for rank, k in sorted(ranks[size]):
            assert rank == at
            at += k
        assert at == count
    assert set(ranks) == set(hist)
    for places in fill.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= 2048
    assert len(fill) <= 1.01 * best_fit_decreasing(hist, 2048) + 1
    assert len(plan) <= 6 * 2048  # bounded by the lengths there are, not by the pieces


def test_plan_grows_with_lengths_not_with_pieces():
    rng = random.Random(9)
    hist = Counter(rng.randint(1, 2047) for _ in range(5000))
    large = packing.plan({s: n * 1_000_000 for s, n in hist.items()})
    assert len(large) <= 6 * 2048
    sequences = max(i.sequence + i.count for i in large)
    assert sequences <= 1.02 * sum(s * n * 1_000_000 for s, n in hist.items()) / 2048
    assert sum(i.count for i in large) == 5_000_000_000


def test_all_documents_come_back_as_queries(spark, sf):
    from graphloom.llm import registry

    got = registry.op12_packing(spark, sf)
    total = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.where("piece = 0").count() == total.count()
    sums = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"))
    assert sums.where("n <> end").isEmpty()

"""Registered queries without SQL against plain versions over the whole table."""

import re
from collections import Counter

import graphloom.plans.more  # noqa: F401
from graphloom.operators import extract
from graphloom.plans.registry import LEXICON, QUERIES


def known(text, surfaces):
    found = re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(surfaces, key=len, reverse=True))) + r")(?!\w)", text, re.I)
    return [(surfaces[m.group().lower()], m.start(), m.end()) for m in found if " " in m.group() or m.group()[0].isupper()]


def test_mentions_and_proper_nouns_equal_plain_versions(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    surfaces = {s: (c, t) for s, c, t in re.findall(r"\('([^']*)', '([^']*)', '([^']*)'\)", LEXICON)}
    nouns, hybrid = Counter(), Counter()
    for r in rows:
        text = r["text"] or ""
        own = [((name, label), s, e) for name, label, s, e in extract.proper_nouns(text)]
        taken = known(text, surfaces)
        nouns.update((str(r["doc_id"]), *what, s, e) for what, s, e in own)
        free = [x for x in own if not any(x[1] < e and s < x[2] for _, s, e in taken)]
        hybrid.update((str(r["doc_id"]), *what, s, e) for what, s, e in taken + free)
    cols = ("content_hash", "text", "label", "start_char", "end_char")
    assert Counter(map(tuple, QUERIES["proper_nouns"](spark, sf).select(*cols).collect())) == nouns
    got = QUERIES["mentions_hybrid"](spark, sf).select(*cols, "mention_ord").collect()
    assert Counter(tuple(r)[:5] for r in got) == hybrid and sum(hybrid.values()) > 200
    by = Counter(r["content_hash"] for r in got)
    assert {(r["content_hash"], r["mention_ord"]) for r in got} == {(h, k) for h, n in by.items() for k in range(1, n + 1)}

"""Repeated windows against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import substring, suffix
from graphloom.llm.windows import Shape


def brute(rows, length, words):
    """(doc_id, n, n_removed, n_spans, sha256) by looking at every window."""
    low, count, units = {}, Counter(), []
    for i, t in rows:
        data = (t or "").encode()
        u = data.split() if words else data
        units.append(u)
        for k in range(len(u) - length + 1):
            w = tuple(u[k : k + length]) if words else u[k : k + length]
            count[w] += 1
            low[w] = min(low.get(w, 1 << 62), 1 << 61 if i is None else i)
    out = []
    for (i, _), u in zip(rows, units, strict=True):
        gone = np.zeros(len(u) + 1, bool)
        for k in range(len(u) - length + 1):
            w = tuple(u[k : k + length]) if words else u[k : k + length]
            if (low[w] < (1 << 61 if i is None else i)) if words else count[w] > 1:
                gone[k : k + length] = True
        mask = gone[: len(u)]
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        kept = b" ".join(w for w, g in zip(u, mask, strict=True) if not g) if words else bytes(np.frombuffer(u, np.uint8)[~mask])
        out.append((i, len(u), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [512, 2, 1])
@pytest.mark.parametrize(("module", "words"), [(substring, True), (suffix, False)])
def test_reports_match_brute_force(docs, rows, module, words, bucket):
    length = module.WINDOW
    got = [tuple(r) for r in module.dedup_report(docs, bucket=bucket).collect()]
    assert sorted(got, key=str) == brute(rows, length, words)


@pytest.mark.parametrize("module", [substring, suffix])
def test_empty_table(docs, module):
    assert module.dedup_report(docs.limit(0)).count() == 0
    assert module.dedup(docs.limit(0)).columns == docs.columns


def test_dedup_keeps_columns_and_white_space(docs, rows):
    got = substring.dedup(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    assert text[42] is None and text[43] == "" and text[44] == " \t\n"
    assert text[0] == dict(rows)[0] and "\n" in text[30]
    assert not text[40].strip()  # a copy of document 3


@pytest.mark.parametrize("shape", [Shape(True, 50, 16, True), Shape(False, 400, 128, False), Shape(False, 40, 8, False)])
def test_runs_cover_every_window_once(shape):
    rng = random.Random(1)
    for n in (0, shape.length - 1, shape.length, shape.length + 1, 3000):
        units = [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]
        units = units if shape.words else b"".join(units)
        start, windows, _, spot = shape.runs(units)
        assert windows.sum() == max(0, n - shape.length + 1)
        assert list(start) == list(np.cumsum([0, *windows])[:-1])
        assert all(s <= p and p + shape.gram <= s + shape.length or w > 1 for s, w, p in zip(start, windows, spot, strict=True))


def test_anchors_do_not_depend_on_the_block(monkeypatch):
    from graphloom.llm import windows as W

    shape, rng = Shape(False, 40, 8, False), random.Random(2)
    data = bytes(rng.randrange(4) for _ in range(2000))
    whole = shape.runs(data)
    each = np.repeat(whole[3], whole[1])
    monkeypatch.setattr(W, "SPAN", 97)
    parts = shape.runs(data)
    assert list(np.repeat(parts[3], parts[1])) == list(each)


def test_multikey_quicksort_classes():
    rng = random.Random(5)
    rows = [(bytes(rng.randrange(2) for _ in range(3)) * 134, i) for i in range(60)]
    want = sorted(sorted(i for r, i in rows if r == w) for w in {r for r, _ in rows})
    assert sorted(sorted(c) for c in suffix.multikey_quicksort(rows) if len(c) > 1) == [w for w in want if len(w) > 1]
    assert sorted(sorted(c) for c in substring.sort_windows(list(rows))) == [w for w in want if len(w) > 1]

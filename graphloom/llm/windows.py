"""Repeated fixed-length windows: minimisers, candidate search and the way back to documents.

A window of ``length`` units (words or bytes) holds ``length - gram + 1`` grams;
its minimiser, or anchor, is the gram with the smallest hash, the leftmost on a
tie.  Equal windows have equal anchors at equal offsets, so a window can only
repeat if its anchor does.  The search goes in four steps:

1. a narrow scan emits the hash of every anchor of every document;
2. anchors that occur more than once (in more than one document, if asked) are
   found by an aggregation, and go back to their documents by equi-joins;
3. in those documents alone, each run of consecutive windows that shares a
   repeated anchor is packed as one string (equal strings of a task are merged)
   and its place noted, in one pass that is written once; the strings travel to
   buckets, which decide about each window exactly, on the strings themselves;
4. decisions travel back by the string's 128-bit fingerprint and are applied.

How strings are dealt to buckets is the operators' choice (:class:`Deal`).  A
bucket takes ``BUCKET`` strings at most: what belongs together but does not fit
is cut in pieces.  A piece decides what it can by itself (a window that repeats
inside it) and hands on one row for each *distinct* window, which meets those of
other pieces by 128-bit fingerprints; so no group grows without bound, and the
rows handed on follow the distinct windows of a piece, not its strings.
A document is known by its id and a hash of its row; a null id counts as the
greatest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_stage, cut, drop_cut, in_batches, mix64, text_bytes

#: Strings of a bucket, at most (of an anchor dealt by hash: occurrences for each bucket, about).
BUCKET = 1 << 13
#: Windows worked on at once in a long document.
SPAN = 1 << 20
#: Bytes of packed strings merged in a task before they are handed on.
MERGE = 16 << 20
NULL_ID = (1 << 63) - 1
_INDEX = np.uint64((1 << 24) - 1)


class WordHash(dict):
    """64-bit hashes of words, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = WordHash()
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Shape:
    """What a window is; ``gram`` is a power of two."""

    words: bool
    length: int
    gram: int
    across: bool  # a repeat counts only in a document with a smaller id

    def units(self, data: bytes) -> list[bytes] | bytes:
        return data.split() if self.words else data

    def pack(self, units, start: int, end: int) -> bytes:
        return b" ".join(units[start:end]) if self.words else units[start:end]

    def edges(self, string: bytes):
        """Where each unit of a packed string starts, and one past the last (with the space that would follow a word)."""
        if not self.words:
            return range(len(string) + 1)
        spaces = np.flatnonzero(np.frombuffer(string, np.uint8) == 32)
        return np.concatenate([[0], spaces + 1, [len(string) + 1]]).astype(np.int32)

    def hashes(self, units) -> np.ndarray:
        """Hash of the gram that starts at each unit."""
        if self.words:
            h = np.fromiter(map(_WORDS.__getitem__, units), np.uint64, len(units))
        else:
            h = _BYTES[np.frombuffer(units, np.uint8)]
        size = 1
        while size < self.gram:
            h = h[:-size] * np.uint64(0xBF58476D1CE4E5B9 + 2 * size) + h[size:]
            h ^= h >> np.uint64(29)
            size *= 2
        return mix64(h)

    def runs(self, units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, anchor hash, anchor's place) of each run of windows with one anchor."""
        total, starts, counts, anchors, spots = len(units) - self.length + 1, [], [], [], []
        width = self.length - self.gram + 1
        for at in range(0, max(0, total), SPAN):
            n = min(SPAN, total - at)
            h = self.hashes(units[at : at + n + self.length - 1])
            low = (h & ~_INDEX) | np.arange(len(h), dtype=np.uint64)
            size = 1
            while 2 * size <= width:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if size < width:
                low = np.minimum(low[: size - width], low[width - size :])
            where = low & _INDEX
            first = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1])
            starts.append(first + at)
            counts.append(np.diff(np.append(first, n)))
            anchors.append(h[where[first]].view(np.int64))
            spots.append(where[first].astype(np.int64) + at)
        if not starts:
            return (np.array([], np.int64),) * 4
        return tuple(np.concatenate(x) for x in (starts, counts, anchors, spots))

    def lead(self, units, spot: int) -> int:
        """The first eight bytes of the anchor, as a number that sorts like them."""
        return 0 if self.words else int.from_bytes(units[spot : spot + 8], "big") - (1 << 63)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    data = text_bytes(text)
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("dk"), F.xxhash64(F.col(key).cast("long"), data).alias("th"), data.alias("data"))


def scan(docs: DataFrame, shape: Shape) -> DataFrame:
    """(dk, th, n, sha, anchors, times) of every document; sha is of its units, words joined by one space."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, anchors, times = [], [], [], []
        for data in batch.column("data").to_pylist():
            units = shape.units(data)
            n.append(len(units))
            sha.append(hashlib.sha256(shape.pack(units, 0, len(units))).hexdigest())
            own, count = np.unique(shape.runs(units)[2], return_counts=True)
            anchors.append(own)
            times.append(count)
        return pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("th"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), _lists(anchors), _lists(times)], names=["dk", "th", "n", "sha", "anchors", "times"])

    return arrow_stage(docs, run, "dk bigint, th bigint, n bigint, sha string, anchors array<bigint>, times array<bigint>")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.array([], np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def candidates(keyed: DataFrame, scanned: DataFrame, shape: Shape, bucket: int) -> DataFrame:
    """(dk, th, data, found): documents with repeated anchors; found: (anchor, number of buckets)."""
    marks = scanned.select("dk", "th", F.explode(F.arrays_zip("anchors", "times")).alias("m")).select("dk", "th", F.col("m.anchors").alias("anchor"), F.col("m.times").alias("times"))
    count = marks.groupBy("anchor").agg(F.sum("times").alias("c"), F.min("dk").alias("a"), F.max("dk").alias("b"))
    again = count.where("a < b" if shape.across else "c > 1").select("anchor", F.ceil(F.col("c") / bucket).cast("int").alias("parts"))
    found = marks.join(again, "anchor").groupBy("dk", "th").agg(F.collect_set(F.struct("anchor", "parts")).alias("found"))
    return cut(keyed.join(found, ["dk", "th"]))


def _mine(shape: Shape, data: bytes, found: list[dict]):
    """Runs of a document with a repeated anchor: (start, windows, anchor, parts, packed, lead, anchor's place in it)."""
    units = shape.units(data)
    start, windows, anchor, spot = shape.runs(units)
    parts = {f["anchor"]: f["parts"] for f in found}
    for i in np.flatnonzero(np.isin(anchor, np.fromiter(parts, np.int64, len(parts)))):
        s, n, a = int(start[i]), int(windows[i]), int(anchor[i])
        yield s, n, a, parts[a], shape.pack(units, s, s + n + shape.length - 1), shape.lead(units, int(spot[i])), int(spot[i]) - s


_MINED = pa.schema([("dk", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("lead", pa.int64()), ("anchor", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("windows", pa.int32()), ("spot", pa.int32()), ("packed", pa.binary()), ("low", pa.int64()), ("copies", pa.int64())])


def mined(found: DataFrame, shape: Shape) -> DataFrame:
    """Both from one pass: packed strings, equal ones of a task merged (dk is null), and where each lies (packed is null).

    Strings: lead, anchor, part, parts, windows, spot, packed, low, copies;
    places: dk, th, start and the string's fingerprint f1, f2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        size = 0

        def columns(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
            got = dict(zip(names, zip(*rows, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if f.name in got else pa.nulls(len(rows), f.type) for f in _MINED], schema=_MINED)

        def emit() -> pa.RecordBatch:
            rows = [(v[5], v[0], v[7] % v[1], v[1], v[2], v[6], p, v[3], v[4]) for p, v in held.items()]
            held.clear()
            return columns(["lead", "anchor", "part", "parts", "windows", "spot", "packed", "low", "copies"], rows)

        for batch in batches:
            spots = []
            for dk, th, data, marks in zip(*(batch.column(c).to_pylist() for c in ("dk", "th", "data", "found")), strict=True):
                for start, n, a, parts, string, lead, spot in _mine(shape, data, marks):
                    f = fingerprint(string)
                    spots.append((dk, th, start, *f))
                    if (v := held.get(string)) is None:
                        held[string] = [a, parts, n, dk, 1, lead, spot, f[1]]
                        size += len(string) + 200
                    else:
                        v[3], v[4] = min(v[3], dk), v[4] + 1
                if size > MERGE:
                    yield emit()
                    size = 0
                if len(spots) > 50_000:
                    yield columns(["dk", "th", "start", "f1", "f2"], spots)
                    spots = []
            if spots:
                yield columns(["dk", "th", "start", "f1", "f2"], spots)
        if held:
            yield emit()

    kinds = {"int64": "bigint", "int32": "int", "binary": "binary"}
    return in_batches(found, run, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in _MINED))


def fingerprint(string: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(string)
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


#: One packed string of a bucket: itself, number of windows, its anchor's place, smallest document, copies.
Entry = tuple[bytes, int, int, int, int]
#: Finds classes of equal windows among (string number, window bytes) of one distance to the anchor.
Classes = Callable[[list[tuple[bytes, int]]], Iterator[list[int]]]


def _equal(shape: Shape, group: list[Entry], classes: Classes) -> list[list[list[int]]]:
    """The class of equal windows in the bucket, for each string and window: [smallest document, copies, members].

    Equal windows lie at the same distance to their anchor, so one distance is
    looked at after the other: beside the strings, memory holds one window each.
    """
    out = [[[g[3], g[4], 1] for _ in range(g[1])] for g in group]
    edges = [shape.edges(g[0]) for g in group]
    for back in range(max(g[2] for g in group) + 1 if len(group) > 1 else 0):
        rows = []
        for i, (string, n, spot, _, _) in enumerate(group):
            if 0 <= (o := spot - back) < n:
                rows.append((string[edges[i][o] : edges[i][o + shape.length] - shape.words], i))
        if len(rows) > 1:
            for same in classes(rows):
                got = [min(group[i][3] for i in same), sum(group[i][4] for i in same), len(same)]
                for i in same:
                    out[i][group[i][2] - back] = got
    return out


def _runs(shape: Shape, low: int, copies: int, each: list[list[int]]) -> list[tuple[int, int, int]]:
    """(first, last, low) of the windows of one string that repeat, as far as its bucket knows."""
    first, was, out = 0, None, []
    for o in range(len(each) + 1):
        now = None
        if o < len(each):
            least, total, _ = each[o]
            if total > 1 and not (shape.across and copies == 1 and least == low):
                now = least if shape.across else 0
        if now != was:
            if was is not None:
                out.append((first, o - 1, was))
            first, was = o, now
    return out


_RUN = pa.list_(pa.struct([(f, pa.int64()) for f in ("first", "last", "low")]))
_OPEN = ["w1", "w2", "low", "copies", "a1", "a2", "at"]


class _Verdicts:
    """What buckets have decided, as rows: runs of a string, or open windows of a piece."""

    def __init__(self, shape: Shape, classes: Classes):
        self.shape, self.classes = shape, classes
        self.runs: list[tuple] = []
        self.open: list[tuple] = []

    def close(self, entries: dict[bytes, list[int]], whole: bool) -> None:
        """Judge a bucket; of a piece (not ``whole``) each distinct window stays open.

        A string asks again about a window that its piece does not settle: one
        seen once, or, across documents, one whose smallest document it holds.
        """
        shape = self.shape
        group = [(p, *v) for p, v in entries.items()]
        if not group or whole and len(group) == 1 and group[0][4] == 1:
            return
        each_of = _equal(shape, group, self.classes)
        told: set[int] = set()
        for (p, n, _, low, copies), each in zip(group, each_of, strict=True):
            f = fingerprint(p)
            if runs := _runs(shape, low, copies, each):
                self.runs.append((*f, [dict(zip(("first", "last", "low"), r, strict=True)) for r in runs]))
            if whole:
                continue
            edge = shape.edges(p)
            for o in range(n):
                least, total, members = each[o]
                asks = least == low if shape.across else total == 1
                new = members == 1 or id(each[o]) not in told
                if not asks and not new:
                    continue
                told.add(id(each[o]))
                self.open.append((*fingerprint(p[edge[o] : edge[o + shape.length] - shape.words]), least, total if new else 0, *(f if asks else (None, None)), o))

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        while len(self.runs) >= least and self.runs or len(self.open) >= least and self.open:
            runs, self.runs = self.runs[:20_000], self.runs[20_000:]
            windows, self.open = self.open[:20_000], self.open[20_000:]
            f1, f2, r = zip(*runs, strict=True) if runs else ((), (), ())
            more = len(windows)
            w = list(zip(*windows, strict=True)) if windows else [()] * len(_OPEN)
            none = [None] * more
            cols = [pa.array([*f1, *none], pa.int64()), pa.array([*f2, *none], pa.int64()), pa.array([*r, *none], _RUN)]
            cols += [pa.array([*([None] * len(runs)), *c], pa.int64()) for c in w]
            yield pa.RecordBatch.from_arrays(cols, names=["f1", "f2", "runs", *_OPEN])


VERDICT = "f1 bigint, f2 bigint, runs array<struct<first:bigint,last:bigint,low:bigint>>, " + ", ".join(f"{c} bigint" for c in _OPEN)


@dataclass(frozen=True)
class Deal:
    """How strings come to buckets: ``spread`` partitions and sorts them, ``key`` names what belongs together.

    ``whole`` tells whether all strings of a key are in one task; else its rows are a piece.
    """

    spread: Callable[[DataFrame], DataFrame]
    key: Callable[[dict], object]
    whole: Callable[[dict], bool]


def judged(strings: DataFrame, shape: Shape, classes: Classes, deal: Deal, bucket: int) -> DataFrame:
    """Read dealt strings bucket by bucket: runs of repeating windows by string, and open windows of pieces."""
    names = ["anchor", "part", "parts", "windows", "spot", "packed", "low", "copies"]
    key_of, all_here = deal.key, deal.whole  # the tasks take these, not the columns behind ``spread``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Verdicts(shape, classes)
        held, whole, entries = None, False, {}
        for batch in batches:
            for row in batch.select(names).to_pylist():
                if (now := key_of(row)) != held:
                    if held is not None:
                        out.close(entries, whole)
                        yield from out.batches(20_000)
                    held, whole, entries = now, all_here(row), {}
                elif not whole and len(entries) >= bucket and row["packed"] not in entries:
                    out.close(entries, False)
                    yield from out.batches(20_000)
                    entries = {}
                if (v := entries.get(row["packed"])) is None:
                    entries[row["packed"]] = [row["windows"], row["spot"], row["low"], row["copies"]]
                else:
                    v[2], v[3] = min(v[2], row["low"]), v[3] + row["copies"]
        if held is not None:
            out.close(entries, whole)
        yield from out.batches(1)

    return in_batches(deal.spread(strings.select("lead", *names)), run, VERDICT)


def repeated(verdicts: DataFrame, shape: Shape) -> DataFrame:
    """(f1, f2, runs): of each packed string the runs of windows that repeat, as (first, last, low)."""
    windows = verdicts.where("w1 is not null")
    known = windows.groupBy("w1", "w2").agg(F.min("low").alias("least"), F.sum("copies").alias("total"))
    asked = windows.where("a1 is not null").select("w1", "w2", F.col("low").alias("own"), F.col("a1").alias("f1"), F.col("a2").alias("f2"), "at")
    hit = asked.join(known, ["w1", "w2"]).where("least < own" if shape.across else "total > 1")
    more = hit.groupBy("f1", "f2").agg(F.collect_list(F.struct(F.col("at").alias("first"), F.col("at").alias("last"), F.col("least").alias("low"))).alias("runs"))
    return verdicts.where("f1 is not null").select("f1", "f2", "runs").unionByName(more)


def removals(docs: DataFrame, shape: Shape, classes: Classes, deal: Deal, key: str, text: str, bucket: int = BUCKET, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scanned, applied): every document's (dk, th, n, sha), and what :func:`apply` gives for those that may lose something.

    ``kept`` is left out unless asked for.  Both are written; what only served to make them is deleted.
    """
    keyed = _keyed(docs, key, text)
    scanned = cut(scan(keyed, shape))
    found = candidates(keyed, scanned, shape, bucket)
    rows = cut(mined(found, shape))
    verdicts = cut(judged(rows.where("packed is not null"), shape, classes, deal, bucket))
    hits = rows.where("dk is not null").select("dk", "th", "start", "f1", "f2").join(repeated(verdicts, shape), ["f1", "f2"])
    spans = hits.groupBy("dk", "th").agg(F.collect_set(F.struct("start", "runs")).alias("hits"))
    changed = found.select("dk", "th", "data").dropDuplicates(["dk", "th"]).join(spans, ["dk", "th"])
    applied = apply(changed, shape)
    applied = cut(applied if keep else applied.drop("spans", "kept"))
    for done in (found, rows, verdicts):
        drop_cut(done)
    return scanned, applied


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def apply(changed: DataFrame, shape: Shape) -> DataFrame:
    """(dk, th, n_removed, n_spans, kept_sha256, spans, kept).

    ``spans`` are the removed byte ranges of the text; ``kept`` is the text
    without them, white space as it was.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone, count, sha, spans, kept = [], [], [], [], []
        for dk, data, hits in zip(*(batch.column(c).to_pylist() for c in ("dk", "data", "hits")), strict=True):
            units = shape.units(data)
            step = np.zeros(len(units) + 1, np.int64)
            for h in hits:
                for r in h["runs"]:
                    if not shape.across or r["low"] < dk:
                        step[h["start"] + r["first"]] += 1
                        step[h["start"] + r["last"] + shape.length] -= 1
            mask = np.cumsum(step[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            first, last = edge[::2], edge[1::2]
            gone.append(int(mask.sum()))
            count.append(len(first))
            keep = [units[a:b] for a, b in zip([0, *last], [*first, len(units)], strict=True)]
            if shape.words:
                sha.append(hashlib.sha256(b" ".join(w for k in keep for w in k)).hexdigest())
                at = [m.span() for m in _WORD.finditer(data)]
                ranges = [(at[a][0], at[b - 1][1]) for a, b in zip(first, last, strict=True)]
            else:
                sha.append(hashlib.sha256(b"".join(keep)).hexdigest())
                ranges = [*zip(first.tolist(), last.tolist(), strict=True)]
            spans.append([{"start": a, "end": b} for a, b in ranges])
            kept.append(b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in ranges)], [*(r[0] for r in ranges), len(data)], strict=True)).decode("utf-8", "replace"))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("th"), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha), pa.array(spans, kind), pa.array(kept, pa.string())], names=["dk", "th", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return arrow_stage(changed, run, "dk bigint, th bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept string")


def report(scanned: DataFrame, applied: DataFrame) -> DataFrame:
    """(doc_id, n, n_removed, n_spans, kept_sha256) of every document."""
    out = scanned.drop("anchors", "times").join(applied.select("dk", "th", "n_removed", "n_spans", "kept_sha256"), ["dk", "th"], "left")
    return out.select(F.nullif("dk", F.lit(NULL_ID)).alias("doc_id"), "n", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def rewrite(docs: DataFrame, applied: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the kept text in the place of the text, all columns as they were."""
    marked = docs.withColumn("__dk", F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID))).withColumn("__th", F.xxhash64(F.col(key).cast("long"), text_bytes(text)))
    new = applied.select(F.col("dk").alias("__dk"), F.col("th").alias("__th"), F.col("kept").alias("__kept"))
    out = marked.join(new, ["__dk", "__th"], "left")
    return out.select(*[F.coalesce("__kept", c).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])

"""Packing of documents into training sequences: linear grouping, then best fit.

Tokens are counted in a narrow map, so a document becomes pieces of known
length.  As lengths are whole numbers up to the sequence's, the problem is a
histogram of at most ``LIMIT`` counts, whatever the number of documents; only
that histogram reaches the driver.  There

1. lengths above ``LIMIT / SMALL`` are put into groups of equal cardinality, and
   each group counts as its longest length;
2. configurations of those few lengths are optimised as a linear programme by
   column generation and rounded to whole numbers of sequences;
3. the groups' documents take the places in order of length, and what they leave
   of their rounded lengths lets a longer one into a sequence's last place;
4. what rounding left over, then the short pieces, go where they fit best.

The plan is a list of intervals of ranks within a length, so it is as small as
the histogram.  A piece's rank is its number within its task and length plus
those of the tasks before, and one look-up gives its sequence and offset.

Cases: a null or empty text is one piece of the end token; bytes that are not
UTF-8 are read as U+FFFD; strings of special tokens in a text are ordinary text;
null keys and repeated rows are packed like others; very long texts are cut into
full pieces after a shorter first one; an empty table gives an empty result;
other columns are not looked at, whatever their names; equal lengths take their
places in the order in which tasks read them, so sequence numbers may differ
between runs, but neither their count nor the pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, in_batches, text_bytes

LIMIT, END = 2048, 0
#: Lengths up to LIMIT / SMALL are short; groups of longer ones.
SMALL, GROUPS = 4, 128
#: The programme is within this share of its optimum when it ends.
GAP = 1e-3
#: Chunks whose tokens a worker remembers, none longer than MEMO_CHARS; texts tokenised together.
MEMO_CHUNKS, MEMO_CHARS, TEXTS_CHARS = 700_000, 48, 1 << 20

# ------------------------------------------------------------------ tokens

#: A single blank between other characters: tokens never reach across its left side.
_BLANK = re.compile(r"(?<=\S) (?=\S)")


_OTHER_WHITE = frozenset(c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n")


def chunked(text: str) -> list[str]:
    """The text cut at its single blanks."""
    plain = "  " not in text and "\n " not in text and " \n" not in text and text[:1] != " " and text[-1:] != " " and _OTHER_WHITE.isdisjoint(text)
    return text.split(" ") if plain else _BLANK.split(text)


class Chunks:
    """Token ids as bytes, remembered for chunks that begin with a single blank."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.line = self.tokenizer.token_to_id("Ċ")
        self.marks = dict(zip(".,", self._ids([".", ","]), strict=True))
        self.memo: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of chunks, each after its blank.

        A line break before a blank is a token of its own, so chunks without one
        are encoded as the lines of one text.
        """
        lines = [x for x in new if "\n" not in x]
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([" " + x for x in lines])], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.line) if len(lines) > 1 else np.zeros(0, np.int64)
        data, at = ids.tobytes(), 0
        for x, end in zip(lines, [*(4 * ends).tolist(), len(data)], strict=True):
            self.memo[x] = data[at:end]
            at = end + 4
        rest = [x for x in new if "\n" in x]
        self.memo.update(zip(rest, self._ids([" " + x for x in rest]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        memo = self.memo
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        chunks = [chunked(t) for t in texts]
        heads = self._ids([c[0] for c in chunks])
        new = set().union(*(c[1:] for c in chunks)).difference(memo)
        # A mark after a letter or digit is a token of its own: the word is learned without it.
        marked = [x for x in new if x[-1] in self.marks and x[-2:-1].isalnum()]
        words = list({x[:-1] for x in marked}.union(new.difference(marked)).difference(memo))
        if words:
            self._learn(words)
        memo.update([(x, memo[x[:-1]] + self.marks[x[-1]]) for x in marked])
        out = [head + b"".join(map(memo.__getitem__, c[1:])) for head, c in zip(heads, chunks, strict=True)]
        for x in new.union(words):
            if len(x) > MEMO_CHARS:
                del memo[x]
        return out


@lru_cache(maxsize=1)
def chunks(path: str) -> Chunks:
    """One tokenizer for each Python worker."""
    return Chunks(path)


def token_pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): the pieces, and each one's number among those of its task and length."""
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(f"`{key}`").alias("doc_id"), text_bytes(f"`{text}`").alias("data"))
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, coder = TaskContext.get().partitionId(), [0] * (limit + 1), chunks(path)
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in batch.column("data").to_pylist()]
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= TEXTS_CHARS):
                    held, to = held + len(texts[to]), to + 1
                for i, ids in enumerate(coder.encode(texts[at:to]), at):
                    ids += last
                    n = len(ids) // 4
                    first = n if n <= limit else n % limit or limit
                    for k, (a, b) in enumerate(zip([0, *range(first, n, limit)], range(first, n + 1, limit), strict=True)):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(memoryview(ids)[4 * a : 4 * b]))
                        nth.append(seen[b - a])
                        seen[b - a] += 1
                at = to
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, [part] * len(row), nth))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return in_batches(src, run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint")


# -------------------------------------------------------------------- plan


class Interval(NamedTuple):
    """``count`` pieces of one length, by rank, lie at one offset of as many sequences in a row."""

    size: int
    rank: int
    count: int
    sequence: int
    offset: int


class Run(NamedTuple):
    """``count`` sequences alike: places (length, first rank), each an interval of ``count`` ranks."""

    count: int
    places: tuple[tuple[int, int], ...]

    def part(self, at: int, count: int) -> Run:
        return Run(count, tuple((s, r + at) for s, r in self.places))


def grouped(hist: dict[int, int], groups: int) -> list[tuple[int, int, int]]:
    """(rounded length, first position, pieces) of groups of equal cardinality, longest first; equal lengths are one group."""
    n, out, ends = sum(hist.values()), [], []
    at = 0
    for size in sorted(hist, reverse=True):
        at += hist[size]
        ends.append((at, size))
    cuts = sorted({n * g // groups for g in range(groups)})
    k = 0
    for a, b in zip(cuts, [*cuts[1:], n], strict=True):
        while ends[k][0] <= a:
            k += 1
        if b > a and out and out[-1][0] == ends[k][1]:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + b - a)
        elif b > a:
            out.append((ends[k][1], a, b - a))
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths that fits (a knapsack by number of pieces)."""
    most = limit // int(sizes.min())
    best, picks = np.zeros(limit + 1), []
    for _ in range(most):
        now, pick = best.copy(), np.full(limit + 1, -1)
        for g in np.flatnonzero(values > 1e-12):
            s = sizes[g]
            got = best[: limit + 1 - s] + values[g]
            better = got > now[s:] + 1e-12
            now[s:][better] = got[better]
            pick[s:][better] = g
        best = now
        picks.append(pick)
    at, column = limit, np.zeros(len(sizes))
    for pick in reversed(picks):
        if pick[at] >= 0:
            column[pick[at]] += 1
            at -= sizes[pick[at]]
    return float(column @ values), column


def configurations(sizes: np.ndarray, demand: np.ndarray, limit: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (pieces of each group) and their whole numbers of sequences; some demand may stay unmet."""
    k = len(sizes)
    basis = np.diag((limit // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(60 * k):
        values = np.linalg.solve(basis.T, np.ones(k))
        value, column = best_configuration(sizes, values, limit)
        if value <= 1 + GAP:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    whole = np.floor(x + 1e-6).astype(np.int64)
    counts = basis.astype(np.int64)
    left = demand.astype(np.int64) - counts @ whole
    while (left < 0).any():  # of numbers rounded up by the tolerance
        g = int(np.argmin(left))
        c = int(np.argmax((counts[g] > 0) * whole))
        whole[c] -= 1
        left += counts[:, c]
    for c in np.argsort(whole - x):
        if (counts[:, c] <= left).all():
            whole[c] += 1
            left -= counts[:, c]
    return [(counts[:, c], int(whole[c])) for c in range(k) if whole[c]]


def substituted(groups: list[tuple[int, int, int]], configs: list[tuple[np.ndarray, int]], hist: dict[int, int], limit: int) -> tuple[list[Run], dict[int, list[tuple[int, int]]]]:
    """Runs of sequences with the groups' own pieces in their places; intervals (rank, count) left over by length.

    All places of a configuration but its shortest take the groups' pieces in
    order.  What they leave of their rounded lengths goes to the last place: the
    sequences with the least room choose first, and take the longest piece that
    fits.  The piece meant for a place always could take it, so none goes without.
    """
    sizes = sorted(hist, reverse=True)
    starts = np.cumsum([0, *(hist[s] for s in sizes)])
    used = [start for _, start, _ in groups]
    runs = []
    for column, count in configs:
        places = []
        for g in np.flatnonzero(column):
            for _ in range(int(column[g])):
                places.append(g)
        places = [used[g] + count * places[:i].count(g) for i, g in enumerate(places[:-1])]
        for g in np.flatnonzero(column):
            used[g] += count * (int(column[g]) - (g == np.flatnonzero(column)[-1]))
        # Positions at which some place comes to a shorter length part the run.
        cuts = {0, count}
        for p in places:
            a, b = np.searchsorted(starts, p, "right"), np.searchsorted(starts, p + count, "left")
            cuts.update((starts[a:b] - p).tolist())
        edges = sorted(cuts)
        for a, b in zip(edges, edges[1:]):
            k = [int(np.searchsorted(starts, p + a, "right")) - 1 for p in places]
            runs.append(Run(b - a, tuple((sizes[i], int(p + a - starts[i])) for i, p in zip(k, places, strict=True))))
    left: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (_, start, n), at in zip(groups, used, strict=True):
        while at < start + n:
            i = int(np.searchsorted(starts, at, "right")) - 1
            upto = min(start + n, int(starts[i + 1]))
            left[sizes[i]].append((int(at - starts[i]), upto - at))
            at = upto
    free = sorted(left)
    out = []
    for room, run in sorted(((limit - sum(s for s, _ in r.places), r) for r in runs), key=lambda x: x[0]):
        while run.count:
            i = bisect_right(free, room) - 1
            if i < 0:
                out.append(run)
                break
            size = free[i]
            rank, n = left[size].pop()
            taken = min(n, run.count)
            if taken < n:
                left[size].append((rank + taken, n - taken))
            elif not left[size]:
                del left[size], free[i]
            out.append(Run(taken, (*run.part(0, taken).places, (size, rank))))
            run = run.part(taken, run.count - taken)
    return out, left


def best_fit(runs: list[Run], left: dict[int, list[tuple[int, int]]], limit: int) -> list[Run]:
    """Pieces, longest first, into the sequences with the least room that takes them; new ones where none does."""
    room: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        room[limit - sum(s for s, _ in run.places)].append(run)
    fits = sorted(r for r in room)
    for size in sorted(left, reverse=True):
        for rank, count in left[size]:
            while count:
                at = next((r for r in fits if r >= size and room[r]), limit)
                run = room[at].pop() if room.get(at) else Run(max(1, count // (limit // size)), ())
                each = min(at // size, count)
                taken = min(run.count, count // each)
                if taken < run.count and run.places:
                    room[at].append(run.part(taken, run.count - taken))
                filled = Run(taken, run.places[:] + tuple((size, rank + t * taken) for t in range(each)))
                rest = at - each * size
                room[rest].append(filled)
                if rest not in fits:
                    fits = sorted([*fits, rest])
                rank, count = rank + each * taken, count - each * taken
    return [run for each in room.values() for run in each]


def plan(hist: dict[int, int], limit: int = LIMIT, small: int = SMALL, groups: int = GROUPS) -> list[Interval]:
    """Where the pieces of each length go; hist: pieces by length."""
    runs = [Run(hist[limit], ((limit, 0),))] if hist.get(limit) else []
    long = {s: n for s, n in hist.items() if limit // small < s < limit and n}
    left: dict[int, list[tuple[int, int]]] = {}
    if long:
        parts = grouped(long, groups)
        sizes, demand = np.array([s for s, _, _ in parts]), np.array([n for _, _, n in parts])
        more, left = substituted(parts, configurations(sizes, demand, limit), long, limit)
        runs += more
    left = dict(left) | {s: [(0, n)] for s, n in hist.items() if s <= limit // small and n}
    out, sequence = [], 0
    for run in best_fit(runs, left, limit):
        offset = 0
        for size, rank in run.places:
            out.append(Interval(size, rank, run.count, sequence, offset))
            offset += size
        sequence += run.count
    return out


# ------------------------------------------------------------------- place


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, small: int = SMALL, groups: int = GROUPS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = cut(token_pieces(docs, path, limit, end, key, text))
    counted = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    hist = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    intervals = np.array(sorted(plan(hist, limit, small, groups)), np.int64).reshape(-1, 5)
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    #: One number that grows with (length, rank): ranks are below 2**50.
    lows = intervals[:, 0] << 50 | intervals[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(lows, batch.column("length").to_numpy(zero_copy_only=False) << 50 | rank, "right") - 1
            got = intervals[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(got[:, 3] + rank - got[:, 1]), pa.array(got[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = in_batches(ranked, run, f"doc_id {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out

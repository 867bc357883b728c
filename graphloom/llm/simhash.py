"""SimHash near-duplicate grouping by anchor-point covering.

Fingerprints are 64-bit SimHashes of word shingles.  Two fingerprints that
differ in at most three bits differ in at most one bit on one of their two
32-bit halves.  On a half, the anchors are the words of a covering code: the
perfect Hamming code of length 31 with the remaining bit left free, of covering
radius one.  A fingerprint has its home at the one anchor within the covering
radius of its half, and is replicated to every anchor within covering radius
plus threshold, here two: any fingerprint within one bit of the half then has
its home at an anchor to which the first is replicated.  Fingerprints are
compared per anchor, and each anchor hands on a spanning forest of the links
it finds, never all pairs, so the output is linear in what it has read.

Only distinct fingerprints travel; documents with the same fingerprint are
joined through it.  An anchor of more than ``LIMIT`` rows is not compared where
it is met: its rows are dealt again by each byte of the other half, on which two
fingerprints within the threshold agree in one of four at least.  What is still
beyond ``LIMIT`` is cut in blocks of homes, each of which sees all rows of its
anchor and byte stream past.  So a task holds ``LIMIT`` rows, whatever the
anchor; only the work of the last step is quadratic, and it is spread.

Cases: null or empty text, and text without words, has fingerprint zero and is
linked like any other; fewer words than a shingle: the whole sequence is one
shingle; repeated rows share a fingerprint; a null id counts as greater than any
other and is kept: its component is the smallest id reached, null if there is
none; ids are below 2 ** 62; very long texts are hashed in blocks; an empty table gives an empty result;
extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_stage, cut, in_batches, text_bytes
from graphloom.llm.components import components

SEED = 42
#: Shingles hashed before their bits are added up: bounds memory on long texts.
BLOCK = 1 << 16
#: Rows of one anchor that are compared in one piece.
LIMIT = 1 << 12


def fingerprint(data: bytes, words_in_shingle: int = 3) -> int:
    """SimHash of the UTF-8 bytes of a text: A-Z lower-cased, words split at ASCII white space, shingles with repeats."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    k, digest = words_in_shingle, xxhash.xxh64_intdigest
    if len(words) < k:
        return digest(b" ".join(words), SEED)
    n = len(words) - k + 1
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + k - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False))
        h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        # Bit b of byte B counts in column 8 B + b.
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): a narrow map over the scan."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [fingerprint(t, words_in_shingle) for t in batch.column("data").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(got, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return arrow_stage(docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("data")), run, "doc_id bigint, fp bigint")


def _parity_columns() -> np.ndarray:
    """Column i of the Hamming parity check is the number i + 1; bit 31 is free."""
    return np.arange(1, 32, dtype=np.uint32)


def syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(half.shape, np.uint32)
    for i, col in enumerate(_parity_columns()):
        out ^= np.where((half >> np.uint32(i)) & np.uint32(1), col, np.uint32(0))
    return out


def home(half: np.ndarray) -> np.ndarray:
    """The only anchor within the covering radius, one, that keeps the free bit."""
    s = syndrome(half)
    return half ^ np.where(s, np.uint32(1) << (np.maximum(s, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)


def replicas(half: np.ndarray) -> np.ndarray:
    """n x 33 anchors: the homes of the half and of the 32 words one bit away; repeats are removed by the caller.

    Whatever is within the threshold (one bit) of the half has its home among
    them, and all are within covering radius plus threshold of it.
    """
    flips = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(32, dtype=np.uint32)])
    return home(half[:, None] ^ flips[None, :])


def place(fps: DataFrame) -> DataFrame:
    """(half, anchor, is_home, fp) for distinct fingerprints: one home row a half, some 17 replicas."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        fp = batch.column("fp").to_numpy()
        if not len(fp):
            return None
        words = fp.view(np.uint64)
        out: list[tuple] = []
        for which in (0, 1):
            half = ((words >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            every = np.sort(replicas(half), axis=1)
            keep = np.ones(every.shape, bool)
            keep[:, 1:] = every[:, 1:] != every[:, :-1]
            row, col = np.nonzero(keep)
            anchors = every[row, col]
            own = home(half)[row] == anchors
            out.append((np.full(len(row), which, np.int64), anchors.astype(np.int64), own, fp[row]))
        half_no, anchors, own, copies = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(half_no << 32 | anchors), pa.array(own), pa.array(copies)], names=["anchor", "is_home", "fp"])

    return arrow_stage(fps, run, "anchor bigint, is_home boolean, fp bigint")


def _forest(homes: np.ndarray, others: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning links between homes and all fingerprints at the anchor, at ``most`` bits apart.

    Labels tell what is joined already, so a home looks at labels it doesn't
    share, not at every partner.
    """
    others = np.unique(others)
    label = np.arange(len(others))
    links: list[tuple[int, int]] = []
    for x in np.unique(homes):
        me = int(np.searchsorted(others, x))
        near = np.flatnonzero(np.bitwise_count(others ^ x) <= most)
        near = near[label[near] != label[me]]
        if not len(near):
            continue
        apart, first = np.unique(label[near], return_index=True)
        links += [(int(x), int(others[near[i]])) for i in first]
        label[np.isin(label, apart)] = label[me]
    return links


_CELL = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("anchor", pa.int64()), ("cell", pa.int32()), ("is_home", pa.bool_()), ("fp", pa.int64())])
_CELL_DDL = "a bigint, b bigint, anchor bigint, cell int, is_home boolean, fp bigint"


def _as_links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(u[:, 0].copy()), pa.array(u[:, 1].copy()), *(pa.nulls(len(u), f.type) for f in list(_CELL)[2:])], schema=_CELL)


def _as_rows(anchor: np.ndarray, cell: np.ndarray, own: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(fp), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(anchor), pa.array(cell), pa.array(own), pa.array(fp.view(np.int64))], schema=_CELL)


def compared(placed: DataFrame, most: int, limit: int) -> DataFrame:
    """Links (a, b) of each (anchor, cell) up to ``limit`` rows; the rows of larger ones come back as they are (a is null)."""
    ordered = placed.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of the key that may go on in the next batch; ``over`` is a key that has grown beyond the limit.
        kept = (np.array([], np.int64), np.array([], np.int32), np.array([], bool), np.array([], np.uint64))
        over, found = None, []

        def close(own: np.ndarray, fp: np.ndarray) -> None:
            if own.any():
                found.extend(_forest(fp[own], fp, most))

        for batch in batches:
            new = (batch.column("anchor").to_numpy(), batch.column("cell").to_numpy(), batch.column("is_home").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy().view(np.uint64))
            if not batch.num_rows:
                continue
            k, c, own, fp = (np.concatenate(x) for x in zip(kept, new, strict=True))
            change = np.flatnonzero((k[1:] != k[:-1]) | (c[1:] != c[:-1])) + 1
            first, end = np.concatenate([[0], change]), np.concatenate([change, [len(k)]])
            several = end - first > 1
            several[0] |= over is not None  # the first key may go on from the last batch
            for g in np.flatnonzero(several):
                lo, hi = int(first[g]), int(end[g])
                here = (int(k[lo]), int(c[lo]))
                if here == over or hi - lo > limit:
                    over = here
                    yield _as_rows(k[lo:hi], c[lo:hi], own[lo:hi], fp[lo:hi])
                elif g < len(first) - 1:
                    over = None
                    if hi - lo > 1:
                        close(own[lo:hi], fp[lo:hi])
            at = int(first[-1])
            if over is not None and over != (int(k[at]), int(c[at])):
                over = None
            kept = tuple(x[len(k) if over else at :] for x in (k, c, own, fp))
            if found:
                yield _as_links(found)
                found.clear()
        if len(kept[0]) > 1:
            close(kept[2], kept[3])
        if found:
            yield _as_links(found)

    return in_batches(ordered, run, _CELL_DDL)


def _by_bytes(rows: DataFrame) -> DataFrame:
    """Each row of an anchor at the four bytes of the half that the anchor leaves free."""
    other = F.when(F.shiftright("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    cells = F.array(*[F.shiftrightunsigned(other, 8 * i).bitwiseAND(255).cast("int") + 256 * i for i in range(4)])
    return rows.select("anchor", F.explode(cells).alias("cell"), "is_home", "fp")


def in_blocks(rows: DataFrame, most: int, limit: int) -> DataFrame:
    """(a, b) of (anchor, cell) groups of any size: blocks of homes, which all rows of the group pass."""
    sizes = rows.groupBy("anchor", "cell").agg(F.ceil(F.count_if("is_home") / limit).cast("int").alias("blocks")).where("blocks > 0")
    dealt = rows.join(sizes, ["anchor", "cell"])
    homes = dealt.where("is_home").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("side", F.lit(0))
    others = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    met = homes.unionByName(others).select("anchor", "cell", "block", "side", "fp").repartition("anchor", "cell", "block").sortWithinPartitions("anchor", "cell", "block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, homes = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tag = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "cell", "block", "side")])
            fp, found = batch.column("fp").to_numpy().view(np.uint64), []
            edges = np.flatnonzero((np.diff(tag, axis=1) != 0).any(axis=0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if (now := tuple(tag[:3, lo])) != held:
                    held, homes = now, []
                if tag[3, lo] == 0:
                    homes.append(fp[lo:hi])
                    continue
                own = np.unique(np.concatenate(homes)) if homes else fp[:0]
                for at in range(lo, hi, limit):
                    part = fp[at : min(hi, at + limit)]
                    if len(own):
                        found += _forest(own, np.concatenate([own, part]), most)
            if found:
                yield _as_links(found)

    return in_batches(met, run, _CELL_DDL)


def link(placed: DataFrame, most: int = 3, limit: int = LIMIT) -> DataFrame:
    """(a, b): at each anchor spanning links of the fingerprints within ``most`` bits of one another."""
    done = [cut(compared(placed.withColumn("cell", F.lit(0)), most, limit))]
    rest = done[0].where("a is null").select("anchor", "is_home", "fp")
    if not rest.isEmpty():
        done.append(cut(compared(_by_bytes(rest), most, limit)))
        rest = done[1].where("a is null").select("anchor", "cell", "is_home", "fp")
        if not rest.isEmpty():
            done.append(in_blocks(rest, most, limit))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.where("a is not null").select("a", "b").distinct()


def groups(docs: DataFrame, words_in_shingle: int = 3, most: int = 3, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable through links."""
    if most != 3:
        raise ValueError("the covering is laid out for three differing bits")
    marked = cut(fingerprints(docs, words_in_shingle, key, text))
    # Components are of fingerprints, so documents' ids may be any: nulls count for nothing, and all of a component's may be null.
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    pairs = link(place(nodes.select("fp")), most, limit)
    comp = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = cut(nodes.join(comp, nodes.fp == comp.id, "left").select("fp", F.coalesce("component", "fp").alias("root"), "least"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")

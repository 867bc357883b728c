"""Near-duplicate removal for the pipeline: SimHash candidates, exact five-word similarity.

SimHash at three bits sees near copies of a similarity of 0.8 only now and
then, so this stage takes several fingerprints (one for each of ``SEEDS``) of
the *distinct words* of a text, which small edits hardly move, finds candidates
by the anchor covering of :mod:`graphloom.llm.simhash` for each half of each,
sifts them by a second fingerprint of distinct word pairs, and then verifies the
similarity (Jaccard) of five-word shingle sets exactly.  Whatever lies within
one bit on any half is compared, and much that lies within two to four.

Beside the fingerprints stands a path that misses no pair: two sets of
similarity t share one of the first n - ceil(t n) + 1 shingles of each, in any
order that is the same for all.  The order here is by occurrences in a sample,
rare first, so only the sizes of groups depend on the sample.  Texts that share
a leading shingle are linked if their sizes and the parities of their hashed
shingles allow the similarity: each differing parity is a differing shingle at
least.  A shingle that the sample shows in very many texts is dealt over blocks,
and every two blocks meet.
Documents with the same text are put together first; of every group the
smallest id stays.

An anchor of very many fingerprints is looked at in blocks of ``BLOCK_DOCUMENTS``;
what lies in different blocks is left to the path that misses none.
Each anchor, and each leading shingle, hands on a spanning forest of the pairs that pass; the
anchors' forests differ, so each fingerprint then keeps its smallest partner and links the others to that.  What
these links join is a cluster, and the documents of a cluster are compared
exactly with one another, block by block; a block pair is a task of bounded
memory that returns a spanning forest of the similar ones.  So output stays
linear in the rows read, and no partner is left out.

Cases: null text is the empty text, and all empty texts are copies of one
another; texts below five words are one shingle; a row given twice under one
id stays or goes as one; a row with a null id stays unless its text has an id
elsewhere; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_stage, cut, in_batches, mix64, text_bytes
from graphloom.llm.components import components
from graphloom.llm.simhash import replicas

SEEDS = (42, 1, 2, 3, 4, 5)
#: Bits of the word-pair fingerprint that similar documents may differ in.
SIFT = 14
SHINGLE, THRESHOLD = 5, 0.8
#: Shingles, and documents, in one block of a cluster at most about.
BLOCK, BLOCK_DOCUMENTS = 400_000, 4_096
#: Texts in the sample that orders shingles, shingles known from it at most, and bits (as powers of two) of a text's parities.
SAMPLE, KNOWN, PARITIES = 8_192, 50_000, (10, 15)
#: Texts of one leading shingle in one block at most about.
BLOCK_TEXTS = 16_384
#: A leading shingle of so many texts gives all their pairs at once.
FEW = 16


def _bits(hashes: np.ndarray) -> list[int]:
    """A fingerprint for each row of hashes: the bits that over half of them have."""
    rows, n = hashes.shape
    count = np.zeros((rows, 64), np.int64)
    for at in range(0, n, 1 << 14):
        part = np.ascontiguousarray(hashes[:, at : at + (1 << 14)])
        ones = np.unpackbits(part.view(np.uint8), bitorder="little").view(np.uint64).reshape(rows, -1, 8)
        # Eight counters of a byte each are added as one word; 255 hashes cannot overflow a byte.
        sums = np.add.reduceat(ones, np.arange(0, part.shape[1], 255), axis=1)
        count += sums.view(np.uint8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * count > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def _hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct lower-cased words, and of all words in their order; each word is hashed once."""
    import xxhash

    words = data.lower().split()
    known = dict.fromkeys(words)
    for w in known:
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(known.values(), np.uint64, len(known)), np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``length`` words; fewer words are one run."""
    n = max(1, len(h) - length + 1)
    out = h[:n]
    for i in range(1, len(h) - n + 1):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    out = np.sort(out)
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _shingles(h: np.ndarray) -> np.ndarray:
    return _runs(h, SHINGLE) if len(h) else np.zeros(1, np.uint64)


def sketch(data: bytes) -> tuple[list[int], int, np.ndarray]:
    """Fingerprints of the distinct words, one a seed, and one of the distinct word pairs; the hashed shingles."""
    one, h = _hashed_words(data)
    seeds = np.array([s * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for s in SEEDS], np.uint64)
    return _bits(mix64(one + seeds[:, None])), _bits(_runs(h, 2)[None])[0] if len(h) > 1 else 0, _shingles(h)


def hashed_shingles(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; texts without words have one that they share."""
    return _shingles(_hashed_words(data)[1])


def parities(shingles: np.ndarray) -> bytes:
    """How often, odd or even, each value of the low bits occurs; the longer the text, the more bits."""
    width = 1 << int(np.clip(np.ceil(np.log2(len(shingles))), *PARITIES))
    return np.packbits((np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def _differing(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """Differing parities of pairs; the longer of a pair is folded to the shorter."""
    out = np.zeros(len(one), np.int64)
    widths = np.array([[len(x), len(y)] for x, y in zip(one, two, strict=True)]).reshape(-1, 2)
    for pair in np.unique(widths, axis=0):
        at, w = np.flatnonzero((widths == pair).all(axis=1)), int(pair.min()) // 8
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(side[i] for i in at), np.uint64).reshape(len(at), -1, w), axis=1) for side in (one, two))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _allowed(size: np.ndarray, bits: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows sizes and parities do not rule out as similar."""
    a, b = size[x], size[y]
    fit = np.flatnonzero(np.minimum(a, b) >= THRESHOLD * np.maximum(a, b) - 1e-9)
    odd = _differing([bits[i] for i in x[fit]], [bits[i] for i in y[fit]])
    return fit[odd <= (a + b)[fit] * (1 - THRESHOLD) / (1 + THRESHOLD) + 1e-6]


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [sketch(t) for t in batch.column("data").to_pylist()]
        ones = pa.array([np.array(g[0], np.uint64).view(np.int64) for g in got], pa.list_(pa.int64()))
        size, bits = pa.array([len(g[2]) for g in got], pa.int32()), pa.array([parities(g[2]) for g in got], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t1"), batch.column("t2"), ones, pa.array(np.array([g[1] for g in got], np.uint64).view(np.int64)), size, bits], names=["id", "t1", "t2", "ones", "two", "size", "bits"])

    data = text_bytes(text)
    src = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(data).alias("t1"), F.xxhash64(F.lit(7), data).alias("t2"), data.alias("data"))
    return arrow_stage(src, run, "id bigint, t1 bigint, t2 bigint, ones array<bigint>, two bigint, size int, bits binary")


def _near(two: np.ndarray) -> list[tuple[int, int]]:
    """Links (first, other) of the sorted word-pair fingerprints at one anchor: a star for each set that the sift joins."""
    found: list[tuple[int, int]] = []
    rest = np.ones(len(two), bool)
    while rest.any():
        first = int(rest.argmax())
        rest[first] = False
        todo = [first]
        while todo:
            x = todo.pop()
            free = np.flatnonzero(rest)
            near = free[np.bitwise_count((two[free] ^ two[x]).view(np.uint64)) <= SIFT]
            rest[near] = False
            todo += near.tolist()
            found += [(int(two[first]), int(y)) for y in two[near]]
    return found


def thin(links: DataFrame) -> DataFrame:
    """(a, b), a < b: links that join what ``links`` (parent, child) join, and far fewer of them in large groups.

    A child has a parent at each of its anchors, a few hundred at most, and in a large group nearly all of
    them differ.  It keeps the smallest; the others are linked to that one, a link that other children give too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low = None, 0  # the child that may go on in the next batch, its smallest parent
        for batch in batches:
            if not batch.num_rows:
                continue
            parent, child = (batch.column(c).to_numpy() for c in ("parent", "child"))
            start = np.concatenate([[child[0] != held], child[1:] != child[:-1]])
            lows = np.concatenate([[low], parent[start]])[np.cumsum(start)]
            u = np.stack([np.where(start, child, parent), lows], axis=1)
            held, low = child[-1], lows[-1]
            yield from _links(u[u[:, 0] != u[:, 1]].tolist())

    return in_batches(links.repartition("child").sortWithinPartitions("child", "parent"), run, "a bigint, b bigint").distinct()


def candidates(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: links between word-pair fingerprints; what they join is to be compared. distinct: (ones, two)."""

    def place(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        ones = batch.column("ones").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        two, anchors, copies = batch.column("two").to_numpy(), [], []
        for s in range(len(SEEDS)):
            for which in (0, 1):
                half = ((ones[:, s] >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                near = np.sort(replicas(half), axis=1)
                keep = np.ones(near.shape, bool)
                keep[:, 1:] = near[:, 1:] != near[:, :-1]
                row, col = np.nonzero(keep)
                anchors.append(near[row, col].astype(np.int64) | (2 * s + which) << 32)
                copies.append(two[row])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.array(np.concatenate(copies))], names=["anchor", "two"])

    placed = arrow_stage(distinct.select("ones", "two"), place, "anchor bigint, two bigint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        keys, values = np.array([], np.int64), np.array([], np.int64)  # the anchor that may go on in the next batch

        def close(k: np.ndarray, v: np.ndarray) -> None:
            # Most anchors hold one fingerprint: only the others are looked at.
            edges = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
            for i in np.flatnonzero(np.diff(edges) > 1):
                own = np.unique(v[edges[i] : edges[i + 1]])
                for at in range(0, len(own) if len(own) > 1 else 0, BLOCK_DOCUMENTS):
                    found.extend(_near(own[at : at + BLOCK_DOCUMENTS]))

        for batch in batches:
            k = np.concatenate([keys, batch.column("anchor").to_numpy()])
            v = np.concatenate([values, batch.column("two").to_numpy()])
            if not len(k):
                continue
            last = np.searchsorted(k, k[-1])
            if last:
                close(k[:last], v[:last])
            keys, values = k[last:], v[last:]
            yield from _parents(found)
        if len(keys):
            close(keys, values)
        yield from _parents(found)

    return thin(in_batches(placed.repartition("anchor").sortWithinPartitions("anchor"), compare, "parent bigint, child bigint"))


def common_shingles(data: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles met most in a sample, and in about how many of all texts. data: (data)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [hashed_shingles(t) for t in batch.column("data").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["key"])

    share = min(1.0, SAMPLE / max(1, texts))
    some = data.where(F.pmod(F.xxhash64(F.lit(11), "data"), F.lit(1 << 20)) < int(share * (1 << 20))).distinct()
    most = arrow_stage(some, run, "key bigint").groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(KNOWN).collect()
    keys, counts = np.array([r["key"] for r in most], np.int64).view(np.uint64), np.array([r["count"] for r in most], np.int64)
    order = np.argsort(keys)
    return keys[order], np.ceil(counts[order] / share).astype(np.int64)


def leading(shingles: np.ndarray, keys: np.ndarray, counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of which similar texts share one, rare ones first, and the blocks of each."""
    n = len(shingles)
    times = np.zeros(n, np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        times = np.where(keys[at] == shingles, counts[at], 0)
    first = np.argsort(times, kind="stable")[: n - int(np.ceil(THRESHOLD * n - 1e-9)) + 1]
    return shingles[first], np.maximum(1, -(-times[first] // block)).astype(np.int32)


def exact_candidates(docs: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(a, b), a < b: links between texts (t1) that join all similar ones. texts: (t1, size, bits)."""
    data = docs.select(text_bytes(text).alias("data"))
    keys, counts = common_shingles(data, texts.count())
    block, few = BLOCK_TEXTS, FEW

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[int, bytes] = dict(zip(batch.column("t").to_pylist(), batch.column("data").to_pylist(), strict=True))
        got = [leading(hashed_shingles(d), keys, counts, block) for d in seen.values()]
        t = np.repeat(np.fromiter(seen, np.int64, len(seen)), [len(g[0]) for g in got])
        key, blocks = np.concatenate([g[0] for g in got]).view(np.int64), np.concatenate([g[1] for g in got])
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array((t.view(np.uint64) % blocks.astype(np.uint64)).astype(np.int32)), pa.array(blocks), pa.array(t)], names=["key", "own", "blocks", "t"])

    placed = arrow_stage(data.select(F.xxhash64("data").alias("t"), "data"), place, "key bigint, own int, blocks int, t bigint")

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (t, s) of the texts of a shingle that few have, else its rows; what is alone with its shingle has no partner."""
        held: list[pa.RecordBatch] = []  # ends in the shingle that may go on in the next batch

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, t = table.column("key").to_numpy(), table.column("t").to_numpy()
            many = table.column("blocks").to_numpy() > 1
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (t[1:] != t[:-1])  # a copy of a text counts once
            run = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
            keep = new & (many | (np.bincount(run, weights=new)[run] > 1))
            at = np.flatnonzero(keep)
            key, run, t = key[at], run[at], t[at]
            small = (np.bincount(run)[run] <= few) & ~many[at] if len(at) else keep[:0]
            near = [np.flatnonzero(small[:-o] & (run[o:] == run[:-o])) for o in range(1, min(few, len(at)))]
            if near and sum(map(len, near)):
                u = np.unique(np.concatenate([np.stack([t[i], t[i + o]], axis=1) for o, i in enumerate(near, 1)]), axis=0)
                no = pa.nulls(len(u), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), no, no, pa.array(u[:, 0].copy()), pa.array(u[:, 1].copy())], names=["key", "own", "blocks", "t", "s"])
            if not small.all():
                rest = table.take(pa.array(at[~small]))
                yield from rest.append_column("s", pa.nulls(rest.num_rows, pa.int64())).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last or (held and held[-1].column("key")[-1].as_py() != key[0]):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from done(pa.Table.from_batches(held))

    shared = cut(in_batches(placed.repartition("key", "own").sortWithinPartitions("key", "t"), several, "key bigint, own int, blocks int, t bigint, s bigint"))

    def sift(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, size = batch.num_rows, np.concatenate([batch.column(c).to_numpy() for c in ("size_a", "size_b")])
        bits = batch.column("bits_a").to_pylist() + batch.column("bits_b").to_pylist()
        fit = _allowed(size.astype(np.int64), bits, np.arange(n), np.arange(n, 2 * n))
        return batch.select(["a", "b"]).take(pa.array(fit))

    a, b = (texts.select(F.col("t1").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")).hint("merge") for c in ("a", "b"))
    pairs = shared.where("key is null").select(F.col("t").alias("a"), F.col("s").alias("b")).distinct()
    sifted = arrow_stage(pairs.join(a, "a").join(b, "b"), sift, "a bigint, b bigint")
    met = shared.where("key is not null").drop("s").join(texts.select(F.col("t1").alias("t"), "size", "bits").hint("merge"), "t").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select("key", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "t", "size", "bits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, found = None, [], []

        def close() -> None:
            if len(rows) < 2:
                return
            t = np.array([r[0] for r in rows], np.int64)
            size, bits = np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]
            rest = np.ones(len(rows), bool)
            while rest.any():
                todo = [int(rest.argmax())]
                rest[todo] = False
                while todo and rest.any():
                    x = todo.pop()
                    free = np.flatnonzero(rest)
                    near = free[_allowed(size, bits, np.full(len(free), x), free)]
                    rest[near] = False
                    todo += near.tolist()
                    found.extend((int(t[x]), int(y)) for y in t[near] if t[x] != y)

        for batch in batches:
            for *cell, t, size, bits in zip(*(batch.column(k).to_pylist() for k in ("key", "i", "j", "t", "size", "bits")), strict=True):
                if cell != held:
                    close()
                    held, rows = cell, []
                rows.append((t, size, bits))
            yield from _links(found)
        close()
        yield from _links(found)

    return in_batches(cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), compare, "a bigint, b bigint").unionByName(sifted).distinct()


def _links(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        u = np.unique(np.sort(np.array(found, np.int64), axis=1), axis=0)
        found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u[:, 0])), pa.array(np.ascontiguousarray(u[:, 1]))], names=["a", "b"])


def _parents(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        u = np.unique(np.array(found, np.int64), axis=0)
        found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u[:, 0])), pa.array(np.ascontiguousarray(u[:, 1]))], names=["parent", "child"])


def _similar(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], same: bool) -> list[tuple[int, int]]:
    """Spanning forest of the pairs (one of each side) of the wanted similarity.

    Hashed membership vectors bound the shared shingles from above by one matrix
    product; what passes is settled on the sets, unless it is linked already.
    """
    mean = sum(len(s) for _, s in left + right) / max(1, len(left) + len(right))
    dims = 1 << int(np.clip(np.ceil(np.log2(16 * mean + 1)), 8, 15))

    def matrix(side: list[tuple[int, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(side), dims), np.float32)
        for i, (_, s) in enumerate(side):
            np.add.at(out[i], s.view(np.uint64) & np.uint64(dims - 1), 1)
        return out

    size = np.array([len(s) for _, s in right])
    # Labels of what is linked so far: left rows first, then right rows; of one block with itself, the same labels.
    label = np.arange(len(left) + (0 if same else len(right)))
    base = 0 if same else len(left)
    b, links, step = matrix(right), [], max(1, (8 << 20) // (4 * max(dims, len(right))))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        own = np.array([len(s) for _, s in part])
        most = np.minimum(np.minimum(matrix(part) @ b.T, own[:, None]), size[None, :])
        close = most >= THRESHOLD * (own[:, None] + size[None, :] - most)
        for x, (u, s) in enumerate(part):
            todo = np.flatnonzero(close[x])
            todo = todo[label[base + todo] != label[at + x]]
            while len(todo):
                y, todo = int(todo[0]), todo[1:]
                v, t = right[y]
                shared = len(np.intersect1d(s, t, assume_unique=True))
                if shared >= THRESHOLD * (len(s) + len(t) - shared):
                    label[label == label[base + y]] = label[at + x]
                    links.append((u, v))
                    todo = todo[label[base + todo] != label[at + x]]
    return links


def inside_clusters(members: DataFrame) -> DataFrame:
    """(u, v): similar documents of one cluster, all pairs looked at in blocks. members: (cluster, node, shingles)."""
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum(F.size("shingles") + 1) / BLOCK), F.ceil(F.count("*") / BLOCK_DOCUMENTS)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "cluster").withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    # Each block meets every block once: cells (i, j) with i <= j.
    other = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = other.select("cluster", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sides, links = None, {}, []

        def close() -> None:
            if held is not None and held[1] in sides:
                left, right = sides[held[1]], sides.get(held[2], [])
                if right:
                    links.extend(_similar(left, right, held[1] == held[2]))

        for batch in batches:
            sets = batch.column("shingles")
            for n, (c, i, j, own, node) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("cluster", "i", "j", "own", "node")), strict=True)):
                if (c, i, j) != held:
                    close()
                    held, sides = (c, i, j), {}
                sides.setdefault(own, []).append((node, sets[n].values.to_numpy()))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["u", "v"])
                links.clear()
        close()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["u", "v"])

    return in_batches(cells.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"), run, "u bigint, v bigint")


def shingle_sets(docs: DataFrame, text: str) -> DataFrame:
    """(cluster, node, shingles): sorted distinct 64-bit hashes of five-word shingles. docs: (cluster, node, text)."""
    import xxhash

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data in batch.column("data").to_pylist():
            w = data.lower().split()
            out.append(sorted({xxhash.xxh3_64_intdigest(b" ".join(w[i : i + SHINGLE])) - (1 << 63) for i in range(max(1, len(w) - SHINGLE + 1))}) if w else [])
        return pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("node"), pa.array(out, pa.list_(pa.int64()))], names=["cluster", "node", "shingles"])

    return cut(arrow_stage(docs.select("cluster", "node", text_bytes(text).alias("data")), run, "cluster bigint, node bigint, shingles array<bigint>"))


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) of the documents that go: another of their group stays."""
    marked = cut(sketches(docs, key, text))
    texts = cut(marked.groupBy("t1", "t2").agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in ("ones", "two", "size", "bits")]))
    same_two = Window.partitionBy("two")
    # Different texts with one word-pair fingerprint: the first stands for it, the others are compared with it.
    low = cut(texts.select("two", "node", F.min("node").over(same_two).alias("low")))
    pairs = candidates(texts.select("ones", "two").distinct())
    ends = low.groupBy("two").agg(F.min("low").alias("node"))
    a, b = (ends.select(F.col("two").alias(c), F.col("node").alias(n)) for c, n in (("a", "u"), ("b", "v")))
    alike = low.where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    exact = exact_candidates(docs, texts, text)
    x, y = (texts.select(F.col("t1").alias(c), F.col("node").alias(n)) for c, n in (("a", "u"), ("b", "v")))
    sure = exact.join(x, "a").join(y, "b").select("u", "v")
    clusters = cut(components(pairs.join(a, "a").join(b, "b").select("u", "v").unionByName(alike).unionByName(sure)))
    whole = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("__text")).join(clusters.select(F.col("id").alias("node"), F.col("component").alias("cluster")).hint("merge"), "node").dropDuplicates(["node"])
    similar = inside_clusters(shingle_sets(whole, "__text"))
    comp = components(similar)
    group = texts.select("t1", "t2", "node").join(comp, texts.node == comp.id, "left").select("t1", "t2", F.coalesce("component", "node").alias("component_id"))
    return marked.select("id", "t1", "t2").join(group, ["t1", "t2"]).where("id is null and component_id is not null or id <> component_id").select(F.col("id").alias("doc_id"), "component_id", "t1", "t2").distinct()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group."""
    gone = cut(duplicates(docs, key, text).select(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")))
    data = text_bytes(text)
    marked = docs.withColumn("__a", F.xxhash64(data)).withColumn("__b", F.xxhash64(F.lit(7), data))
    hit = (F.col("__a") == F.col("__t1")) & (F.col("__b") == F.col("__t2")) & F.col(key).cast("long").eqNullSafe(F.col("__id"))
    # The list grows with the corpus: it is joined by a sorted merge at every size.
    return marked.join(gone.hint("merge"), hit, "left_anti").drop("__a", "__b")

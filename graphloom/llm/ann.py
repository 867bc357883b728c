"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Vectors are lifted so that the largest inner product becomes the smallest
distance, projected by several random orthonormal maps with random shifts, and
given one Hilbert key for each map.  Quantiles of the keys, taken over all rows,
say where on a curve a vector lies.  A query looks at a window of each curve
around its own place; whatever lies there is scored in double precision on the
original vectors, and the windows' best are merged and ranked again.

How many curves are used, and how wide their windows are, is fitted on up to
``ASKED`` sampled vectors, whose true neighbours are found among *all* rows: of
all choices of two or more curves whose windows hold ``TARGET`` of these
neighbours, the one with the fewest rows.  Neighbours that lie close along the
curves make windows narrow.  On data without structure no ordering puts
neighbours together: where all such choices would read more rows for a query
than there are, one curve is read whole instead, in blocks, and misses nothing.

A curve is cut into ranges of a window's size over ``STEPS``, so a query is
copied to ``STEPS + 2`` ranges of a curve at most, whatever the number of rows.
A range of more rows than ``CELL_BYTES`` hold is dealt over several cells by
hash, and its queries visit all of them; a task holds one cell's rows while
queries stream past in batches.  Equal vectors travel once, with their k + 1
smallest ids, since no other copy can be among the k nearest of any query; the
limit is applied map-side too.

Cases: vectors that are null, zero, or hold null or non-finite components take
no part as query or candidate; vectors of unequal length are compared as if the
shorter ended in zeros; ties go to the smaller id; every row but the query's own
is a candidate, also one that shares its id; a query row given twice is answered
twice; very long vectors widen the cells that they lie in; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_stage, cut, in_batches

#: Rows that bound the projections' boxes, and vectors on which windows are fitted.
SAMPLE, ASKED = 4096, 256
TARGET = 0.93
CURVES = 6
DIMS = 6
BITS = 10
#: Quantiles kept of a curve, at most.
QUANTILES = 4096
STEPS = 4
CELL_BYTES = 32 << 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer coordinates, by Gray-code rotation from the top bit down."""
    x = cells.astype(np.uint64).copy()
    n, d = x.shape
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(d):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, d - 1] & (one << np.uint64(b)), (one << np.uint64(b)) - one, np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << one | (x[:, i] >> np.uint64(b)) & one
    return key.view(np.int64)


@dataclass
class Curves:
    """Projections and shifts of every curve, quantiles of their keys, curves used, and a window's reach in quantiles."""

    largest: float
    maps: list[np.ndarray]
    low: list[np.ndarray]
    width: list[np.ndarray]
    quantiles: list[np.ndarray]
    used: int = CURVES
    reach: int = 0

    def lift(self, v: np.ndarray, query: bool) -> np.ndarray:
        size = np.sqrt(np.einsum("ij,ij->i", v, v))
        more = np.zeros((len(v), 1)) if query else np.sqrt(np.maximum(0, 1 - (size / self.largest) ** 2))[:, None]
        return np.hstack([v / (size[:, None] if query else self.largest), more])

    def keys(self, v: np.ndarray, curve: int, query: bool) -> np.ndarray:
        at = self.lift(v, query)
        wide = self.maps[curve].shape[0] - 1
        lifted = at[:, :wide] if at.shape[1] - 1 > wide else np.pad(at[:, :-1], ((0, 0), (0, wide - at.shape[1] + 1)))
        u = (np.hstack([lifted, at[:, -1:]]) @ self.maps[curve] - self.low[curve]) / self.width[curve]
        return hilbert_keys((np.clip(u, 0, 1 - 1e-9) * (1 << BITS)).astype(np.uint64), BITS)

    def place(self, keys: np.ndarray, curve: int) -> np.ndarray:
        """Which quantile a key lies in."""
        return np.searchsorted(self.quantiles[curve], keys, side="right")

    @property
    def width_of_range(self) -> int:
        return max(1, -(-2 * min(self.reach, len(self.quantiles[0])) // STEPS))

    def window(self, at: np.ndarray, curve: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last range that a query at quantile ``at`` looks at; at a curve's end the window moves inwards."""
        last = len(self.quantiles[curve])
        if self.reach >= last:
            return np.zeros_like(at), np.full_like(at, last // self.width_of_range)
        low = np.clip(at - self.reach, 0, max(0, last - 2 * self.reach))
        return low // self.width_of_range, np.minimum(low + 2 * self.reach, last) // self.width_of_range


def box(sample: np.ndarray, largest: float) -> Curves:
    rng = np.random.default_rng(11)
    dims = min(DIMS, sample.shape[1])
    out = Curves(largest, [], [], [], [])
    for _ in range(CURVES):
        out.maps.append(np.linalg.qr(rng.normal(size=(sample.shape[1] + 1, dims)))[0])
        at = out.lift(sample, False) @ out.maps[-1]
        spread = np.maximum(at.max(axis=0) - at.min(axis=0), 1e-9)
        out.low.append(at.min(axis=0) - spread * rng.uniform(0.05, 0.45, dims))
        out.width.append(spread * 1.5)
    return out


def fit(model: Curves, asked: np.ndarray, near: list[np.ndarray]) -> None:
    """Choose curves and reach. asked: places of the queries, queries x curves; near: for each, those of its true neighbours."""
    apart = np.concatenate([np.abs(n - a) for a, n in zip(asked, near, strict=True) if len(n)]) if any(map(len, near)) else np.zeros((1, CURVES), np.int64)
    whole = max(map(len, model.quantiles)) + 1
    best, model.used, model.reach = whole, 1, whole
    for used in range(2, CURVES + 1):
        reach = int(np.quantile(apart[:, :used].min(axis=1), TARGET, method="higher"))
        if (cost := used * (2 * reach + 1)) < best:
            best, model.used, model.reach = cost, used, reach


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows as doubles; shorter ones end in zeros."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(col.offsets.to_numpy())
    if not len(size) or (size == size[0]).all():
        return flat.reshape(len(col), -1)
    out = np.zeros((len(size), size.max()))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(a.shape[1], b.shape[1])
    return a[:, :n] @ b[:, :n].T


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    wide = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) if p.shape[1] < wide else p for p in parts])


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest scores of each row, of equal ones the first."""
    n = min(n, scores.shape[1])
    top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    least = np.take_along_axis(scores, top, axis=1).min(axis=1)
    for row in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > n):
        tied = np.flatnonzero(scores[row] >= least[row])
        top[row] = tied[np.argsort(-scores[row, tied], kind="stable")][:n]
    return top


def _fitted(keyed: DataFrame, drawn: list, model: Curves, k: int) -> None:
    """Fit windows on the true neighbours, among all rows, of sampled vectors."""
    step = max(1, len(drawn) // ASKED)
    some = drawn[::step][:ASKED]
    vid, v = np.array([r["vid"] for r in some], np.int64), _stacked([np.array([r["v"]], np.float64) for r in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, place = np.full((len(vid), 0), 0.0), np.zeros((len(vid), 0, CURVES), np.int64)
        for batch in batches:
            s = _product(v, _matrix(batch.column("v")))
            own = batch.column("vid").to_numpy()
            s[vid[:, None] == own[None, :]] = -np.inf
            at = np.stack([model.place(batch.column(f"k{c}").to_numpy(), c) for c in range(CURVES)], axis=1)
            score, place = np.hstack([score, s]), np.hstack([place, np.broadcast_to(at, (len(vid), *at.shape))])
            top = _best(score, k)
            score, place = np.take_along_axis(score, top, axis=1), np.take_along_axis(place, top[:, :, None], axis=1)
        if score.shape[1]:
            q, n = np.divmod(np.flatnonzero(score.ravel() > -np.inf), score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score[q, n]), pa.array(list(place[q, n]), pa.list_(pa.int64()))], names=["q", "score", "place"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "place")
    met = in_batches(keyed.drop("lead"), run, "q bigint, score double, place array<bigint>").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).collect()
    near = [np.array([r["place"] for r in met if r["q"] == i], np.int64).reshape(-1, CURVES) for i in range(len(vid))]
    fit(model, np.stack([model.place(model.keys(v, c, True), c) for c in range(CURVES)], axis=1), near)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    empty = spark.range(0).selectExpr("id AS query_id", "cast(1 AS int) AS rank", "id AS vec_id", "cast(0 AS double) AS score")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    valid = vectors.where(F.col(key).isNotNull() & sound).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    by_vector = Window.partitionBy("v").orderBy("id")
    few = valid.select("id", "v").withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    # vid numbers the distinct vectors; it is written, so it stays.
    distinct = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("vid", F.monotonically_increasing_id()))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total, largest, wide = distinct.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    if not total:
        return empty
    drawn = distinct.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("vid", "v").collect()
    model = box(_stacked([np.array([r["v"]], np.float64) for r in drawn]), largest * (1 + 1e-9))
    curve_names = [f"k{c}" for c in range(CURVES)]
    kind = distinct.schema["v"].dataType.simpleString()

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(batch.column("v"))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vid", "lead", "v")), *(pa.array(model.keys(v, c, False)) for c in range(CURVES))], names=["vid", "lead", "v", *curve_names])

    lead = F.col("ids")[0].alias("lead")
    keyed = cut(arrow_stage(distinct.select("vid", lead, "v"), keys, f"vid bigint, lead bigint, v {kind}, " + ", ".join(f"{c} bigint" for c in curve_names)))
    pieces = min(QUANTILES, max(4, total // 8))
    shares = [i / pieces for i in range(1, pieces)]
    got = keyed.agg(*[F.percentile_approx(c, shares, 4 * pieces).alias(c) for c in curve_names]).first()
    model.quantiles = [np.array(got[c], np.int64) for c in curve_names]
    _fitted(keyed, drawn, model, k)
    used = model.used

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for c in range(used):
            cell = model.place(batch.column(f"k{c}").to_numpy(), c) // model.width_of_range + c * (QUANTILES + 1)
            out.append(pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("vid"), batch.column("lead"), batch.column("v")], names=["cell", "vid", "lead", "v"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if batch.num_rows else None

    def asking(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        v, row, cell = _matrix(batch.column("v")), [], []
        for c in range(used):
            first, last = model.window(model.place(model.keys(v, c, True), c), c)
            for step in range(int((last - first).max()) + 1):
                there = np.flatnonzero(first + step <= last)
                row.append(there)
                cell.append(first[there] + step + c * (QUANTILES + 1))
        at = pa.array(np.concatenate(row))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell).astype(np.int32)), batch.column("vid").take(at), batch.column("lead").take(at), batch.column("v").take(at)], names=["cell", "vid", "lead", "v"])

    schema = f"cell int, vid bigint, lead bigint, v {kind}"
    asked = cut(valid.where("asked").select("id", "v").join(distinct.select("v", "vid"), "v").select("id", "vid", "v"))
    rows = arrow_stage(keyed, placed, schema)
    ask = arrow_stage(asked.groupBy("vid").agg(F.first("v").alias("v")).select("vid", F.lit(0).cast("long").alias("lead"), "v"), asking, schema)
    most = max(1024, CELL_BYTES // (8 * wide))
    # Proven to be small: a row for each cell, of which curves have QUANTILES + 1 at most.
    parts = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")))
    rows = rows.join(parts, "cell").withColumn("part", F.pmod(F.hash("vid"), F.col("parts"))).withColumn("side", F.lit(0)).drop("parts")
    ask = ask.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1)).drop("parts")
    cells = rows.unionByName(ask).repartition("cell", "part").sortWithinPartitions("cell", "part", "side", "lead")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, mat, found = None, [], [], ([], [], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            tag = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "side")])
            edges = np.flatnonzero((np.diff(tag, axis=1) != 0).any(axis=0)) + 1
            vid = batch.column("vid").to_numpy()
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                cell = tuple(tag[:2, lo])
                if cell != held:
                    held, ids, mat = cell, [], []
                v = _matrix(batch.column("v").slice(lo, hi - lo))
                if tag[2, lo] == 0:
                    ids.append(vid[lo:hi])
                    mat.append(v)
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, mat = [np.concatenate(ids)], [_stacked(mat)]
                for at in range(0, hi - lo, 256):
                    s = _product(v[at : at + 256], mat[0])
                    top = _best(s, k + 1)
                    found[0].append(np.repeat(vid[lo + at : min(hi, lo + at + 256)], top.shape[1]))
                    found[1].append(ids[0][top].ravel())
                    found[2].append(np.take_along_axis(s, top, axis=1).ravel())
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["qvid", "vid", "score"])
                found = ([], [], [])

    met = in_batches(cells, score, "qvid bigint, vid bigint, score double").groupBy("qvid", "vid").agg(F.max("score").alias("score"))
    known = met.join(distinct.select("vid", "ids"), "vid")
    best = Window.partitionBy("qvid").orderBy(F.desc("score"), F.col("ids")[0], "vid")
    short = known.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("qvid", "vid", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("qvid").orderBy(F.desc("score"), "vec_id", "vid")
    lists = short.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    listed = lists.groupBy("qvid").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "vid"))).alias("all"))
    final = asked.select(F.col("id").alias("query_id"), F.col("vid").alias("qvid")).join(listed, "qvid")
    # The query's own row is one entry of its id and vector, if it is there.
    own = F.array_position(F.transform("all", lambda x: (x["vid"] == F.col("qvid")) & (x["vec_id"] == F.col("query_id"))), F.lit(True)).cast("int")
    others = F.slice(F.filter("all", lambda x, i: i != own - 1), 1, k)
    return final.select("query_id", F.posexplode(others).alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))

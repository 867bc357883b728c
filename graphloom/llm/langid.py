"""Hierarchical language identification with linear support vector machines.

A text is first given a language family by one-versus-one linear machines
between families; within the family, one-versus-one machines separate the
languages.  Features are hashed byte uni-, bi- and trigrams of the lower-cased
letters of the whole text, square-rooted and scaled to unit length.

Training takes a bounded sample of labelled rows, chosen by a hash of their key:
about ``PER_LANGUAGE`` rows of each language, and fewer, but about ``FEWEST``
where there are as many, once all together would pass ``SAMPLE``.  Every label
is learned, however rare.  Only the sample's feature vectors of fixed length
reach the driver, and the weights, whose size depends on the number of languages
alone (with its square, as machines are one-versus-one), travel with the tasks.  Prediction is a narrow map.  Worker code stays clear of
BLAS, whose threads do not survive the fork of a worker.

Cases: a null text, or one with no letter, is ``und`` with score 0; an empty table gives
an empty result; extra columns pass through, those named like an added one are
replaced; languages outside the family table are a family of their own; with one learned language
everything else is that language, with none everything is ``und``; bytes that
are not UTF-8 are passed over; long texts are read in blocks; repeated rows are predicted alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_stage, text_bytes

UNKNOWN = "und"
#: Rows of each language in the training sample, at most about: a documented bound.
PER_LANGUAGE = 400
#: Rows of the sample, at most about, while that leaves each language FEWEST rows: documented bounds of what reaches the driver.
SAMPLE, FEWEST = 8192, 20
DIMS = 4096
BLOCK = 1 << 20
#: Families of common languages.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
    "fi": "uralic", "hu": "uralic", "et": "uralic",
}
_SPACED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str) -> np.ndarray | None:
    """Unit vector of the whole text; None if it has no letter."""
    counts = np.zeros(DIMS)
    letters = False
    for at in range(0, len(text), BLOCK):
        part = text[max(0, at - 2) : at + BLOCK].lower()
        letters = letters or any(map(str.isalpha, part))
        data = np.frombuffer(b" " + part.encode("utf-8", "ignore").translate(_SPACED) + b" ", np.uint8).astype(np.uint32)
        pair = data[:-1] << np.uint32(8) | data[1:]
        triple = pair[:-1] << np.uint32(8) | data[2:]
        for codes, salt in ((data, 1), (pair, 2), (triple, 3)):
            mixed = (codes + np.uint32(salt * 0x9E3779)) * np.uint32(2654435761)
            counts += np.bincount(mixed >> np.uint32(20), minlength=DIMS)
    if not letters:
        return None
    counts = np.sqrt(counts)
    return (counts / np.sqrt(np.einsum("i,i->", counts, counts))).astype(np.float32)


def train_pair(x: np.ndarray, y: np.ndarray, epochs: int = 30, cost: float = 8.0) -> np.ndarray:
    """Linear machine by dual coordinate descent on the squared hinge loss; y is +1 or -1. The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # Each side weighs alike, whatever its number of rows.
    c = np.where(y > 0, cost / max(1, (y > 0).sum()), cost / max(1, (y < 0).sum())) * len(y) / 2
    w, alpha, diag, order = np.zeros(x.shape[1]), np.zeros(len(x)), 0.5 / c, np.random.default_rng(7)
    size = np.einsum("ij,ij->i", x, x).astype(np.float64) + diag
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            grad = y[i] * (w @ x[i]) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - grad / size[i])
            if step := new - alpha[i]:
                w += step * y[i] * x[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


@dataclass
class Votes:
    """One-versus-one machines between names."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None  # a row for each pair, the bias last

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Votes:
        out = cls(sorted(set(labels)))
        rows = []
        for i, j in combinations(range(len(out.names)), 2):
            mine = (labels == out.names[i]) | (labels == out.names[j])
            out.pairs.append((i, j))
            rows.append(train_pair(x[mine], np.where(labels[mine] == out.names[i], 1.0, -1.0)).astype(np.float32))
        out.weights = np.stack(rows) if rows else None
        return out

    def decide(self, v: np.ndarray) -> tuple[str, float]:
        """The name with the most wins (ties: larger sum of margins), and the logistic of its weakest margin."""
        n = len(self.names)
        if n == 1:
            return self.names[0], 1.0
        wins, sums, least = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        margins = np.einsum("ij,j->i", self.weights[:, :-1], v) + self.weights[:, -1]
        for (i, j), m in zip(self.pairs, margins.tolist(), strict=True):
            wins[i if m > 0 else j] += 1
            for k, s in ((i, m), (j, -m)):
                sums[k] += s
                least[k] = min(least[k], s)
        best = max(range(n), key=lambda k: (wins[k], sums[k]))
        return self.names[best], float(1 / (1 + np.exp(-2 * np.clip(least[best], -20, 20))))


@dataclass
class Model:
    families: Votes
    inside: dict[str, Votes]

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text) if text else None
        if v is None or not self.families.names:
            return UNKNOWN, 0.0
        family, a = self.families.decide(v)
        lang, b = self.inside[family].decide(v)
        return lang, a * b


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from rows with text and lang; the sample is bounded by ``per_language``."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return Model(Votes([]), {})
    wanted = min(per_language, max(FEWEST, SAMPLE // len(counts)))
    # A language with so few rows that a draw could miss them all gives them all.
    shares = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, 1.0 if n <= 2 * FEWEST else min(1.0, wanted / n))])
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < shares[F.col(lang)] * (1 << 30)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(t.decode("utf-8", "ignore")) for t in batch.column("t").to_pylist()]
        keep = [i for i, v in enumerate(made) if v is not None]
        return pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(keep, pa.int64())), batch.column("l").take(pa.array(keep, pa.int64())), pa.array([made[i].tobytes() for i in keep], pa.binary())], names=["k", "l", "v"])

    sample = arrow_stage(rows.where(drawn).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("l"), text_bytes(text).alias("t")), run, "k string, l string, v binary").collect()
    sample.sort(key=lambda r: (r["l"], r["k"], bytes(r["v"])))
    if not sample:
        return Model(Votes([]), {})
    x = np.stack([np.frombuffer(r["v"], np.float32) for r in sample])
    langs = np.array([r["l"] for r in sample], dtype=object)
    del sample
    family = np.array([FAMILIES.get(name, name) for name in langs], dtype=object)
    return Model(Votes.fit(x, family), {f: Votes.fit(x[family == f], langs[family == f]) for f in sorted(set(family))})


def learnable(key: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the key as text is not 1 modulo 3."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score; a narrow map that passes every other column through."""
    carried = [c for c in docs.columns if c not in ("lang_pred", "score")]
    src = docs.select(*[F.col(f"`{c}`") for c in carried], text_bytes(f"`{text}`").alias("__langid_in"))
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in carried) + ", lang_pred string, score double"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [model.predict(t.decode("utf-8", "ignore")) for t in batch.column("__langid_in").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*carried, "lang_pred", "score"])

    return arrow_stage(src, run, schema)

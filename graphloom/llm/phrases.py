"""Collocations: frequent phrases with position bitmaps, and their association scores.

Texts of a language are gathered into shards of about ``SHARD_WORDS`` words.  In
a shard each distinct word has a bitmap of its positions, compressed to the
blocks of 16 positions that are not empty; a position that no word takes stands
between two pieces.  A phrase's bitmap, shifted by one position and ANDed with
the bitmaps of the words, gives the bitmaps of all phrases one word longer, and
no phrase crosses a piece.  Words are extended depth-first; the popcounts of all
shards are summed by Spark.

1. Shards are written once: words, counts, bitmaps.
2. Every pair of words of a shard leaves its popcount under a 64-bit hash.  Hashes
   whose popcounts reach the least frequency go back to the shards that hold
   them (two pairs of one hash only let a rare phrase through to step 3).
3. Shards extend pairs of such hashes, as long as each new pair in the phrase is
   one of them, which loses no frequent phrase.  Phrases are summed by their
   words; those below the least frequency go.
4. Scores, the cut that counts and the rule on longer phrases are joins.

A key has one row a shard at most before it is summed, however common the
phrase is; a shard holds a bounded number of words, or one whole text.

Cases: null or empty texts have no words; a null language is ``und``; repeated
rows count each time; words may hold any bytes but the separators; an empty
table gives an empty result; a very long text is a shard of its own; other
columns are not looked at, whatever their names; ties are ordered by the phrase.
Counts up to 10**16 are exact (38-digit decimals).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, drop_cut, in_batches, mix64, text_bytes

#: Words that a shard gathers before it is closed.
SHARD_WORDS = 3 << 20
#: Pairs of blocks that are ANDed at once.
AND_BATCH = 1 << 20
LEAST, LONGEST, TOP = 10, 3, 2000
#: A phrase goes if a longer one around it has this share (in percent) of its occurrences.
COVERED = 50

#: Fixed values of the contract: pieces end at .,;:!? and bytes 0x0A to 0x0D; blank and tab stand between words; A-Z are lower-cased.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_SHARD = "lang string, shard bigint, n bigint, words array<binary>, counts array<bigint>, sizes binary, blocks binary, bits binary"
_CODEC = "zstd"


class _Ids(dict):
    """Numbers of words in order of appearance; 0 is the end of a piece, 1 no word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _bitmaps(ids: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences and number of blocks by word, blocks (by word, ascending), bits."""
    at = np.flatnonzero(ids >= 2)
    word = ids[at] - 2
    order = np.argsort(word, kind="stable")
    word, at = word[order], at[order]
    block, bit = at >> 4, np.left_shift(1, at & 15).astype(np.uint16)
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
    return np.bincount(word, minlength=v), np.bincount(word[first], minlength=v), block[first].astype(np.uint32), bits


def _pack(a: np.ndarray) -> bytes:
    return len(a).to_bytes(8, "little") + pa.Codec(_CODEC).compress(np.ascontiguousarray(a).tobytes(), asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec(_CODEC).decompress(data[8:], n * np.dtype(kind).itemsize, asbytes=True), kind)


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = SHARD_WORDS) -> DataFrame:
    """Vertical form of the texts: (lang, shard, n, words, counts, sizes, blocks, bits), a row a shard."""
    src = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).cast("binary").alias("lang"), text_bytes(f"`{text}`").alias("data"))
    schema = pa.schema([("lang", pa.binary()), ("shard", pa.int64()), ("n", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("sizes", pa.binary()), ("blocks", pa.binary()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        open_: dict[bytes, tuple[_Ids, list[np.ndarray]]] = {}
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            for lang, (ids, parts) in open_.items():
                v = len(ids) - 2
                counts, sizes, blocks, bits = _bitmaps(np.concatenate(parts), v)
                if v:
                    row = [lang, task << 32 | made, int(counts.sum()), list(ids)[2:], counts, _pack(sizes.astype(np.uint32)), _pack(np.diff(blocks, prepend=np.uint32(0))), _pack(bits)]
                    made += 1
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)
            open_.clear()
            held = 0

        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data"), strict=True):
                tokens = data.as_py().translate(_LOWER).replace(b"\n", b" \n ").split(b" ")
                if lang not in open_:
                    open_[lang] = (_Ids({b"\n": 0, b"": 1}), [])
                ids, parts = open_[lang]
                got = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
                parts.append(np.append(got[got != 1], np.int32(0)))
                held += len(got)
                if held >= words:
                    yield from close()
        yield from close()

    return in_batches(src, run, _SHARD.replace("lang string", "lang binary")).withColumn("lang", F.col("lang").cast("string"))


class _Shard:
    """The bitmaps of a shard, by word and by block."""

    def __init__(self, words: list[bytes], sizes: bytes, blocks: bytes, bits: bytes):
        self.words = words
        sizes = _unpack(sizes, np.uint32)
        self.word = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        self.block = np.cumsum(_unpack(blocks, np.uint32), dtype=np.uint32).astype(np.int64)
        self.bits = _unpack(bits, np.uint16).astype(np.uint32)
        order = np.argsort(self.block, kind="stable")
        self.by_block_word, self.by_block_bits = self.word[order], self.bits[order]
        self.start = np.zeros(int(self.block.max(initial=-1)) + 3, np.int64)
        np.cumsum(np.bincount(self.block, minlength=len(self.start) - 1), out=self.start[1:])

    def hashes(self, lang: bytes) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh3_64_intdigest(w, 1) for w in self.words), np.uint64, len(self.words)) ^ np.uint64(xxhash.xxh3_64_intdigest(lang, 2))

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bitmaps (phrase, block, bits) of words, some words at a time: whole words, about ``AND_BATCH`` pairs of blocks."""
        ends = np.append(np.flatnonzero(self.word[1:] != self.word[:-1]) + 1, len(self.word))
        at = 0
        while at < len(self.word):
            end = ends[np.searchsorted(ends, at + AND_BATCH // 16)] if at + AND_BATCH // 16 < len(self.word) else len(self.word)
            yield self.word[at:end], self.block[at:end], self.bits[at:end]
            at = end

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bitmaps shifted by one and ANDed with those of all words: (phrase, word, block, bits), none empty."""
        up = bits << np.uint32(1)
        low, carried = up & np.uint32(0xFFFF), (up >> np.uint32(16)) != 0
        stay = low != 0
        phrase = np.concatenate([phrase[stay], phrase[carried]])
        block = np.concatenate([block[stay], block[carried] + 1])
        bits = np.concatenate([low[stay], np.ones(int(carried.sum()), np.uint32)])
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, len(block), AND_BATCH // 16):
            b = block[at : at + AND_BATCH // 16]
            first, n = self.start[b], self.start[b + 1] - self.start[b]
            row = np.repeat(np.arange(len(b)), n)
            with_ = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
            both = bits[at : at + AND_BATCH // 16][row] & self.by_block_bits[with_]
            hit = np.flatnonzero(both)
            row, with_ = row[hit], with_[hit]
            for to, x in zip(out, (phrase[at : at + AND_BATCH // 16][row], self.by_block_word[with_], b[row], both[hit]), strict=True):
                to.append(x)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _summed(phrase: np.ndarray, word: np.ndarray, bits: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (phrase, word) as one code, popcounts, and the code's number for each row."""
    code, number = np.unique(phrase * v + word, return_inverse=True)
    return code, np.bincount(number, np.bitwise_count(bits), len(code)).astype(np.int64), number


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of ordered pairs of word hashes."""
    return mix64(mix64(a) + b * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def pair_counts(sharded: DataFrame) -> DataFrame:
    """(h, shard, cnt): popcounts of all pairs of a shard, under hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _Shard(row["words"], row["sizes"], row["blocks"], row["bits"])
                h, v = s.hashes(row["lang"]), len(s.words)
                for word in s.batches():
                    phrase, then, _, bits = s.extended(*word)
                    code, cnt, _ = _summed(phrase, then, bits, v)
                    yield pa.RecordBatch.from_arrays([pa.array(_pair(h[code // v], h[code % v])), pa.array(np.full(len(code), row["shard"], np.int64)), pa.array(cnt)], names=["h", "shard", "cnt"])

    return in_batches(sharded.select(F.col("lang").cast("binary").alias("lang"), "shard", "words", "sizes", "blocks", "bits"), run, "h bigint, shard bigint, cnt bigint")


def phrase_counts(sharded: DataFrame, frequent: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, a) of two to ``longest`` words, summed over shards; each pair in a phrase has a hash that ``frequent`` (shard, pairs) lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _Shard(row["words"], row["sizes"], row["blocks"], row["bits"])
                h, v, good = s.hashes(row["lang"]), len(s.words), np.unique(np.array(row["pairs"], np.int64))

                def kept(last: np.ndarray, then: np.ndarray) -> np.ndarray:
                    got = _pair(h[last], h[then])  # noqa: B023
                    return good[np.minimum(np.searchsorted(good, got), len(good) - 1)] == got  # noqa: B023

                for word, block, bits in s.batches():
                    # A phrase is a number in `said`; its last word is what the next one must pair with.
                    said, last, names = word, np.arange(v), s.words
                    for _ in range(2, longest + 1):
                        before, then, block, bits = s.extended(said, block, bits)
                        ok = kept(last[before], then)
                        before, then, block, bits = before[ok], then[ok], block[ok], bits[ok]
                        if not len(then):
                            break
                        code, cnt, said = _summed(before, then, bits, v)
                        last = code % v
                        names = [names[p] + b" " + s.words[w] for p, w in zip((code // v).tolist(), last.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(names), pa.binary()), pa.array(names, pa.binary()), pa.array(cnt)], names=["lang", "phrase", "cnt"])

    both = sharded.select(F.col("lang").cast("binary").alias("lang"), "shard", "words", "sizes", "blocks", "bits").join(frequent, "shard")
    got = in_batches(both, run, "lang binary, phrase binary, cnt bigint")
    return got.groupBy(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase")).agg(F.sum("cnt").alias("a"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, covered: int = COVERED, words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language (None: all)."""
    sharded = cut(shards(docs, text, lang, words))
    single = sharded.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").cast("string").alias("phrase")).agg(F.sum("x.counts").alias("a"))
    single = cut(single.where(F.col("a") >= least))
    total = sharded.groupBy("lang").agg(F.sum("n").alias("n"))
    # One shuffle both sums a hash and sends it back to its shards.
    pairs = pair_counts(sharded).withColumn("a", F.sum("cnt").over(Window.partitionBy("h"))).where(F.col("a") >= least)
    frequent = pairs.groupBy("shard").agg(F.collect_list("h").alias("pairs"))
    counts = cut(phrase_counts(sharded, frequent, longest).where(F.col("a") >= least))
    out = cut(scored(counts, single, total, top, covered))
    for used in (sharded, single, counts):
        drop_cut(used)
    return out


def scored(counts: DataFrame, single: DataFrame, total: DataFrame, top: int | None, covered: int) -> DataFrame:
    """Scores of frequent phrases (lang, phrase, a); ``single`` has the words' own counts, ``total`` those of languages."""
    said = counts.withColumn("w", F.split("phrase", " "))
    # Phrases inside longer candidates that have enough of their occurrences.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    around = said.where(F.size("w") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = said.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("first"), F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("rest")))).alias("c")).select("lang", "phrase", "a", "c.*")
    known = single.unionByName(counts.select("lang", "phrase", "a"))
    left, right = known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    score = F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    judged = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = judged.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "b.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

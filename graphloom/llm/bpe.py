"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

A piece (one match of the split pattern) is mapped to Latin-1, so that one byte
is one character, and pyahocorasick reports every vocabulary entry that occurs
in it.  The encoder walks from left to right taking the longest entry that is
*compatible* with the token before it, and steps back to a shorter entry when
it gets stuck.  Two tokens are compatible if re-encoding their joined bytes by
the merge ranks gives exactly these two tokens, which is decided by undoing
their merges along the boundary; a token sequence whose adjacent
tokens are all compatible is the one that rank-ordered merging makes, and every
prefix of a piece has exactly one such sequence.  Compatibility is memoised, and
a bit per position marks dead ends, so the walk is linear in the piece.

Cases: null text is encoded as the empty text (no tokens, hashes of nothing);
a byte that is not UTF-8 stands in the split pattern as a lone surrogate and is
encoded, and decoded again, as that byte; repeated rows are encoded alike; an
empty table gives an empty result; very long pieces are walked in the same
linear loop, never cut; other columns
of the input are passed through untouched by :func:`encode_documents`, those
named like an added one are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import weakref
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import in_batches, text_bytes

#: Entries of the piece and pair memories; they are emptied when full, which changes no result.
MEMO_ENTRIES = 120_000


class Pieces(dict):
    """Tokens of pieces, remembered unless they are long; emptied when full."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        # Weak, so that no cycle keeps an encoder that nothing uses.
        self.bpe = weakref.proxy(bpe)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.bpe.encode_piece(piece.encode("utf-8", "surrogateescape").decode("latin-1"))
        if len(piece) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = found
        return found


class ByteBPE:
    """Exact byte-level BPE for a rank file (base64 token, rank per line) and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.split = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self)
        # A vocabulary entry that merging does not rebuild from its own bytes can never be produced.
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for t, r in ranks.items():
            made, last = self._merged(t)
            if made == [r]:
                if last:
                    self.parts[r] = last
                self.whole[t.decode("latin-1")] = r
                self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        #: By rank: bytes of the token, and the longest entry that is a proper prefix of it (-1: none).
        self.size, self.shorter = [0] * (max(ranks.values(), default=-1) + 1), [-1] * (max(ranks.values(), default=-1) + 1)
        for t, r in self.whole.items():
            self.size[r] = len(t)
            self.shorter[r] = next((self.whole[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.whole), -1)
        self.joined = {pair: r for r, pair in self.parts.items()}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks, pattern)

    def _merged(self, data: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """Merging by rank, for the vocabulary's own entries; also the two parts of the last merge."""
        ranks, parts, last = self.ranks, [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            joined = parts[best] + parts[best + 1]
            if joined not in ranks:
                break
            last = (ranks[parts[best]], ranks[parts[best + 1]])
            parts[best : best + 2] = [joined]
        return [ranks[p] for p in parts], last

    def compatible(self, left: int, right: int) -> bool:
        """Merging the joined bytes gives these two tokens again.

        Merges are undone from the last to the first on the two sides of the
        boundary; the pair breaks if, at some moment, a merge across the boundary
        would have come before the merge undone.  Of merges of one rank the left
        one comes first.
        """
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMO_ENTRIES:
                self.pairs.clear()
            split, joined, limit, a, b = self.parts, self.joined, 1 << 60, left, right
            while True:
                if joined.get((a, b), limit) < limit:
                    found = False
                    break
                x, y = split.get(a), split.get(b)
                if x is None and y is None:
                    found = True
                    break
                if y is None or x is not None and a > b:
                    limit, a = a, x[1]
                else:
                    limit, b = b + 1, y[0]
            self.pairs[key] = found
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Token ids of one piece, given as Latin-1 text of its bytes."""
        token = self.whole.get(piece)
        if token is not None:
            return (token,)
        pairs, size, shorter, longest = self.pairs, self.size, self.shorter, self.automaton.iter_long
        out: list[int] = []
        at = 0
        # Longest matches first: if all neighbours are compatible, the walk ends here.
        for _, token in longest(piece):
            if out:
                fits = pairs.get(out[-1] << 32 | token)
                if not (self.compatible(out[-1], token) if fits is None else fits):
                    break
            out.append(token)
            at += size[token]
        else:
            return tuple(out)
        n = len(piece)
        dead = bytearray(n + 1)
        token = shorter[token]
        while True:
            while token < 0:  # nothing fits here: the token before is made shorter
                dead[at] = 1
                last = out.pop()
                at -= size[last]
                token = shorter[last]
            end = at + size[token]
            fits = not dead[end]
            if fits and out:
                fits = pairs.get(out[-1] << 32 | token)
                if fits is None:
                    fits = self.compatible(out[-1], token)
            if not fits:
                token = shorter[token]
                continue
            out.append(token)
            at = end
            if at == n:
                return tuple(out)
            token = next(longest(piece, at))[1]

    def encode(self, text: str) -> array:
        return array("I", chain.from_iterable(map(self.pieces.__getitem__, self.split.findall(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encoded(df: DataFrame, path: str, pattern: str, fn: Callable[[ByteBPE, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Map Arrow batches with an encoder, loaded once a task and let go with it: workers go on to other stages, and should not carry it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or ByteBPE.load(path, pattern)
            yield fn(bpe, batch)

    return in_batches(df, run, schema)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add an array column of token ids, and the decoded bytes if ``decoded`` names a column; a narrow map, no shuffle."""
    names = [c for c in docs.columns if c not in (ids, decoded)]
    src = docs.withColumn("__bpe_in", text_bytes(text))
    added = f"`{ids}` array<int>" + (f", `{decoded}` binary" if decoded else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names) + ", " + added

    def run(bpe: ByteBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        made, back = [], []
        for data in batch.column("__bpe_in").to_pylist():
            got = bpe.encode(data.decode("utf-8", "surrogateescape"))
            made.append(pa.array(got, pa.int32()))
            if decoded:
                back.append(bpe.decode(got))
        offsets = [0]
        for m in made:
            offsets.append(offsets[-1] + len(m))
        flat = pa.concat_arrays(made) if made else pa.array([], pa.int32())
        cols = [batch.column(n) for n in names] + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
        if decoded:
            cols.append(pa.array(back, pa.binary()))
        return pa.RecordBatch.from_arrays(cols, names=[*names, ids, *([decoded] if decoded else [])])

    return encoded(src.select(*[F.col(f"`{n}`") for n in names], "__bpe_in"), path, pattern, run, schema)


def token_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) without shipping the ids back to the JVM."""
    src = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("data"))

    def run(bpe: ByteBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b = [], [], []
        for data in batch.column("data").to_pylist():
            ids = bpe.encode(data.decode("utf-8", "surrogateescape"))
            n.append(len(ids))
            a.append(hashlib.sha256(ids.tobytes()).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded(src, path, pattern, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

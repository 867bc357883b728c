"""Suffix-array dedup over bytes: range-partitioned suffixes, multikey quicksort.

The array is sparse: of all suffixes, those that start at an anchor (see
:mod:`graphloom.llm.windows`) are kept, each with the bytes before it that its
windows of 400 bytes reach; every window crosses exactly one such suffix start,
and suffixes whose leading 128 bytes occur once are sorted out beforehand.
Spark samples splitters and range-partitions the suffixes by their own leading
tokens; inside a range they are sorted the same way.  Suffixes that share their
leading 128 bytes form a bucket: its windows, one distance to the suffix start
after the other, are sorted by multikey quicksort, which leaves equal ones side
by side.  A run of more than ``BUCKET`` suffixes with equal leading tokens is
parted further by the token after them, and at last by a hash, so ranges and
buckets cut it in pieces, which are compared across their boundaries by window
fingerprints.  Each byte covered by a string of 400 bytes that also starts
elsewhere, the same document included, is removed.

Cases: null text is empty; texts below 400 bytes lose nothing; rows given twice
hold each other's strings and lose them all; matches never cross documents;
long texts are worked on in spans; an empty table gives an empty result; extra
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.windows import BUCKET, Deal, Shape, removals, report, rewrite

WINDOW, GRAM = 400, 128
#: Bytes that the quicksort looks at on each level.
TOKEN = 100


def multikey_quicksort(rows: list[tuple[bytes, int]]) -> Iterator[list[int]]:
    """Three-way partition of suffixes by one token a level; what is equal on the last level is one class."""
    todo = [(rows, 0)]
    while todo:
        items, depth = todo.pop()
        if depth >= len(items[0][0]):
            yield [i for _, i in items]
            continue
        end = depth + TOKEN
        pivot = items[len(items) // 2][0][depth:end]
        less, equal, more = [], [], []
        for item in items:
            token = item[0][depth:end]
            (equal if token == pivot else less if token < pivot else more).append(item)
        for part, at in ((less, depth), (equal, end), (more, depth)):
            if len(part) > 1:
                todo.append((part, at))


def _deal(gram: int) -> Deal:
    """Ranges of suffixes, sorted by the first eight bytes and all of the leading ones; long runs also by what follows."""
    order = [F.col("lead"), F.col("anchor"), F.expr(f"CASE WHEN parts > 1 THEN substring(packed, spot + {gram + 1}, 8) END"), F.expr("CASE WHEN parts > 1 THEN xxhash64(packed) END")]
    return Deal(lambda d: d.repartitionByRange(*order).sortWithinPartitions(*order), lambda r: r["packed"][r["spot"] : r["spot"] + gram], lambda r: r["parts"] == 1)


def _parts(docs: DataFrame, window: int, gram: int, key: str, text: str, bucket: int, keep: bool) -> tuple[DataFrame, DataFrame]:
    return removals(docs, Shape(words=False, length=window, gram=gram, across=False), multikey_quicksort, _deal(gram), key, text, bucket, keep)


def dedup_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n, n_removed, n_spans, kept_sha256): n counts bytes."""
    return report(*_parts(docs, window, gram, key, text, bucket, False))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``docs`` without the repeated strings; bytes of a character cut in two are replaced on decoding."""
    return rewrite(docs, _parts(docs, window, gram, key, text, bucket, True)[1], key, text)

"""Substring dedup over words by super-k-mer partitioning.

Windows of 50 consecutive words that share a minimiser travel as one packed
string to the minimiser's bucket, where sorting the windows counts them exactly
and finds the smallest document of each (see :mod:`graphloom.llm.windows`).
Each word covered by a window that also starts in a document with a smaller id
is removed; windows are judged on the input, not on what is left.  A minimiser
of more than ``BUCKET`` occurrences is dealt over several buckets by a hash of
the packed string.

Cases: null or empty text has no words and loses none; texts shorter than a
window lose none; a null id counts as the greatest id, equal ids never remove
from each other; rows given twice get the same result each; long texts are
worked on in spans; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from graphloom.llm.windows import BUCKET, Deal, Shape, removals, report, rewrite

WINDOW, GRAM = 50, 16


def sort_windows(rows: list[tuple[bytes, int]]) -> Iterator[list[int]]:
    """Sort windows; equal ones come to stand side by side."""
    rows.sort()
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        if end - at > 1:
            yield [i for _, i in rows[at:end]]
        at = end


#: Buckets by minimiser; what is dealt over several parts is never whole.
DEAL = Deal(lambda d: d.repartition("anchor", "part").sortWithinPartitions("anchor", "part"), lambda r: (r["anchor"], r["part"]), lambda r: r["parts"] == 1)


def _parts(docs: DataFrame, window: int, gram: int, key: str, text: str, bucket: int, keep: bool) -> tuple[DataFrame, DataFrame]:
    return removals(docs, Shape(words=True, length=window, gram=gram, across=True), sort_windows, DEAL, key, text, bucket, keep)


def dedup_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n, n_removed, n_spans, kept_sha256): n counts words."""
    return report(*_parts(docs, window, gram, key, text, bucket, False))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``docs`` without the repeated passages."""
    return rewrite(docs, _parts(docs, window, gram, key, text, bucket, True)[1], key, text)

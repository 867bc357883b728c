"""Ratios with guarded denominators, scores and labelled ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return ratio(100 * a, b)


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    """Shared over union, to four places, half to even; 0 where the union is not positive."""
    union = a + b - shared
    return F.when(union > 0, F.bround(shared / union, 4)).otherwise(F.lit(0.0))


def confidence(weight: Column) -> Column:
    """1 - 1 / (1 + weight), to three places."""
    return F.bround(1 - 1 / (1 + weight), 3)


def money(text: Column) -> Column:
    """The number in an amount such as ``$1,234.50``; null if there is none."""
    return F.nullif(F.regexp_replace(text, r"[^0-9.]", ""), F.lit("")).try_cast("double")


def range_label(value: Column, ranges: Sequence[tuple[float | None, str]]) -> Column:
    """The label of the first upper bound that is not below the value; a None bound takes the rest."""
    out = F.lit(None).cast("string")
    for bound, label in reversed(ranges):
        out = F.when(F.lit(True) if bound is None else value <= bound, label).otherwise(out)
    return out


def distribution(df: DataFrame, value: Column, ranges: Sequence[tuple[float | None, str]]) -> DataFrame:
    """(position, label, n) with a row for empty ranges too."""
    labels = df.sparkSession.createDataFrame([(i, label) for i, (_, label) in enumerate(ranges)], "position int, label string")
    counted = df.groupBy(range_label(value, ranges).alias("label")).agg(F.count("*").alias("n"))
    return labels.join(counted, "label", "left").select("position", "label", F.coalesce("n", F.lit(0)).alias("n"))

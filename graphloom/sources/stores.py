"""Stores of derived tables: point lookups, daily sidecars, reset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.corpus import _fs


def mentions_of(mentions: DataFrame, content_hash: str) -> DataFrame:
    return mentions.where(F.col("content_hash") == content_hash).orderBy("mention_ord")


def node_of_alias(nodes: DataFrame, aliases: DataFrame, alias: str) -> DataFrame:
    """The node an alias stands for; the smallest id if several claim it."""
    hit = aliases.where(F.col("alias") == alias).agg(F.min("node_id").alias("id"))
    return nodes.join(hit, "id", "left_semi")


def documents_of(bridge: DataFrame, node_id: int) -> DataFrame:
    return bridge.where(F.col("node_id") == node_id).select("content_hash").orderBy("content_hash")


def save_daily(row: DataFrame, folder: str) -> None:
    """One daily text; a second one of the same date replaces the first. row: (date, ...)."""
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(folder)


def load_daily(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All daily texts; a missing folder is empty, malformed lines are left out."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def reset(spark: SparkSession, folder: str, names: tuple[str, ...], confirmed: bool = False) -> list[str]:
    """Delete derived tables under ``folder``; the corpus is never among them. Returns what was deleted."""
    if not confirmed:
        raise ValueError("reset deletes the derived tables: confirm it")
    gone = []
    for name in names:
        fs, p = _fs(spark, f"{folder}/{name}")
        if fs.exists(p) and fs.delete(p, True):
            gone.append(name)
    return gone

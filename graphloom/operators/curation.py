"""Tables that people edit: read marks, archive, corrections, review suggestions.

Every operator returns the new state as DataFrames; writing goes through
:func:`graphloom.sources.corpus.replace`, never over a table that is being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import better_body, is_compound, noise_reason
from graphloom.operators.resolve import unique_partial_names


def mark_read(documents: DataFrame, hashes: DataFrame, at: str) -> DataFrame:
    """Counter up, flag on and time set for the given hashes; other rows as they were."""
    hit = documents.join(hashes.select("content_hash").distinct().withColumn("__hit", F.lit(True)), "content_hash", "left")
    mine = F.col("__hit").isNotNull()
    new = {"read_count": F.coalesce("read_count", F.lit(0)) + F.when(mine, 1).otherwise(0), "read_fresh": F.when(mine, True).otherwise(F.coalesce("read_fresh", F.lit(False))), "last_read": F.when(mine, F.lit(at)).otherwise(F.col("last_read"))}
    return hit.withColumns(new).select(*documents.columns)


def invalidate_reading(documents: DataFrame) -> DataFrame:
    """The flag goes off everywhere, counters stay."""
    return documents.withColumn("read_fresh", F.lit(False))


def protected(metadata: Column, kinds: tuple[str, ...] = ("synthesis", "awards", "budget")) -> Column:
    """Generated and structured rows bypass the topic gate."""
    return F.coalesce(F.element_at(metadata, F.lit("data_source")).isin(*kinds) | (F.element_at(metadata, F.lit("synthetic")) == "true"), F.lit(False))


def prune(documents: DataFrame, keep: Column, at: str, reason: str = "off topic") -> tuple[DataFrame, DataFrame]:
    """(kept, archived): the complementary split; archived rows carry when and why."""
    good = F.coalesce(keep, F.lit(False))
    return documents.where(good), documents.where(~good).withColumn("archived_at", F.lit(at)).withColumn("archived_reason", F.lit(reason))


def reinstate(active: DataFrame, archive: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(active, archive): rows that pass the gate come back once; those already active leave the archive."""
    fresh = archive.join(active.select("content_hash"), "content_hash", "left_anti")
    good = F.coalesce(keep, F.lit(False))
    order = [c for c in ("doc_ord", "archived_at", "url", "title") if c in fresh.columns] or ["content_hash"]
    back = fresh.where(good).withColumn("__r", F.row_number().over(Window.partitionBy("content_hash").orderBy(*order))).where("__r = 1").drop("__r")
    return active.unionByName(back.select(*active.columns)), fresh.where(~good)


def backfill(documents: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies replaced where the new one is clearly longer. bodies: (content_hash, body)."""
    longest = bodies.groupBy("content_hash").agg(F.max_by("body", F.length("body")).alias("__body"))
    return documents.join(longest, "content_hash", "left").withColumn("raw_text", better_body(F.col("raw_text"), F.col("__body"))).select(*documents.columns)


def upsert_corrections(current: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, surface, canonical): the last merge of a surface wins, ignores are added once. new: with ``ord``."""
    old = current.select("kind", "surface", "canonical", F.lit(-1).cast("long").alias("ord"))
    every = old.unionByName(new.select("kind", "surface", "canonical", F.col("ord").cast("long").alias("ord")))
    return every.groupBy("kind", "surface").agg(F.max_by("canonical", "ord").alias("canonical"))


def append_new(existing: DataFrame, found: DataFrame, *key: str) -> DataFrame:
    """Rows of ``found`` that ``existing`` doesn't hold, once each."""
    rest = [c for c in found.columns if c not in key]
    once = found.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*(rest or key)))).where("__r = 1").drop("__r")
    return once.join(existing.select(*key).distinct(), list(key), "left_anti")


def duplicate_suggestions(nodes: DataFrame) -> DataFrame:
    """(src, dst) names to merge: a unique longer name, unless it only qualifies the shorter."""
    pairs = unique_partial_names(nodes)
    name = nodes.select("node_key", "canonical_name")
    both = pairs.join(name.select(F.col("node_key").alias("src"), F.col("canonical_name").alias("bare")), "src").join(name.select(F.col("node_key").alias("dst"), F.col("canonical_name").alias("full")), "dst")
    return both.where(~is_compound(F.col("bare"), F.col("full"))).select("src", "dst", "bare", "full").orderBy(F.lower("bare"), "src")


def accepted(merges: DataFrame, noise: DataFrame, ord_from: int = 0) -> DataFrame:
    """(kind, surface, canonical, ord): reviewed suggestions as corrections. merges: (bare, full); noise: (canonical_name)."""
    rows = merges.select(F.lit("merge").alias("kind"), F.col("bare").alias("surface"), F.col("full").alias("canonical")).unionByName(noise.select(F.lit("ignore").alias("kind"), F.col("canonical_name").alias("surface"), F.lit(None).cast("string").alias("canonical")))
    return rows.withColumn("ord", F.lit(ord_from).cast("long"))


def noise_suggestions(nodes: DataFrame, trusted: DataFrame) -> DataFrame:
    """(node_key, canonical_name, reason). trusted: (node_key)."""
    known = nodes.join(trusted.select("node_key").distinct().withColumn("__ok", F.lit(True)), "node_key", "left")
    reason = noise_reason(F.col("canonical_name"), F.col("document_count"), F.col("__ok").isNotNull())
    return known.select("node_key", "canonical_name", reason.alias("reason")).where("reason is not null").orderBy(F.lower("canonical_name"), "node_key")


def candidates(nodes: DataFrame, known: DataFrame, documents: int = 3, mentions: int = 5, limit: int = 50) -> DataFrame:
    """Untyped names of several words that are frequent enough to be curated. known: (node_key)."""
    out = nodes.where((F.col("type") == "misc") & F.contains("canonical_name", F.lit(" ")) & (F.col("document_count") >= documents) & (F.col("mention_count") >= mentions))
    return out.join(known.select("node_key"), "node_key", "left_anti").orderBy(F.desc("mention_count"), F.desc("document_count"), "canonical_name").limit(limit)

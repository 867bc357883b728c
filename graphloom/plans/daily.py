"""The daily run: fetched material through gate, cap and de-duplication into the corpus, then a new graph and a line of history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import is_relevant
from graphloom.operators import quality
from graphloom.plans.api import Landscape, rebuild
from graphloom.session import cut
from graphloom.sources import corpus, feeds, records

#: Bodies from this length on count as extracted.
LEAST_BODY = 400


@dataclass
class Ingest:
    """What a batch adds, and the scorecard by source."""

    new: DataFrame
    scorecard: DataFrame


def feed_batch(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """Entries of feed files (one XML document a file); the file's name is the source."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return feeds.parse(spark.read.text(path, wholetext=True).select(name.alias("source"), F.col("value").alias("raw")), most)


def award_batch(spark: SparkSession, path: str, phrases: Sequence[str], acronyms: Sequence[str] = ()) -> DataFrame:
    rows = records.relevant_awards(records.awards(spark, path), phrases, acronyms)
    return records.award_documents(rows).withColumn("feed_pos", F.monotonically_increasing_id())


def budget_batch(spark: SparkSession, path: str, header: str, research: str, phrases: Sequence[str], most_books: int = 8, most: int = 80) -> DataFrame:
    """Sections on topic of text extracted from budget books, at most ``most`` a run in book and page order."""
    books = records.pdf_texts(spark, path, most_books).withColumn("content_hash", F.col("path"))
    chunks = records.relevant_sections(records.sections(books, header), books.select("content_hash", "text"), research, phrases)
    first = chunks.orderBy("content_hash", "n").limit(most)
    return first.select(F.lit("budget").alias("source"), F.concat_ws("#", "content_hash", "n").alias("url"), "title", F.lit("").alias("published"), F.col("body").alias("raw_text"), F.create_map(F.lit("data_source"), F.lit("budget")).alias("metadata"), F.col("n").cast("long").alias("feed_pos"))


def ingest(batch: DataFrame, known: DataFrame, phrases: Sequence[str], acronyms: Sequence[str], at: str, most: int = 50) -> Ingest:
    """Cap, gate and de-duplicate a batch (source, feed_pos, title, url, published, raw_text, ...) against known hashes."""
    full = batch if "metadata" in batch.columns else batch.withColumn("metadata", F.create_map().cast("map<string,string>"))
    rows = corpus.cap(full, most).withColumn("content_hash", corpus.content_hash(F.col("title"), F.col("raw_text"))).withColumn("relevant", is_relevant(F.concat_ws(" ", "title", "raw_text"), phrases, acronyms))
    ranked = rows.withColumn("doc_ord", F.struct("source", "feed_pos", "url"))
    new = cut(corpus.new_documents(ranked.where("relevant"), known).withColumn("fetched_at", F.lit(at)))
    added = new.select("source", "feed_pos", "url", F.lit(True).alias("__new"))
    marked = rows.join(added, ["source", "feed_pos", "url"], "left").select("source", F.col("__new").isNotNull().alias("added"), (F.length("raw_text") >= LEAST_BODY).alias("extracted"), "relevant", F.lit(None).cast("string").alias("error"))
    return Ingest(new.select("doc_ord", "source", "url", "title", "published", "fetched_at", "content_hash", "raw_text", F.col("metadata").cast("map<string,string>").alias("metadata")), quality.ingest_scorecard(marked))


def history_row(land: Landscape, scorecard: DataFrame, finished_at: str) -> DataFrame:
    """One row of the run history: figures, KPIs and the scorecard by source."""
    figures = quality.kpis(land.documents, land.mentions, land.nodes, land.edges)
    feed = F.struct("fetched", "added", "extracted", "filtered", "error")
    by_source = scorecard.agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("source", F.lit("")), feed))).alias("feeds"), F.sum("fetched").alias("fetched"), F.sum("added").alias("added"), F.sum("filtered").alias("filtered"))
    extra = ("singletons", "isolated", "partial_name_dups", "singleton_pct", "isolated_pct", "mentions_per_node")
    kpis = F.create_map(*[x for k in extra for x in (F.lit(k), F.col(k).cast("double"))])
    return figures.select(F.lit(finished_at).cast("timestamp").alias("finished_at"), *[by_source.select(c).scalar().alias(c) for c in ("fetched", "added", "filtered")], *quality.KPIS, by_source.select("feeds").scalar().alias("feeds"), kpis.alias("kpis"))


def run(spark: SparkSession, path: str, batch: DataFrame, gazetteer: DataFrame, phrases: Sequence[str], acronyms: Sequence[str], at: str, history: str | None = None, corrections: DataFrame | None = None) -> tuple[Landscape, DataFrame]:
    """(landscape, scorecard): ingest, rebuild, and append to the history."""
    got = ingest(batch, corpus.hashes(corpus.load(spark, path)), phrases, acronyms, at)
    corpus.append(got.new, path)
    land = rebuild(corpus.load(spark, path), gazetteer, at, corrections=corrections)
    if history:
        records.append_run(history_row(land, got.scorecard, at), history)
    return land, got.scorecard

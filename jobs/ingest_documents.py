"""Incremental ingestion: new document files through the topic gate and de-duplication into a partitioned corpus.

A file stream with a checkpoint takes only files it has not seen, and ends when
all are read.  Documents on topic whose text no earlier batch holds are added,
one for each text; a scorecard counts by source what came in, what was added,
filtered or known.  Both are partitioned Parquet, a folder a batch, and a batch
that runs again replaces its folder.

    python -m jobs.ingest_documents --source DIR --output DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import is_relevant, matched_terms
from graphloom.streaming import ingest
from jobs.common import command_line, log

SOURCE = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DOCUMENTS = "doc_id bigint, content_hash string, source string, lang string, n_chars bigint, terms string, text string, batch bigint, feed string"
SCORECARD = "fetched bigint, added bigint, filtered bigint, known bigint, batch bigint, feed string"

#: Documents without a source are a feed of this name.
NO_SOURCE = "unknown"


def _feed():
    return F.coalesce(F.nullif("source", F.lit("")), F.lit(NO_SOURCE)).alias("feed")


def additions(rows: DataFrame, known: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Rows on topic, one for each text that ``known`` (content_hash) doesn't hold: that of the smallest doc_id."""
    phrases, acronyms = config["phrases"], config["acronyms"]
    hit = rows.where(is_relevant(F.col("text"), phrases, acronyms)).withColumn("content_hash", F.sha2("text", 256))
    # The smallest (doc_id, source, lang) is found before rows move; texts of one hash are the same.
    first = hit.groupBy("content_hash").agg(F.min(F.struct("doc_id", "source", "lang", "n_chars", "text")).alias("r")).select("content_hash", "r.*")
    new = first.join(known, "content_hash", "left_anti")
    return new.select("doc_id", "content_hash", "source", "lang", "n_chars", F.array_join(matched_terms(F.col("text"), phrases, acronyms), ",").alias("terms"), "text", _feed())


def scorecard(rows: DataFrame, added: DataFrame, config: dict[str, Any]) -> DataFrame:
    """(feed, fetched, added, filtered, known): rows that came in, were added, are off topic, or repeat a text."""
    came = rows.groupBy(_feed()).agg(F.count("*").alias("fetched"), F.count_if(~is_relevant(F.col("text"), config["phrases"], config["acronyms"])).alias("filtered"))
    got = added.groupBy("feed").agg(F.count("*").alias("added"))
    return came.join(got, "feed", "left").select("fetched", F.coalesce("added", F.lit(0)).alias("added"), "filtered", (F.col("fetched") - F.col("filtered") - F.coalesce("added", F.lit(0))).alias("known"), "feed")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict[str, Any]) -> DataFrame:
    """Take what is new in SOURCE into OUTPUT/documents and OUTPUT/scorecard; returns the corpus as it stands."""
    corpus, cards = f"{output}/documents", f"{output}/scorecard"
    ingest.prepared(spark, corpus, DOCUMENTS, ["feed"])
    ingest.prepared(spark, cards, SCORECARD, ["feed"])

    def prepare(batch: DataFrame, number: int) -> DataFrame:
        session = batch.sparkSession
        known = ingest.written(session, corpus, DOCUMENTS, besides=number).select("content_hash")
        additions(batch, known, config).write.mode("overwrite").partitionBy("feed").parquet(f"{corpus}/batch={number}")
        added = ingest.written(session, corpus, DOCUMENTS).where(F.col("batch") == number)
        return scorecard(batch, added, config)

    stream = spark.readStream.schema(SOURCE)
    if config.get("files_per_batch"):
        stream = stream.option("maxFilesPerTrigger", config["files_per_batch"])
    before = ingest.written(spark, cards, SCORECARD).agg(F.max("batch")).first()[0]
    query = ingest.append_to(stream.parquet(source), cards, checkpoint, prepare, ["feed"])
    query.awaitTermination()
    # A batch that runs again has a number that was there before.
    batches = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    first = min([*batches, -1 if before is None else before + 1])
    for r in ingest.written(spark, cards, SCORECARD).where(F.col("batch") >= first).groupBy("batch").agg(*[F.sum(c).alias(c) for c in ("fetched", "added", "filtered", "known")]).orderBy("batch").collect():
        log.info("batch %d: read %d rows of %s; wrote %d to %s, left out %d off topic and %d known", r["batch"], r["fetched"], source, r["added"], corpus, r["filtered"], r["known"])
    if not batches:
        log.info("nothing new in %s", source)
    return ingest.written(spark, corpus, DOCUMENTS)


if __name__ == "__main__":
    command_line("ingest-documents", __file__, {"source": "folder of Parquet files, or a pattern of files or folders", "output": "folder of the corpus", "checkpoint": "folder of the stream's progress"}, run)

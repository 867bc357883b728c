"""Streaming forms of ingestion: de-duplicated appends, volumes in windows, sessions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def dedup(stream: DataFrame, key: str = "content_hash", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """First row of each key; keys are forgotten once the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])


def volume(stream: DataFrame, width: str = "1 hour", time: str = "ts", by: str = "event_type", late: str = "1 hour") -> DataFrame:
    """(window_start, by, n) in tumbling windows."""
    marked = stream.withWatermark(time, late) if stream.isStreaming else stream
    return marked.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", time: str = "ts", by: str = "user_id", late: str = "1 hour") -> DataFrame:
    """(by, session_start, session_end, n): runs of events no further apart than the gap."""
    marked = stream.withWatermark(time, late) if stream.isStreaming else stream
    return marked.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def append_to(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame, int], DataFrame] = lambda df, _: df, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Each micro-batch prepared and written once, as the folder ``batch=N`` of ``path``; ends when what is there has been read.

    The batch's number comes from the checkpoint.  A batch that runs again
    because its writer died before the checkpoint took note replaces the whole
    folder that the first attempt left, so no row is lost or doubled.
    ``prepare`` gets the rows and the number; what it reads of ``path`` must be of
    other batches (:func:`written`).
    """

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch, number).write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def prepared(spark: SparkSession, path: str, schema: str, partition_by: Sequence[str] = ()) -> None:
    """Make ``path`` readable before the first batch: an empty table, if nothing is there."""
    empty = spark.createDataFrame([], schema).drop("batch")
    empty.write.mode("ignore").partitionBy(*partition_by).parquet(f"{path}/batch=-1")


def written(spark: SparkSession, path: str, schema: str, besides: int | None = None) -> DataFrame:
    """The rows of all batches, or of all but one; schema: with the partition columns and ``batch bigint``."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if besides is None else rows.where(F.col("batch") != besides)

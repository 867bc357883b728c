"""The corpus pipeline: five stages over ``documents``, each an operator of graphloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document below this score is of no language that was learned.
LEAST_SCORE = 0.02


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents in which no learned language is recognised."""
    from graphloom.llm.langid import UNKNOWN, fit, learnable, predict

    model = fit(docs.where(learnable()).select("doc_id", "text", "lang"))
    return predict(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of exact or near copies."""
    from graphloom.llm.neardup import dedup

    return dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of 50 words out of all but the first document that holds them."""
    from graphloom.llm.substring import dedup

    cleaned = dedup(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a benchmark item."""
    from graphloom.llm.decontam import remove

    return remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    import public_tokenizers

    from graphloom.llm.bpe import encode_documents

    done = encode_documents(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: SQL expresses neither the classifier nor the fingerprints; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's output is deleted once the next one is written, the last one's input stays for the reader."""
    from graphloom.llm.common import drop_path, shared_dir

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark).rstrip('/')}/graphloom-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
        if i:
            drop_path(spark, f"{root}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)

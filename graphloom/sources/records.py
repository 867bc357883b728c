"""Structured sources: award records, budget books, enrichment plans, run history, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.numeric import money
from graphloom.functions.text import is_relevant, matched_terms
from graphloom.schemas import RUN_HISTORY

AWARD = "firm STRING, award_title STRING, agency STRING, branch STRING, phase STRING, program STRING, agency_tracking_number STRING, contract STRING, proposal_award_date STRING, award_year STRING, award_amount STRING, topic_code STRING, research_area_keywords STRING, pi_name STRING, ri_name STRING, city STRING, state STRING, abstract STRING, award_link STRING"


def awards(spark: SparkSession, path: str, most: int = 150) -> DataFrame:
    """Award records from JSON (arrays or lines), at most ``most`` a run in file order."""
    rows = spark.read.schema(AWARD).option("multiLine", True).json(path).withColumn("__file", F.col("_metadata.file_path")).withColumn("__at", F.monotonically_increasing_id())
    return rows.orderBy("__file", "__at").limit(most).drop("__file", "__at")


def award_documents(rows: DataFrame, base: str = "https://awards.invalid/") -> DataFrame:
    """Documents from award records: lead sentences, abstract and metadata, all as columns."""
    has = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    amount = money(F.col("award_amount"))
    who = F.concat_ws(", ", F.nullif("agency", F.lit("")), F.nullif("branch", F.lit("")))
    lead = F.concat_ws(
        " ",
        F.when(has("firm"), F.concat("firm", F.lit(" received an award from "), who, F.lit("."))),
        F.when(amount.isNotNull(), F.concat(F.lit("The award is worth $"), F.format_number(amount, 0), F.lit("."))),
        F.when(has("contract"), F.concat(F.lit("Contract "), F.col("contract"), F.lit("."))),
        F.when(has("ri_name"), F.concat(F.lit("Research partner: "), F.col("ri_name"), F.lit("."))),
        F.when(has("pi_name"), F.concat(F.lit("Principal investigator: "), F.col("pi_name"), F.lit("."))),
    )
    url = F.coalesce(F.nullif("award_link", F.lit("")), F.concat(F.lit(base), F.coalesce(F.nullif("agency_tracking_number", F.lit("")), F.nullif("contract", F.lit("")), F.sha2(F.concat_ws("|", "firm", "award_title"), 256))))
    meta = F.map_filter(F.create_map(F.lit("data_source"), F.lit("awards"), *[x for k in ("firm", "agency", "phase", "program", "state") for x in (F.lit(k), F.col(k))], F.lit("amount"), amount.cast("string")), lambda k, v: v.isNotNull())
    text = F.trim(F.concat_ws(" ", lead, "abstract"))
    return rows.select(F.lit("awards").alias("source"), url.alias("url"), F.col("award_title").alias("title"), F.coalesce(F.nullif("proposal_award_date", F.lit("")), "award_year").alias("published"), text.alias("raw_text"), meta.alias("metadata"))


def relevant_awards(rows: DataFrame, phrases: Sequence[str], acronyms: Sequence[str] = ()) -> DataFrame:
    return rows.where(is_relevant(F.concat_ws(" ", "award_title", "abstract", "research_area_keywords"), phrases, acronyms))


def sections(texts: DataFrame, header: str, generic: str = "Program section", title_length: int = 160, body_length: int = 8000) -> DataFrame:
    """(content_hash, n, title, body): one chunk from each header on; a text without one is one chunk.

    header: a pattern without groups that matches a whole header line.
    """
    split = texts.select("content_hash", F.regexp_extract_all("text", F.lit(f"({header})"), 1).alias("heads"), F.split("text", header, -1).alias("bodies"))
    chunk = F.when(F.size("heads") == 0, F.array(F.struct(F.lit(generic).alias("title"), F.col("bodies")[0].alias("body")))).otherwise(F.transform("heads", lambda h, i: F.struct(h.alias("title"), F.get(F.col("bodies"), i + 1).alias("body"))))
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return split.select("content_hash", F.posexplode(chunk).alias("n", "c")).select("content_hash", "n", F.left(clean("c.title"), F.lit(title_length)).alias("title"), F.left(clean("c.body"), F.lit(body_length)).alias("body"))


def relevant_sections(chunks: DataFrame, documents: DataFrame, research: str, phrases: Sequence[str]) -> DataFrame:
    """Chunks on topic, of documents that hold the research marker. documents: (content_hash, text)."""
    marked = documents.where(F.col("text").rlike(research)).select("content_hash")
    return chunks.where(is_relevant(F.concat_ws(" ", "title", "body"), phrases)).join(marked, "content_hash", "left_semi")


def pdf_texts(spark: SparkSession, path: str, most: int = 8) -> DataFrame:
    """(path, text) of text extracted beside PDF files (``*.txt``); no PDF library is assumed."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).orderBy("path").limit(most)


def enrichment(plans: DataFrame, known: DataFrame, phrases: Sequence[str], acronyms: Sequence[str] = ()) -> DataFrame:
    """New documents of enrichment plans: the synthesis, then articles, on topic and not yet known.

    plans: (entity, articles array<struct<url,title,source,published,html>>,
    synthesis struct<title,body,source>); known: (content_hash).
    """
    from graphloom.sources.corpus import content_hash, new_documents
    from graphloom.sources.feeds import html_to_text_native

    generated = plans.where("synthesis is not null").select("entity", F.lit(0).alias("doc_ord"), F.col("synthesis.title").alias("title"), F.concat(F.lit("generated:"), F.sha2(F.concat_ws("|", "entity", "synthesis.body"), 256)).alias("url"), F.col("synthesis.source").alias("source"), F.lit(None).cast("string").alias("published"), F.col("synthesis.body").alias("raw_text"), F.lit("true").alias("synthetic"))
    articles = plans.select("entity", F.posexplode("articles").alias("i", "a")).select("entity", (F.col("i") + 1).alias("doc_ord"), "a.title", "a.url", "a.source", "a.published", html_to_text_native(F.col("a.html")).alias("raw_text"), F.lit("false").alias("synthetic"))
    rows = generated.unionByName(articles).where(is_relevant(F.concat_ws(" ", "title", "raw_text"), phrases, acronyms))
    return new_documents(rows.withColumn("content_hash", content_hash(F.col("title"), F.col("raw_text"))), known)


def plan_gate(plans: DataFrame, phrases: Sequence[str], acronyms: Sequence[str] = ()) -> DataFrame:
    """(entity, relevant, location, terms): the first part of a plan that is on topic, the synthesis before the articles, and its terms."""
    hit = lambda title, body: is_relevant(F.concat_ws(" ", title, body), phrases, acronyms)
    first = F.array_min(F.array_compact(F.transform(F.coalesce("articles", F.array().cast(plans.schema["articles"].dataType)), lambda a, i: F.when(hit(a["title"], a["html"]), i + 1))))
    where = F.when(hit(F.col("synthesis.title"), F.col("synthesis.body")), "synthesis").when(first.isNotNull(), F.concat(F.lit("article "), first))
    at = F.get("articles", first - 1)
    said = F.when(where == "synthesis", F.concat_ws(" ", "synthesis.title", "synthesis.body")).when(first.isNotNull(), F.concat_ws(" ", at["title"], at["html"]))
    return plans.select("entity", where.isNotNull().alias("relevant"), where.alias("location"), matched_terms(said, phrases, acronyms).alias("terms"))


def run_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_HISTORY).option("mode", "DROPMALFORMED").json(path)


def tail(runs: DataFrame, k: int = 60) -> DataFrame:
    return runs.orderBy(F.desc("finished_at")).limit(k)


def append_run(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Every table of the graph and the corpus as Parquet under one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def latest_daily(daily: DataFrame) -> DataFrame:
    """The sidecar with the greatest date. daily: (date, ...)."""
    return daily.orderBy(F.desc("date")).limit(1)


def html_graph(nodes: DataFrame) -> DataFrame:
    """Display size of each node for a graph export: 12 + 40 sqrt(mentions / most mentions)."""
    most = nodes.agg(F.max("mention_count").alias("m")).scalar()
    return nodes.withColumn("size", F.round(12 + 40 * F.sqrt(F.col("mention_count") / F.greatest(most, F.lit(1))), 4))

"""Counts, shares, coverage and run-over-run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.dates import date_status, hours_since
from graphloom.functions.numeric import percent, ratio
from graphloom.operators.graph import endpoints
from graphloom.schemas import CO_OCCURS

KPIS = ("documents", "entities", "nodes", "edges", "typed_relations")


def share(df: DataFrame, key: str) -> DataFrame:
    """(key, count, percent), most common first."""
    counted = df.groupBy(key).agg(F.count("*").alias("count"))
    total = counted.agg(F.sum("count").alias("t")).scalar()
    return counted.select(key, "count", F.bround(percent(F.col("count"), total), 1).alias("percent")).orderBy(F.desc("count"), key)


def overview(documents: DataFrame, mentions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of funnel counts and quality figures."""
    touched = endpoints(edges).distinct()
    n = nodes.join(touched.withColumn("linked", F.lit(True)), "id", "left").agg(F.count("*").alias("nodes"), F.count_if(F.col("mention_count") == 1).alias("singletons"), F.count_if(F.col("linked").isNull()).alias("isolated"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("relation") != CO_OCCURS).alias("typed_relations"))
    d, m = documents.agg(F.count("*").alias("documents")), mentions.agg(F.count("*").alias("entities"))
    spark = documents.sparkSession
    one = spark.range(1).select(d.scalar().alias("documents"), m.scalar().alias("entities"), *[n.select(c).scalar().alias(c) for c in n.columns], *[e.select(c).scalar().alias(c) for c in e.columns])
    c = F.col
    return one.select("*", F.bround(percent(c("singletons"), c("nodes")), 1).alias("singleton_pct"), F.bround(percent(c("isolated"), c("nodes")), 1).alias("isolated_pct"), F.bround(ratio(c("entities"), c("nodes")), 2).alias("mentions_per_node"))


#: Lower bounds of the ranges that degrees, mentions and document counts are counted in.
RANGES = (0, 1, 2, 5, 10, 50)


def distributions(nodes: DataFrame, edges: DataFrame, bounds: Sequence[int] = RANGES) -> DataFrame:
    """(figure, bucket, count): how many nodes have how many edges, mentions and documents."""
    degree = endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"))
    each = nodes.join(degree, "id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"), F.col("mention_count").alias("mentions"), F.col("document_count").alias("documents"))
    low = lambda c: F.array_max(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= c))
    long = each.select(F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), low(F.col(c)).alias("bucket")) for c in each.columns])).alias("x"))
    return long.groupBy("x.figure", "x.bucket").agg(F.count("*").alias("count")).orderBy("figure", "bucket")


def kpis(documents: DataFrame, mentions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for the run history: the overview's figures and the number of partial-name duplicates."""
    partial = partial_duplicates(nodes).agg(F.count("*").alias("n"))
    return overview(documents, mentions, nodes, edges).withColumn("partial_name_dups", partial.scalar())


def date_quality(documents: DataFrame) -> DataFrame:
    """(source, documents, parsed, missing, unparseable, unparseable_pct) and a total row with a null source."""
    marked = documents.select("source", date_status(F.col("published")).alias("s"))
    by = marked.rollup("source").agg(F.count("*").alias("documents"), *[F.count_if(F.col("s") == s).alias(s) for s in ("parsed", "missing", "unparseable")], F.grouping("source").alias("__total"))
    out = by.withColumn("unparseable_pct", F.bround(percent(F.col("unparseable"), F.col("documents")), 1))
    return out.orderBy("__total", F.desc("unparseable_pct"), "source").withColumn("source", F.when(F.col("__total") == 0, F.coalesce("source", F.lit("")))).drop("__total")


def source_health(documents: DataFrame, runs: DataFrame, as_of: str, last_runs: int = 14, stale_days: int = 14) -> DataFrame:
    """(source, documents, last_fetched, hours_since, runs_with_adds, stale). runs: (finished_at, feeds)."""
    have = documents.groupBy("source").agg(F.count("*").alias("documents"), F.max(F.col("fetched_at").cast("timestamp")).alias("last_fetched"))
    lately = runs.orderBy(F.desc("finished_at")).limit(last_runs).select(F.explode("feeds").alias("source", "f"))
    adds = lately.groupBy("source").agg(F.count_if(F.col("f.added") > 0).alias("runs_with_adds"))
    out = have.join(adds, "source", "full_outer").select("source", F.coalesce("documents", F.lit(0)).alias("documents"), "last_fetched", F.coalesce("runs_with_adds", F.lit(0)).alias("runs_with_adds")).withColumn("hours_since", hours_since(F.col("last_fetched"), F.lit(as_of)))
    return out.withColumn("stale", F.coalesce(F.col("hours_since") > 24 * stale_days, F.lit(True)) & (F.col("runs_with_adds") == 0)).orderBy(F.desc("stale"), "source")


def signal_coverage(documents: DataFrame, mentions: DataFrame, short: int = 300, examples: int = 5) -> DataFrame:
    """(kind, n, examples): documents without mentions, and with a short body."""
    none = documents.join(mentions.select("content_hash").distinct(), "content_hash", "left_anti").select(F.lit("no mentions").alias("kind"), "content_hash", "doc_ord")
    thin = documents.where(F.length("raw_text").between(1, short - 1)).select(F.lit("short body").alias("kind"), "content_hash", "doc_ord")
    rows = none.unionByName(thin)
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("doc_ord"))).where(F.col("r") <= examples)
    shown = first.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "content_hash"))), lambda x: x["content_hash"]).alias("examples"))
    return rows.groupBy("kind").agg(F.count("*").alias("n")).join(shown, "kind")


def reading(documents: DataFrame) -> DataFrame:
    """One row: documents ever read, fresh, stale and never read; reads in all; last read."""
    n = F.coalesce("read_count", F.lit(0))
    fresh = F.coalesce("read_fresh", F.lit(False))
    return documents.agg(F.count("*").alias("documents"), F.count_if(n > 0).alias("ever"), F.count_if(fresh).alias("fresh"), F.count_if((n > 0) & ~fresh).alias("stale"), F.count_if(n == 0).alias("never"), F.sum(n).alias("reads"), F.max("last_read").alias("last_read"))


def stale_reading(documents: DataFrame, limit: int = 20) -> DataFrame:
    return documents.where(~F.coalesce("read_fresh", F.lit(False))).orderBy(F.coalesce("read_count", F.lit(0)), F.asc_nulls_first("last_read"), "doc_ord").limit(limit)


def ingest_scorecard(fetched: DataFrame) -> DataFrame:
    """(source, fetched, added, extracted, filtered, error). fetched: (source, added, extracted, relevant, error)."""
    return fetched.groupBy("source").agg(F.count("*").alias("fetched"), F.count_if("added").alias("added"), F.count_if("extracted").alias("extracted"), F.count_if(~F.col("relevant")).alias("filtered"), F.max("error").alias("error"))


def drop_counts(documents: DataFrame, keep) -> DataFrame:
    """(source, dropped) of documents that ``keep`` does not hold for."""
    return documents.where(~F.coalesce(keep, F.lit(False))).groupBy("source").agg(F.count("*").alias("dropped"))


def run_diff(runs: DataFrame, kpis: Sequence[str] = KPIS, flag_pct: float = 10.0) -> DataFrame:
    """(kpi, previous, current, delta, pct, flagged) of the last two runs; figures missing in either are left out."""
    last = runs.orderBy(F.desc("finished_at")).limit(2).select("finished_at", *[F.col(k).cast("double").alias(k) for k in kpis])
    long = last.unpivot(["finished_at"], list(kpis), "kpi", "value")
    two = long.groupBy("kpi").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.min_by("value", "finished_at").alias("previous"), F.max_by("value", "finished_at").alias("current")).where("n = 2 and known = 2")
    pct = F.bround(F.try_divide(100 * (F.col("current") - F.col("previous")), F.col("previous")), 1)
    return two.select("kpi", "previous", "current", (F.col("current") - F.col("previous")).alias("delta"), pct.alias("pct"), F.coalesce(F.abs(pct) >= flag_pct, F.lit(False)).alias("flagged")).orderBy("kpi")


def broken_sources(runs: DataFrame, limit: int = 60) -> DataFrame:
    """(source, failures, last_failure, error) over the last runs."""
    each = runs.orderBy(F.desc("finished_at")).limit(limit).select("finished_at", F.explode("feeds").alias("source", "f")).where(F.coalesce("f.error", F.lit("")) != "")
    return each.groupBy("source").agg(F.count("*").alias("failures"), F.max("finished_at").alias("last_failure"), F.max_by("f.error", "finished_at").alias("error")).orderBy(F.desc("failures"), "source")


def partial_duplicates(nodes: DataFrame, mode: str = "first") -> DataFrame:
    """One-word names that a longer name of their type may mean. ``unique`` or ``first``, as in coreference."""
    from graphloom.operators.resolve import unique_partial_names

    return unique_partial_names(nodes, mode)

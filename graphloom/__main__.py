"""Command line: ``python -m graphloom VERB ...`` over a corpus of JSON lines and a folder of graph tables."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import dates, text
from graphloom.functions.text import normalize
from graphloom.operators import curation, digest, quality
from graphloom.plans import daily
from graphloom.plans.api import Landscape, rebuild
from graphloom.plans.serve import server
from graphloom.schemas import CORRECTIONS
from graphloom.session import cut
from graphloom.sources import corpus, feeds, records, stores

TABLES = ("documents", "mentions", "nodes", "aliases", "edges", "node_documents")
Tables = dict[str, DataFrame]


def _show(tables: Tables) -> None:
    for name, df in tables.items():
        print(f"== {name}")
        df.show(50, truncate=60)


def _land(spark: SparkSession, a: argparse.Namespace) -> Landscape:
    tables = records.restore(spark, a.graph, TABLES)
    if a.subfields:
        tables["subfields"] = spark.read.csv(a.subfields, header=True)
    if a.runs:
        tables["runs"] = records.run_history(spark, a.runs)
    return Landscape(tables, a.as_of)


def _corrections(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.corrections and corpus.exists(spark, a.corrections):
        return spark.read.schema(CORRECTIONS).json(corpus.current(spark, a.corrections))
    return spark.createDataFrame([], CORRECTIONS)


def _gazetteer(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.read.csv(a.gazetteer, header=True) if a.gazetteer else spark.createDataFrame([], "surface string, canonical string, type string")


def _saved(spark: SparkSession, a: argparse.Namespace, made: Landscape) -> Tables:
    records.snapshot({n: made.tables[n] for n in TABLES}, a.graph)
    return {"nodes": digest.leads(made.nodes, 0), "figures": quality.overview(made.documents, made.mentions, made.nodes, made.edges)}


def _rebuild(spark: SparkSession, a: argparse.Namespace) -> Tables:
    return _saved(spark, a, rebuild(corpus.load(spark, a.corpus), _gazetteer(spark, a), a.as_of, corrections=_corrections(spark, a)))


def _terms(a: argparse.Namespace) -> tuple[list[str], list[str]]:
    """(phrases, acronyms) among the words: an acronym is written in capitals."""
    return [w for w in a.words if not w.isupper()], [w for w in a.words if w.isupper()]


def _run(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """``run TERM ... --feeds FOLDER [--awards JSON] [--books FOLDER]``: ingest what was fetched, rebuild, write history."""
    phrases, acronyms = _terms(a)
    parts = []
    if a.feeds:
        parts.append(daily.feed_batch(spark, a.feeds))
    if a.awards:
        parts.append(daily.award_batch(spark, a.awards, phrases, acronyms))
    if a.books:
        parts.append(daily.budget_batch(spark, a.books, a.header, a.research, phrases))
    if not parts:
        raise ValueError("nothing to ingest: name feeds, awards or books")
    land, scorecard = daily.run(spark, a.corpus, corpus.union_sources(*parts), _gazetteer(spark, a), phrases, acronyms, a.as_of, a.runs, _corrections(spark, a))
    return {"scorecard": cut(scorecard), **_saved(spark, a, land)}


def _source(spark: SparkSession, a: argparse.Namespace, batch: DataFrame) -> Tables:
    phrases, acronyms = _terms(a)
    got = daily.ingest(batch, corpus.hashes(corpus.load(spark, a.corpus)), phrases, acronyms, a.as_of, most=1 << 30)
    corpus.append(got.new, a.corpus)
    return {"scorecard": got.scorecard}


def _sbir(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """``sbir TERM ... --awards JSON``: award records on topic into the corpus."""
    return _source(spark, a, daily.award_batch(spark, a.awards, *_terms(a)))


def _jbooks(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """``jbooks TERM ... --books FOLDER``: sections of budget books on topic into the corpus."""
    return _source(spark, a, daily.budget_batch(spark, a.books, a.header, a.research, _terms(a)[0]))


def _backfill(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """``backfill PAGES.json``: (content_hash, html) of documents fetched again; longer bodies replace short ones."""
    documents = corpus.load(spark, a.corpus)
    pages = spark.read.schema("content_hash STRING, html STRING").json(a.words[0]).select("content_hash", feeds.main_text(F.col("html")).alias("body"))
    short = documents.where(text.wants_body(F.col("raw_text"), F.col("url"))).select("content_hash")
    new = cut(curation.backfill(documents, pages.join(short, "content_hash", "left_semi")))
    changed = new.select("content_hash", F.length("raw_text").alias("now")).join(documents.select("content_hash", F.length("raw_text").alias("before")), "content_hash").where("now <> before")
    report = cut(changed)
    corpus.replace(new, a.corpus)
    return {"replaced": report}


def _demo(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """A graph from three built-in documents; nothing is written."""
    rows = [("d1", 1, "Acme Corp built Falcon Drone. Ann Bee leads Acme Corp."), ("d2", 2, "Acme Corp bought Beta Labs."), ("d3", 3, "Beta Labs supplies Falcon Drone parts.")]
    docs = spark.createDataFrame(rows, "content_hash string, doc_ord bigint, raw_text string").selectExpr("*", "'' AS title", "'2024-05-01' AS published", "'2024-05-01' AS fetched_at", "'demo' AS source")
    lexicon = spark.createDataFrame([("acme corp", "Acme Corp", "organization"), ("falcon drone", "Falcon Drone", "product"), ("beta labs", "Beta Labs", "organization"), ("ann bee", "Ann Bee", "person")], "surface string, canonical string, type string")
    nodes, edges = rebuild(docs, lexicon, "2024-05-02").graph(min_weight=1)
    return {"nodes": nodes, "edges": edges}


def _correct(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """``correct merge SURFACE CANONICAL`` or ``correct ignore SURFACE``."""
    action, surface, *rest = a.words
    land = Landscape({"nodes": spark.range(0), "corrections": _corrections(spark, a)}, a.as_of)
    new = land.correct(action, surface, rest[0] if rest else None)
    corpus.replace(new, a.corrections)
    return _resolved(spark, a) | {"corrections": _corrections(spark, a)}


def _resolved(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """The saved graph under the corrections of now, from the saved mentions; nothing if there is no graph yet."""
    if not corpus.exists(spark, f"{a.graph}/mentions"):
        return {}
    land = _land(spark, a).resolved(_corrections(spark, a), _gazetteer(spark, a).select("canonical").distinct() if a.gazetteer else None)
    made = {n: cut(land.tables[n]) for n in ("nodes", "aliases", "edges", "node_documents")}  # they are made from what they replace
    records.snapshot(made, a.graph)
    return {"nodes": digest.leads(made["nodes"], 0)}


def _correct_from_review(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Suggested merges and noise become corrections: those named by the words, or all of them with ``--yes``."""
    found = _review(spark, a)
    merges, noise = found["merges"], found["noise"]
    if not a.yes:
        named = [w.lower() for w in a.words]
        merges, noise = merges.where(F.lower("bare").isin(named)), noise.where(F.lower("canonical_name").isin(named))
    corpus.replace(cut(curation.upsert_corrections(_corrections(spark, a), curation.accepted(merges, noise))), a.corrections)
    return _resolved(spark, a) | {"corrections": _corrections(spark, a)}


def _serve(spark: SparkSession, a: argparse.Namespace) -> Tables:
    with server(_land(spark, a), a.port) as http:
        print(f"http://127.0.0.1:{http.server_port}/api/overview", flush=True)
        http.serve_forever()
    return {}


def _synthesize(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """``synthesize-daily [TEXT FILE] --daily FOLDER``: what a text of the day is to be made from; a finished text is filed under its date.

    A text that is there and not stale stays, unless ``--refresh`` is given.
    """
    land, schema = _land(spark, a), "date STRING, generated_at STRING, documents_used BIGINT, text STRING"
    old = stores.load_daily(spark, a.daily, schema)
    stale = records.latest_daily(old).select(dates.is_stale(F.col("generated_at"), F.lit(a.as_of)).alias("s")).first()
    inputs = {k: v for k, v in land.narrative_inputs().items() if k != "daily"}
    if a.words and (a.refresh or stale is None or stale["s"]):
        used = inputs["documents"].agg(F.count("*")).scalar()
        row = spark.read.text(a.words[0], wholetext=True).select(F.left(F.lit(a.as_of), F.lit(10)).alias("date"), F.lit(a.as_of).alias("generated_at"), used.alias("documents_used"), F.col("value").alias("text"))
        stores.save_daily(row, a.daily)
    return inputs | {"latest": records.latest_daily(stores.load_daily(spark, a.daily, schema))}


def _discover(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """``discover-feeds SEEDS.csv TEMPLATES.csv ANSWERS.json``: the first address of each seed that answered with a feed."""
    seeds, templates = (spark.read.csv(w, header=True, inferSchema=True) for w in a.words[:2])
    answers = spark.read.schema("url STRING, raw STRING").json(a.words[2])
    alive = answers.where(feeds.is_feed(F.col("raw"))).select("url")
    return {"found": feeds.discover(seeds, templates, alive), "health": feeds.health(answers.select(F.col("url").alias("source"), "url").distinct(), answers)}


def _snapshot(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """``snapshot FOLDER``: corpus and graph as Parquet under a folder."""
    tables = records.restore(spark, a.graph, TABLES) | {"corpus": corpus.load(spark, a.corpus)}
    records.snapshot(tables, a.words[0])
    return {"written": spark.createDataFrame([(n,) for n in tables], "name string")}


def _overview(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """All figures; ``--diff`` the last two runs only."""
    return {"diff": quality.run_diff(records.run_history(spark, a.runs))} if a.diff else _land(spark, a).overview()


def _audit(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Topic gate by the words given; ``--prune`` moves what it drops to the archive, ``--reinstate`` brings back what passes."""
    documents = corpus.load(spark, a.corpus)
    gate = text.is_relevant(F.concat_ws(" ", "title", "raw_text"), a.words) | curation.protected(F.col("metadata"))
    dropped = quality.drop_counts(documents, gate)
    if a.prune:
        kept, gone = curation.prune(documents, gate, a.as_of)
        corpus.append(gone, a.archive)
        corpus.replace(kept, a.corpus)
    if a.reinstate and corpus.exists(spark, a.archive):
        old = spark.read.schema(corpus.FIELDS + ", archived_at STRING, archived_reason STRING").json(corpus.current(spark, a.archive))
        active, archive = curation.reinstate(corpus.load(spark, a.corpus), old, gate)
        active, archive = cut(active), cut(archive)  # each is made from both tables
        corpus.replace(active, a.corpus)
        corpus.replace(archive, a.archive)
    return {"active": corpus.load(spark, a.corpus).agg(F.count("*").alias("documents"))} if a.prune or a.reinstate else {"dropped": dropped}


def _reading(spark: SparkSession, a: argparse.Namespace) -> Tables:
    documents = corpus.load(spark, a.corpus)
    if a.reset:
        corpus.replace(curation.invalidate_reading(documents), a.corpus)
        documents = corpus.load(spark, a.corpus)
    if a.words:
        corpus.replace(curation.mark_read(documents, spark.createDataFrame([(w,) for w in a.words], "content_hash string"), a.as_of), a.corpus)
        documents = corpus.load(spark, a.corpus)
    return {"reading": quality.reading(documents), "stale": quality.stale_reading(documents, a.limit)}


def _enrich(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """``enrich PLAN.json TERM ...``: append what is on topic and new."""
    plan, *terms = a.words
    plans = spark.read.schema("entity string, articles array<struct<url:string,title:string,source:string,published:string,html:string>>, synthesis struct<title:string,body:string,source:string>").json(plan)
    new = records.enrichment(plans, corpus.hashes(corpus.load(spark, a.corpus)), terms)
    rows = new.select("source", "url", "title", "published", F.lit(a.as_of).alias("fetched_at"), "content_hash", "raw_text", F.create_map(F.lit("synthetic"), F.col("synthetic")).alias("metadata"))
    corpus.append(rows, a.corpus)
    return {"documents": corpus.load(spark, a.corpus).groupBy("source").count()}


def _graph(spark: SparkSession, a: argparse.Namespace) -> Tables:
    nodes, edges = _land(spark, a).graph(focus=a.words[0] if a.words else None, max_nodes=a.limit, min_weight=a.min_weight)
    return {"nodes": records.html_graph(nodes).orderBy("rank"), "edges": edges}


def _reset(spark: SparkSession, a: argparse.Namespace) -> Tables:
    return {"deleted": spark.createDataFrame([(n,) for n in stores.reset(spark, a.graph, TABLES, a.yes)], "name string")}


def _review(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Suggestions; names of the gazetteer are trusted and known."""
    named = _gazetteer(spark, a).select(normalize(F.col("canonical")).alias("node_key")).distinct()
    return _land(spark, a).review(named, named)


VERBS: dict[str, Callable[[SparkSession, argparse.Namespace], Tables | DataFrame]] = {
    "run": _run, "rebuild": _rebuild, "sbir": _sbir, "jbooks": _jbooks, "backfill": _backfill, "demo": _demo, "snapshot": _snapshot, "serve": _serve, "synthesize-daily": _synthesize, "discover-feeds": _discover, "overview": _overview,
    "correct": _correct, "correct-from-review": _correct_from_review, "audit": _audit, "reading": _reading, "enrich": _enrich, "graph": _graph, "reset": _reset, "review": _review,
    "stats": lambda s, a: _land(s, a).nodes.orderBy(F.desc("mention_count"), "id").limit(a.limit),
    "visualize": _graph, "types": lambda s, a: _land(s, a).types(), "trends": lambda s, a: _land(s, a).trends(),
    "recent": lambda s, a: _land(s, a).recent(days=a.days), "spikes": lambda s, a: _land(s, a).spikes(a.limit), "trajectory": lambda s, a: _land(s, a).trajectory(),
    "pulse": lambda s, a: _land(s, a).pulse(a.days), "briefing": lambda s, a: _land(s, a).briefing(a.days, a.words[0] if a.words else None), "capabilities": lambda s, a: _land(s, a).capabilities(),
    "digest": lambda s, a: {**_land(s, a).briefing(a.days), "people": digest.leads(_land(s, a).nodes)}, "history": lambda s, a: _land(s, a).history(a.limit),
    "search": lambda s, a: _land(s, a).search(" ".join(a.words), a.limit), "path": lambda s, a: _land(s, a).path(*a.words[:2]), "node": lambda s, a: _land(s, a).node(int(a.words[0])), "adjacent": lambda s, a: _land(s, a).adjacent(int(a.words[0])),
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("graphloom")
    p.add_argument("verb", choices=sorted(VERBS))
    p.add_argument("words", nargs="*")
    p.add_argument("--corpus", default="corpus.jsonl")
    p.add_argument("--archive", default="archive.jsonl")
    p.add_argument("--gazetteer", help="CSV of surface, canonical, type")
    p.add_argument("--subfields", help="CSV of subfield, concept")
    p.add_argument("--corrections", default="corrections.jsonl")
    p.add_argument("--runs", help="run history, JSON lines")
    p.add_argument("--graph", default="graph", help="folder of graph tables")
    p.add_argument("--as-of", default="1970-01-01")
    p.add_argument("--days", type=int, default=7)
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--min-weight", type=int, default=2)
    p.add_argument("--feeds", help="folder of feed documents, one a file")
    p.add_argument("--awards", help="award records, JSON")
    p.add_argument("--books", help="folder of text extracted from budget books")
    p.add_argument("--header", default=r"(?m)^PE \d+[A-Z]*:? .*$", help="pattern of a section's header line")
    p.add_argument("--research", default="RDT&E", help="pattern that research books hold")
    p.add_argument("--daily", default="daily", help="folder of daily texts")
    p.add_argument("--port", type=int, default=8000)
    for flag in ("--prune", "--reinstate", "--reset", "--yes", "--refresh", "--diff"):
        p.add_argument(flag, action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made = VERBS[a.verb](spark, a)
    _show(made if isinstance(made, dict) else {a.verb: made})


if __name__ == "__main__":
    main()

"""A graph kept up to date: changed documents and corrections alter only the keys that they touch.

The state is a folder of Parquet tables, each with a folder a run.  A run writes
what it changes and nothing else:

* documents: the mentions and keys of the documents that it takes or keys anew
  (``named``, ``keyed``; ``taken`` and ``rekeyed`` list the documents, so that
  older rows of theirs no longer count);
* counts: differences of document frequencies and co-occurrence weights
  (``frequency``, ``pairs``), which readers sum;
* nodes: new roll-ups of the touched keys (``first`` before coreference merges,
  ``nodes`` after them) and the merges that changed; a key's last run counts;
* ``marks``: one row, written last.  Readers stop at the last mark, and a run
  that died before its mark is written again under the same number.

A correction touches the documents that hold its surfaces; a new document also
those of surfaces that become frequent enough, or whose merge changes.  All
results equal those of :func:`graphloom.operators.resolve.graph` on everything.
:func:`compacted` writes the sum of all runs as the first run of a new folder.
One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import resolve
from graphloom.session import cut

_NODE = "node_key string, canonical_name string, type string, first_seen date, last_seen date, mention_count bigint, document_count bigint, email string"
TABLES = {
    "named": "content_hash string, doc_ord bigint, mention_ord int, text string, label string, alias string, doc_date date",
    "taken": "content_hash string",
    "frequency": "alias string, df bigint",
    "corrected": "alias string, merged string, ignored boolean",
    "keyed": "content_hash string, doc_ord bigint, mention_ord int, alias string, canonical string, node_key string, label string, email string, doc_date date",
    "rekeyed": "content_hash string",
    "first": _NODE,
    "merges": "src string, dst string",
    "pairs": "a string, b string, weight bigint",
    "nodes": _NODE,
    "marks": "high bigint, documents bigint",
}


def _read(spark: SparkSession, path: str, table: str, upto: int) -> DataFrame:
    return spark.read.schema(f"{TABLES[table]}, run int").parquet(f"{path}/{table}").where(F.col("run") <= upto)


def _write(df: DataFrame, path: str, table: str, run: int) -> DataFrame:
    """Replace the table's folder of this run; returns its rows."""
    fields = [x.split(" ") for x in TABLES[table].split(", ")]
    df.select(*[F.col(c).cast(t).alias(c) for c, t in fields]).write.mode("overwrite").parquet(f"{path}/{table}/run={run}")
    return df.sparkSession.read.schema(TABLES[table]).parquet(f"{path}/{table}/run={run}")


def create(spark: SparkSession, path: str) -> None:
    """Make the tables readable; a folder that has them stays as it is."""
    for table, schema in TABLES.items():
        spark.createDataFrame([], f"{schema}, run int").write.mode("ignore").partitionBy("run").parquet(f"{path}/{table}")


def last_run(spark: SparkSession, path: str) -> tuple[int, int | None]:
    """(number, high-water mark) of the last finished run; (0, None) before the first."""
    row = _read(spark, path, "marks", 1 << 30).agg(F.max("run"), F.max("high")).first()
    return row[0] or 0, row[1]


def _current(spark: SparkSession, path: str, table: str, listed: str, upto: int, before: int | None = None) -> DataFrame:
    """Rows of documents as their last run left them; of runs before ``before`` only, if given.

    Only documents that several runs list take part in the join.  They are written
    first, so that where they are few the rows stay where they are.
    """
    runs = cut(_read(spark, path, listed, upto).groupBy("content_hash").agg(F.max("run").alias("__last"), F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    return _read(spark, path, table, upto if before is None else before - 1).join(runs, "content_hash", "left").where("__last is null or run = __last").drop("__last", "run")


def _latest(spark: SparkSession, path: str, table: str, key: str, upto: int) -> DataFrame:
    """Rows of keys as their last run left them."""
    rows = _read(spark, path, table, upto)
    rest = [c for c in rows.columns if c not in (key, "run")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "run").alias("r")).select(key, "r.*")


def merges(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(src, dst) in force."""
    return _latest(spark, path, "merges", "src", last_run(spark, path)[0] if upto is None else upto).where("dst is not null")


def rollups(spark: SparkSession, path: str) -> DataFrame:
    """Roll-ups of all keys that have mentions."""
    return _latest(spark, path, "nodes", "node_key", last_run(spark, path)[0]).where("mention_count > 0")


def nodes(spark: SparkSession, path: str, trusted: DataFrame | None = None) -> DataFrame:
    """The graph's nodes: roll-ups without weak single words."""
    return resolve.prune_weak(rollups(spark, path), trusted)


def edges(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(a, b, weight, strength) of co-occurrence between nodes of ``known`` (:func:`nodes` or :func:`rollups`)."""
    now = _read(spark, path, "pairs", last_run(spark, path)[0]).groupBy("a", "b").agg(F.sum("weight").alias("weight")).where("weight <> 0")
    return resolve.with_strength(now, known)


def keyed(spark: SparkSession, path: str) -> DataFrame:
    """Keyed mentions after merges, as :func:`graphloom.operators.resolve.apply_merges` has them."""
    run = last_run(spark, path)[0]
    return resolve.apply_merges(_current(spark, path, "keyed", "rekeyed", run), merges(spark, path, run))


def update(spark: SparkSession, path: str, mentions: DataFrame | None = None, changed: DataFrame | None = None, corrections: DataFrame | None = None, trusted: DataFrame | None = None, most: int = resolve.MAX_ENTITIES, high: int | None = None) -> int:
    """Take changed documents and the corrections in force into the state; returns the run's number.

    mentions: (content_hash, doc_ord, mention_ord, text, label, doc_date) of the
    documents that ``changed`` (content_hash) lists, all of them anew; a listed
    document without mentions is one that holds none any more.
    """
    create(spark, path)
    before = last_run(spark, path)[0]
    run = before + 1
    old = _current(spark, path, "named", "taken", before)
    none = spark.createDataFrame([], TABLES["taken"])
    taken = _write(none if changed is None else changed.select("content_hash").distinct(), path, "taken", run)
    alias = T.normalize(T.entity_name(F.col("text")))
    named = _write((mentions if mentions is not None else spark.createDataFrame([], TABLES["named"])).withColumn("alias", alias), path, "named", run)
    # Document frequencies: what the changed documents add, less what they had.
    had = old.join(taken, "content_hash", "left_semi").select("content_hash", "alias").distinct()
    moved = _write(had.select("alias", F.lit(-1).alias("n")).unionByName(named.select("content_hash", "alias").distinct().select("alias", F.lit(1).alias("n"))).groupBy("alias").agg(F.sum("n").alias("df")).where("alias <> '' and df <> 0"), path, "frequency", run)
    total = _read(spark, path, "frequency", run).groupBy("alias").agg(F.sum("df").alias("df"))
    known = total.join(moved.select("alias", F.col("df").alias("__by")), "alias")
    crossed = known.where((F.col("df") >= resolve.MIN_DOCUMENTS) != (F.col("df") - F.col("__by") >= resolve.MIN_DOCUMENTS)).select("alias")
    # Corrections: aliases that are merged elsewhere, or ignored, unlike before.
    now = _write(_judged(spark, corrections), path, "corrected", run)
    then = _read(spark, path, "corrected", before).where(F.col("run") == before).drop("run")
    differ = now.exceptAll(then).unionByName(then.exceptAll(now)).select("alias")
    touched = cut(crossed.unionByName(differ).distinct())
    every = _current(spark, path, "named", "taken", run)
    again = every.join(touched, "alias", "left_semi").select("content_hash").unionByName(taken).distinct()
    rows = every.join(_write(again, path, "rekeyed", run), "content_hash", "left_semi")
    frequency = total.join(rows.select("alias").distinct(), "alias", "left_semi")
    return refresh(spark, path, resolve.keyed_mentions(rows, corrections, trusted, frequency=frequency), run, most=most, high=high)


def _judged(spark: SparkSession, corrections: DataFrame | None) -> DataFrame:
    if corrections is None:
        return spark.createDataFrame([], TABLES["corrected"])
    ignored = corrections.where("kind = 'ignore'").select(T.normalize(F.col("surface")).alias("alias"), F.lit(True).alias("ignored")).distinct()
    return resolve.merge_map(corrections).join(ignored, "alias", "full")


def take(spark: SparkSession, path: str, new_rows: DataFrame, documents: DataFrame, most: int = resolve.MAX_ENTITIES, high: int | None = None) -> int:
    """Take documents (content_hash) whose mentions are keyed already, by rules that no other document bears on; returns the run's number."""
    create(spark, path)
    run = last_run(spark, path)[0] + 1
    _write(documents.select("content_hash").distinct(), path, "rekeyed", run)
    return refresh(spark, path, new_rows, run, coreference=False, most=most, high=high)


def refresh(spark: SparkSession, path: str, new_rows: DataFrame, run: int, coreference: bool = True, most: int = resolve.MAX_ENTITIES, high: int | None = None) -> int:
    """Counts, merges and roll-ups after the documents listed in this run's ``rekeyed`` have new keyed mentions (``new_rows``, of these alone); ends with the mark."""
    before = run - 1
    docs = spark.read.schema(TABLES["rekeyed"]).parquet(f"{path}/rekeyed/run={run}")
    old = _current(spark, path, "keyed", "rekeyed", before)
    fresh = _write(new_rows, path, "keyed", run)
    every = _current(spark, path, "keyed", "rekeyed", run)
    # Of the listed documents, those that had rows before: few or none, if runs bring new documents.
    known = cut(docs.join(_read(spark, path, "rekeyed", before), "content_hash", "left_semi"))
    keys = cut(old.join(known, "content_hash", "left_semi").select("node_key").unionByName(fresh.select("node_key")).distinct())
    first = _write(_rolled(every.join(keys, "node_key", "left_semi"), keys), path, "first", run)
    old_merges = cut(merges(spark, path, before))
    if coreference:
        alive = cut(_latest(spark, path, "first", "node_key", run).where("mention_count > 0"))
        now = resolve.closed(cut(resolve.unique_partial_names(alive).unionByName(resolve.shared_email(alive))))
    else:
        now = old_merges
    both = now.select("src", F.col("dst").alias("new")).join(old_merges.select("src", F.col("dst").alias("old")), "src", "full")
    _write(both.where("not (new <=> old)").select("src", F.col("new").alias("dst")), path, "merges", run)
    new_merges = cut(merges(spark, path, run))
    turned = spark.read.schema(TABLES["merges"]).parquet(f"{path}/merges/run={run}").select(F.col("src").alias("node_key"))
    # Pairs of the documents whose keys, or whose keys' merges, changed.  The listed ones have their rows in this run.
    about = cut(every.join(turned, "node_key", "left_semi").select("content_hash").unionByName(old.join(turned, "node_key", "left_semi").select("content_hash")).distinct())
    others = _current(spark, path, "keyed", "rekeyed", run, before=run).join(about, "content_hash", "left_semi")
    a = resolve.cooccurrence(resolve.apply_merges(old.join(known.unionByName(about).distinct(), "content_hash", "left_semi"), old_merges), most)
    b = resolve.cooccurrence(resolve.apply_merges(fresh.unionByName(others), new_merges), most)
    _write(a.withColumn("weight", -F.col("weight")).unionByName(b).groupBy("a", "b").agg(F.sum("weight").alias("weight")).where("weight <> 0"), path, "pairs", run)
    # Nodes that lost or won rows: touched keys and their targets, before and after.
    touched = keys.unionByName(turned).distinct()
    targets = cut(resolve.apply_merges(touched, old_merges).unionByName(resolve.apply_merges(touched, new_merges)).unionByName(touched).distinct())
    # Keys that no merge concerns are as they were rolled up first.
    mixed = cut(targets.join(old_merges.unionByName(new_merges).select(F.explode(F.array("src", "dst")).alias("node_key")).distinct(), "node_key", "left_semi"))
    latest = _latest(spark, path, "first", "node_key", run).join(targets, "node_key", "left_semi")
    # Rows of one of the others; those that are merged into a node not asked for go.
    sources = cut(new_merges.join(mixed.select(F.col("node_key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node_key")).unionByName(mixed).distinct())
    rows = resolve.apply_merges(every.join(sources, "node_key", "left_semi"), new_merges).join(mixed, "node_key", "left_semi")
    own = latest.select("node_key", F.col("canonical_name").alias("__name"), F.col("type").alias("__type"))
    rolled = _rolled(rows, mixed).join(own, "node_key", "left").withColumns({"canonical_name": F.col("__name"), "type": F.col("__type")}).drop("__name", "__type")
    _write(rolled.unionByName(latest.join(mixed, "node_key", "left_anti")), path, "nodes", run)
    _write(docs.agg(F.lit(high).cast("bigint").alias("high"), F.count("*").alias("documents")), path, "marks", run)
    return run


def _rolled(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Roll-ups of ``keys``; one without rows has no mentions."""
    return keys.join(resolve.node_rollup(rows), "node_key", "left").fillna(0, ["mention_count", "document_count"])


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """The state of all runs as the first run of the folder ``to``."""
    run, high = last_run(spark, path)
    create(spark, to)
    for table, listed in (("named", "taken"), ("keyed", "rekeyed")):
        _write(_current(spark, path, table, listed, run), to, table, 1)
        _write(_read(spark, path, listed, run).select("content_hash").distinct(), to, listed, 1)
    for table, by in (("frequency", ["alias"]), ("pairs", ["a", "b"])):
        value = "df" if table == "frequency" else "weight"
        _write(_read(spark, path, table, run).groupBy(*by).agg(F.sum(value).alias(value)).where(f"{value} <> 0"), to, table, 1)
    for table, key in (("first", "node_key"), ("merges", "src"), ("nodes", "node_key")):
        _write(_latest(spark, path, table, key, run), to, table, 1)
    _write(_read(spark, path, "corrected", run).where(F.col("run") == run), to, "corrected", 1)
    _write(_read(spark, path, "rekeyed", run).agg(F.lit(high).cast("bigint").alias("high"), F.count_distinct("content_hash").alias("documents")), to, "marks", 1)

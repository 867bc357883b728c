"""The document corpus: JSON lines in, gated and de-duplicated appends, overwrites by version.

A corpus is a path of JSON lines (a file or a folder).  Overwriting it writes a
new version beside it, under ``PATH.versions``, and then commits it by creating
one small file of the next number in ``PATH.versions/log``; readers take the
version with the greatest number, so there is no moment without a corpus, and a
writer that dies before its commit changes nothing.  One writer at a time.

Each row holds its place in the order of ingestion (``doc_ord``), given when it
is appended, since files are not read back in the order they were written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.schemas import DOCUMENTS

FIELDS = "doc_ord BIGINT, source STRING, url STRING, title STRING, published STRING, fetched_at STRING, content_hash STRING, raw_text STRING, metadata MAP<STRING,STRING>, read_count BIGINT, read_fresh BOOLEAN, last_read STRING"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """There are rows: at the path itself, or in a version of it."""
    fs, p = _fs(spark, path)
    return fs.exists(p) or bool(_committed(spark, path))


def _committed(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version's folder) of every commit, in order."""
    fs, log = _fs(spark, f"{path}.versions/log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName().split(".", 1) for s in fs.listStatus(log)]
    return sorted((int(n), f"{path}.versions/{name}") for n, name in names)


def current(spark: SparkSession, path: str) -> str:
    """Where the rows lie: the last committed version, or the path itself."""
    done = _committed(spark, path)
    return done[-1][1] if done else path


def with_defaults(df: DataFrame) -> DataFrame:
    """The fixed fields; strings default to empty, counters to 0, flags to false."""
    zero = {"string": F.lit(""), "bigint": F.lit(0).cast("long"), "boolean": F.lit(False), "map<string,string>": F.create_map().cast("map<string,string>")}
    return df.select(*[(F.coalesce(c, zero[t]) if c not in ("last_read", "doc_ord") else F.col(c)).alias(c) for c, t in df.dtypes])


def load(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """JSON lines with their order of ingestion (``doc_ord``); a missing path is an empty corpus, blank lines are skipped.

    Rows that were not written by :func:`append` come first, in the order of
    files and lines.
    """
    at = current(spark, path)
    if not exists(spark, at):
        return spark.createDataFrame([], DOCUMENTS)
    rows = with_defaults(spark.read.schema(FIELDS).json(at))
    return rows.withColumn("doc_ord", F.coalesce("doc_ord", F.monotonically_increasing_id() - (1 << 53))) if ordered else rows.drop("doc_ord")


def first_of_each(documents: DataFrame, order: str = "doc_ord") -> DataFrame:
    """One row of each content hash: the first ingested."""
    return documents.withColumn("__r", F.row_number().over(Window.partitionBy("content_hash").orderBy(order))).where("__r = 1").drop("__r")


def hashes(documents: DataFrame) -> DataFrame:
    return documents.select("content_hash").distinct()


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))), 256)


def new_documents(batch: DataFrame, known: DataFrame, order: str = "doc_ord") -> DataFrame:
    """First row of each hash in the batch that the corpus doesn't hold yet.

    Only (hash, order) is ranked; the limit of one row a hash works map-side too.
    """
    return first_of_each(batch, order).join(known.select("content_hash"), "content_hash", "left_anti")


def cap(batch: DataFrame, most: int = 50, by: str = "source", order: str = "feed_pos") -> DataFrame:
    """At most ``most`` rows a source in arrival order: the per-run cap of a source."""
    return batch.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__r") <= most).drop("__r")


def append(df: DataFrame, path: str) -> None:
    """Add rows behind those that are there, in the order of ``doc_ord`` where they have one."""
    from graphloom.operators.resolve import number

    spark = df.sparkSession
    at = current(spark, path)
    last = spark.read.schema("doc_ord BIGINT").json(at).agg(F.max("doc_ord")).first()[0] if exists(spark, at) else None
    order = df if "doc_ord" in df.columns else df.withColumn("doc_ord", F.monotonically_increasing_id())
    placed = number(order.withColumnRenamed("doc_ord", "__ord"), "__ord", "content_hash", name="doc_ord").drop("__ord")
    placed.withColumn("doc_ord", F.col("doc_ord") + (last or 0)).write.mode("append").json(at)


def replace(df: DataFrame, path: str) -> None:
    """Write the next version and commit it; df may read ``path``.

    The version before stays for readers that planned on it and goes with the
    next replacement; a corpus that was not in versions yet is deleted.
    """
    spark = df.sparkSession
    done, name = _committed(spark, path), f"data-{uuid.uuid4().hex}"
    df.write.json(f"{path}.versions/{name}")
    fs, commit = _fs(spark, f"{path}.versions/log/{(done[-1][0] if done else 0) + 1:08d}.{name}")
    fs.create(commit, False).close()
    for old in [at for _, at in done[:-1]] if done else [path]:
        fs.delete(_fs(spark, old)[1], True)


def union_sources(*batches: DataFrame) -> DataFrame:
    """Feeds, awards and budget books as one batch; missing columns are null."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out

"""Incremental graph: orders beyond the high-water mark are added to a stored co-occurrence graph.

An order is a document and the names of its parts are its entities.  The state
holds differences by run, each in a folder of its own, and one mark a run with
the greatest order key taken; orders up to it are not read again, and a run that
died before its mark is made again under its number.  Keys of orders ascend, and
an order comes together with its lines.

    python -m jobs.update_graph --orders PATH --lineitem PATH --part PATH --output DIR [--config FILE]
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import incremental
from jobs.common import command_line, log


def keyed_lines(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Keyed mentions of the orders: one a line, its part's name the key."""
    dated = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("doc_date"))
    lines = lineitem.select("l_orderkey", "l_partkey", "l_linenumber").join(dated, "l_orderkey").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").where("p_name is not null")
    name = F.col("p_name")
    return lines.select(F.col("l_orderkey").cast("string").alias("content_hash"), F.col("l_orderkey").alias("doc_ord"), F.col("l_linenumber").alias("mention_ord"), name.alias("alias"), name.alias("canonical"), name.alias("node_key"), F.lit("product").alias("label"), F.lit(None).cast("string").alias("email"), "doc_date")


def run(spark: SparkSession, orders: str, lineitem: str, part: str, output: str, config: dict[str, Any]) -> DataFrame:
    """Add the orders beyond the mark of OUTPUT to its graph; returns the edges (a, b, weight, strength) as they stand."""
    incremental.create(spark, output)
    _, high = incremental.last_run(spark, output)
    beyond = lambda path, key: spark.read.parquet(path).where(F.lit(True) if high is None else F.col(key) > high)
    new = beyond(orders, "o_orderkey").select("o_orderkey", "o_orderdate").where("o_orderkey is not null")
    count, top = new.agg(F.count("*"), F.max("o_orderkey")).first()
    if count:
        docs = new.where(F.col("o_orderkey") <= top).select(F.col("o_orderkey").cast("string").alias("content_hash"))
        rows = keyed_lines(new.where(F.col("o_orderkey") <= top), beyond(lineitem, "l_orderkey"), spark.read.parquet(part))
        run_number = incremental.take(spark, output, rows, docs, most=config["most_entities"], high=top)
        log.info("run %d: read %d orders of %s beyond %s; wrote their differences to %s, mark %s", run_number, count, orders, high, output, top)
    else:
        log.info("nothing beyond %s in %s", high, orders)
    return incremental.edges(spark, output, incremental.rollups(spark, output))


if __name__ == "__main__":
    command_line("update-graph", __file__, {"orders": "Parquet of orders", "lineitem": "Parquet of their lines", "part": "Parquet of parts", "output": "folder of the state"}, run)

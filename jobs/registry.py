"""The jobs as queries: each runs twice into one new folder and returns the whole output, with SQL for it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.session import shared_dir
from jobs import ingest_documents, update_graph
from jobs.common import default_config


def _twice(spark: SparkSession, name: str, run: Callable[[str], DataFrame]) -> DataFrame:
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run(root)
    return run(root)


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = default_config(ingest_documents.__file__)
    return _twice(spark, "job1", lambda root: ingest_documents.run(spark, f"{sf_dir}/documents.parquet*", f"{root}/out", f"{root}/checkpoint", config))


def job2_update_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = default_config(update_graph.__file__)
    return _twice(spark, "job2", lambda root: update_graph.run(spark, f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet", root, config))


_CONFIG = default_config(ingest_documents.__file__)
_PHRASE = r"regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}_])(?:{p})(?:$|[^\p{{L}}\p{{N}}_])')"
_ACRONYM = _PHRASE.replace("lower(text)", "text")
_TERMS = [(p, _PHRASE.format(p=p)) for p in _CONFIG["phrases"]] + [(a, _ACRONYM.format(p=a)) for a in _CONFIG["acronyms"]]

JOB1 = f"""
WITH d AS (SELECT *, sha256(text) AS content_hash FROM documents WHERE {" OR ".join(c for _, c in _TERMS)}),
first AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id, source, lang) = 1)
SELECT doc_id, content_hash, source, lang, n_chars, array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in _TERMS)}], lambda x: x IS NOT NULL)), ',') AS terms,
       text, CAST(0 AS BIGINT) AS batch, coalesce(nullif(source, ''), 'unknown') AS feed FROM first
"""

JOB2 = """
WITH m AS (SELECT DISTINCT l_orderkey AS d, p_name AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
n AS (SELECT k, count(*) AS n FROM m GROUP BY k),
ok AS (SELECT d FROM m GROUP BY d HAVING count(*) BETWEEN 2 AND 60),
co AS (SELECT x.k AS a, y.k AS b, count(*) AS weight FROM m x JOIN m y ON x.d = y.d AND x.k < y.k WHERE x.d IN (SELECT d FROM ok) GROUP BY 1, 2)
SELECT a, b, weight, round_even(weight / (na.n + nb.n - weight), 4) AS strength FROM co JOIN n na ON na.k = a JOIN n nb ON nb.k = b
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_ingest_documents": job1_ingest_documents, "job2_update_graph": job2_update_graph}
ORACLE: dict[str, str] = {"job1_ingest_documents": JOB1, "job2_update_graph": JOB2}

"""Contract queries that SQL can express, against that SQL."""

import glob
import os

import duckdb
import pytest

from graphloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = registry.queries()[name](spark, sf)
    names = sorted(df.columns)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    want = sorted(str([r[rel.columns.index(c)] for c in names]) for r in rel.fetchall())
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == want


def test_all_eleven_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))

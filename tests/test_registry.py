"""Every registered query of the graph engine against its SQL."""

import glob
import math
import os

import duckdb
import pytest

import graphloom.plans.more  # noqa: F401
from graphloom.plans import registry
from jobs import registry as jobs

ORACLE, QUERIES = registry.ORACLE | jobs.ORACLE, registry.QUERIES | jobs.QUERIES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0

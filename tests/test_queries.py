"""Registered queries against DuckDB on the same tables."""

import functools
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lurewatch.plans import PLANS, campaigns, graph

OWN = sorted(name for plan in PLANS for name in plan.SQL)


@pytest.fixture(scope="module", autouse=True)
def shared_inputs():
    """Mails, graph, campaigns and their edges are computed once for all queries that begin with them."""
    patch = pytest.MonkeyPatch()
    for module, name in ((campaigns, "_rows"), (campaigns, "_both"), (graph, "_graph"), (graph, "_full")):
        patch.setattr(module, name, functools.cache(getattr(module, name)))
    yield
    patch.undo()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def compare(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame, sql = entry.queries()[name](spark, data), con.sql(entry.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(sql.columns)
    ours = sorted(str([plain(r[c]) for c in columns]) for r in frame.collect())
    theirs = sorted(str([plain(r[sql.columns.index(c)]) for c in columns]) for r in sql.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", OWN)
def test_query(spark, data, name):
    compare(spark, data, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["j29_neighbourhood_20", "j29_neighbourhood_edges_20"])
def test_whole_search_set(spark, data, name):
    """Every email whose id is divisible by 20 is a centre; neighbourhoods and edges agree with the SQL."""
    compare(spark, data, name)
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id % 20 = 0")
    assert {r.centre for r in entry.queries()[name](spark, data).select("centre").distinct().collect()} == {f"Email:email-{r.doc_id}" for r in docs.collect()}


def test_stored_graph_grows_with_the_table(spark, data):
    got = {r.label: r for r in entry.queries()["j5_ingest_counts_half"](spark, data).collect()}
    ids = [r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()]
    old = sum(i <= (min(ids) + max(ids)) // 2 for i in ids)
    assert (got["Email"].matched, got["Email"].created) == (old, len(ids) - old) and 0 < old < len(ids)

"""Every named query against its DuckDB oracle on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, norm
from tributary.plans.registry import all_queries

SF = os.environ.get("TRIBUTARY_TEST_SF", "/root/testdata/sf0.001")
# SQL has no form for the order of ring corners: brute force in test_rings.py.
BY_BRUTE_FORCE = {"q_dissolve_rings"}
# The training-data queries have tests of their own in tests/llm.
QUERIES = {k: f for k, f in entry.queries().items() if k in all_queries()}
ORACLES = {k: q for k, q in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) - BY_BRUTE_FORCE == set(ORACLES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["dayofyear", "streamflow"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - BY_BRUTE_FORCE))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert norm(got) == norm(want)

"""Each registered query against its SQL, and what the contract asks of the entry module."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from webloom.plans.oracle import ORACLE_SQL
from webloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return Counter(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    assert got
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["urls_canonical"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[-1]

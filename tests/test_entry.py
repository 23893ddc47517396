"""Each registered query of the core against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from eventmirror.plans.oracle import SQL
from eventmirror.plans.queries import QUERIES

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("events", "orders", "lineitem", "customer", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, TABLES)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

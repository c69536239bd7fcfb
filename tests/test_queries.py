"""Every engine query runs on the smallest tables and matches its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillstream.plans import oracle
from quillstream.plans import queries as plans

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert rows
    sql = oracle.oracle_sql().get(name)
    if sql:
        found = duck.sql(sql)
        assert sorted(found.columns) == columns
        want = [tuple(dict(zip(found.columns, r))[c] for c in columns) for r in found.fetchall()]
        assert _sorted(rows) == _sorted(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

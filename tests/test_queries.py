"""Every registered query against its DuckDB text on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted([str([norm(r[i]) for i in order]) for r in data])


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert rows(df.columns, got) == rows(cols, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 20


def test_names():
    assert set(SQL) <= set(queries())

"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def tidy(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    relation = duck.sql(sql)
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    expected = sorted((tuple(tidy(r[i]) for i in places) for r in relation.fetchall()), key=str)
    assert got == expected

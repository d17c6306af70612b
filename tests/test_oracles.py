"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, list):
        return tuple(map(plain, v))
    return 0.0 if isinstance(v, float) and v == 0 else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith("op") and n != "pipeline"])
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF_DIR)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(list(want.columns), want.fetchall())


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n not in SQL and not n.startswith("op") and n != "pipeline"])
def test_query_without_sql_gives_rows(spark, name):
    assert __spark_entry__.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry_point.oracle_sql()


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    if not glob.glob(f"{DATA}/*.parquet"):
        pytest.skip("no test data")
    df = entry_point.queries()[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _plain([tuple(r) for r in df.collect()], df.columns) == _plain(want.fetchall(), want.columns)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry_point.queries())

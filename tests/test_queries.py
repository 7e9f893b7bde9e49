"""Every query that has SQL, beside it, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    ours = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    sql = con.sql(entry.oracle_sql()[name])
    order = sorted(range(len(sql.columns)), key=lambda k: sql.columns[k])
    assert sorted(df.columns) == sorted(sql.columns)
    assert ours == sorted(repr(tuple(r[k] for k in order)) for r in sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["product_id", "path", "pos"]

"""Every query with SQL gives DuckDB's rows."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from millrace.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return repr(v) if isinstance(v, float) else format(v, "f") if isinstance(v, decimal.Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in cursor.fetchall())


def test_entry_gives_the_flagship_rows(spark):
    assert entry_points.entry(spark).count() == 79


def test_every_query_has_a_name_of_its_own():
    assert set(catalog.ORACLE_SQL) <= set(entry_points.queries())

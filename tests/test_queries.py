"""Every registered query that has a statement gives the same rows in both engines."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canon

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = canon(df.collect(), df.columns)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == canon(cur.fetchall(), names)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

"""Every query that has a statement, beside DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import registry
from verify import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_like_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([x[0] for x in cursor.description], cursor.fetchall())


def test_registry():
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

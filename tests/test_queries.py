"""Every query of the catalogue against DuckDB, and the entry points."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans.registry import QUERIES, SQL, TABLES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    sql = SQL[name]
    assert columns == sorted(duck.sql(sql).columns)
    assert plain(df.select(*columns).collect()) == plain(duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) == set(QUERIES)

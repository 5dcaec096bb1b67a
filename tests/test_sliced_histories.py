"""Histories that are cut into slices: queries against DuckDB, and keys and times of any kind."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import versions as V
from palimpsest.plans.registry import QUERIES, SQL
from tests.test_queries import SF, plain

QUERIES_OF_A_HISTORY = [
    "delete_tombstone_filter",
    "dml_outcomes",
    "ext_snapshot_join_aggregate",
    "insert_unique_rows",
    "own_writes_visible",
    "snapshot_delta_merge",
    "snapshot_read_asof",
    "snapshot_row_status",
    "tid_for_modify",
    "unique_key_free",
    "write_conflicts",
]


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", QUERIES_OF_A_HISTORY)
def test_sliced_query_matches_sql(spark, monkeypatch, name):
    monkeypatch.setitem(V.accepted.__kwdefaults__, "rows_a_slice", 150)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
        df = QUERIES[name](spark, str(SF))
        columns = sorted(df.columns)
        want = plain(con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())
    assert plain(df.select(*columns).collect()) == want


TIMES = {
    "timestamp_ntz": lambda i: datetime(2024, 3, 31) + timedelta(minutes=7 * i),
    "timestamp": lambda i: datetime(2024, 3, 31) + timedelta(minutes=7 * i),
    "date": lambda i: date(2024, 1, 1) + timedelta(days=i),
    "bigint": lambda i: (1 << 60) + i,
    "double": lambda i: i / 3,
    "decimal(20,2)": lambda i: Decimal(i),
}


@pytest.mark.parametrize("kind", TIMES)
@pytest.mark.parametrize("how", ["last", "max"])
def test_slices_of_any_time_and_null_keys(spark, kind, how):
    data = [(i, None if i % 3 == 0 else i % 2, TIMES[kind](i // 2), i * 7 % 11 if i % 4 == 0 else None) for i in range(120)]
    want, state = {}, {}
    for i, k, _, v in data:
        want[i] = state.get(k)
        if v is not None:
            state[k] = v if how == "last" else max(v, state.get(k, v))
    df = spark.createDataFrame(data, f"i int, k int, ts {kind}, v int")
    for size in (1000, 20):
        got = V.earlier(df, "k", ["ts", "i"], F.col("v"), how, "before", size)
        assert {r.i: r.before for r in got.collect()} == want


def test_a_history_without_times_is_one_slice(spark):
    df = spark.createDataFrame([(i, 1, None, i) for i in range(10)], "i int, k int, ts timestamp_ntz, v int")
    got = V.earlier(df, "k", ["ts", "i"], F.col("v"), "last", "before", 3)
    assert {r.i: r.before for r in got.collect()} == {i: i - 1 if i else None for i in range(10)}

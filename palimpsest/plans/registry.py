"""Where the named queries register, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with DuckDB SQL for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: dict[tuple, object] = {}


def once(make):
    """A function of (spark, sf_dir) whose outcome one application makes once and keeps."""

    def made(spark: SparkSession, sf_dir: str):
        key = (make.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _made:
            _made[key] = make(spark, sf_dir)
        return _made[key]

    return made

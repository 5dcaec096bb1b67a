"""Extension: the version log as a stream, and windows over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.table import VersionedTable


def tail(table: VersionedTable, max_files: int = 64) -> DataFrame:
    """Log rows of a table as its transactions publish them, a bounded number of files at a time.

    Files of a transaction are moved in just before its commit marker; a consumer that must not
    see a crashed commit's rows joins them with ``Engine.commits`` in ``foreachBatch``.
    """
    return table.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files).parquet(table.log_path())


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling-window counts by kind; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")

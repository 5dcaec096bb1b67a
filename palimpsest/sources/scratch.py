"""Where tables that cut lineage go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of a session on one machine that names none; executors elsewhere could not see it.
LOCAL = "/tmp/checkpoints/palimpsest"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Without one, a session on one machine
    has a local folder, and a cluster's raises: what executors write locally is lost."""
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir"):
        return root.rstrip("/")
    master = conf.get("spark.master") or ""
    if master.startswith("local") and not master.startswith("local-cluster"):
        return LOCAL
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under ``scratch_root``."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession):
    """A function that writes a table there and reads it back."""

    def write(df: DataFrame) -> DataFrame:
        path = scratch_folder(spark, "table")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write

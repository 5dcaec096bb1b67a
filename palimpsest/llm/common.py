"""What the operators of this subpackage share: scratch tables, null-safe inputs, components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.scratch import scratch_folder

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lower-cases A-Z and nothing else, for ``str.translate``.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


class Memo(dict):
    """A dict of at most about twice ``bound`` entries: two generations, the older one forgotten.

    A key found in the older generation moves to the newer. ``turn`` makes the newer one the
    older one once it holds ``bound`` entries; call it between batches.
    """

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.old = bound, {}

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def lacks(self, keys) -> list:
        """The distinct keys that neither generation holds, in order."""
        return [k for k in dict.fromkeys(keys) if k not in self and k not in self.old]

    def turn(self) -> None:
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()


class Workspace:
    """Parquet tables in the shared folder that cut lineage and survive lost executors.

    The tables of one workspace lie under one folder. ``drop`` deletes a table that nothing
    reads any more; the rest stay, as a returned DataFrame may read them lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_folder(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(text: Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Strings of one-byte characters take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def strings(column: pa.Array) -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def connected_components(space: Workspace, edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (a, b): root is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014) until the edges are stars. The minimum of a node's
    neighbours comes from a map-side combined aggregate, and the join that hands it to the
    neighbours has a plain exchange on either side, so that AQE can split a hub's rows. Each
    step is written to the shared folder. Self loops count as nodes; nulls are dropped.
    """

    def minima(pairs: DataFrame, step: str) -> DataFrame:
        return space.write(pairs.groupBy("u").agg(F.min("v").alias("m")), f"{name}-min-{step}")

    def large(e: DataFrame, step: str) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        m = minima(both, step).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame, step: str) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        m = minima(down, step)
        moved = down.join(m, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.union(m.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    edges = edges.toDF("a", "b").where("a is not null and b is not null")
    nodes = space.write(edges.select("a").union(edges.select("b")).distinct().toDF("node"), f"{name}-nodes")
    e = space.write(edges.where("a <> b").distinct(), f"{name}-edges-0")
    mark = None
    for i in range(1, max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now[0] == 0 or tuple(now) == mark:
            break
        mark = tuple(now)
        half = space.write(large(e, f"l{i}"), f"{name}-half-{i}")
        new = space.write(small(half, f"s{i}"), f"{name}-edges-{i}")
        for old in (f"{name}-edges-{i - 1}", f"{name}-half-{i}", f"{name}-min-l{i}", f"{name}-min-s{i}"):
            space.drop(old)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))

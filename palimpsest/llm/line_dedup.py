"""Line dedup over the whole corpus, with DataFrame operations only.

A log-structured index keeps which document owns each line key. It is a stack of *runs*:
tables bucketed and sorted by the 128-bit hash of the key, with the smallest document that
holds it. Batches of documents come in ascending document order. Each batch is reduced to its
distinct keys, which are dealt once into the runs' buckets and merge-joined with each run, bucket
by bucket; runs are read as they lie, without an exchange. The keys that are new become one more
run of level 0. When a level has ``fanout`` runs they are merged into one run of the next
level, again bucket by bucket, so a key is rewritten O(log batches) times and a batch meets
O(log batches) runs.

A batch is a range of documents; the ranges hold about equal numbers of them, ``BATCH_DOCS`` at
most, are disjoint and ascend, so an owner in an earlier run always precedes the batch's own
documents, and the result equals that of one global minimum.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import BLANKS, Workspace, ascii_lower, documents, whole_text

#: Keys of fewer code points are never duplicates.
MIN_KEY_CHARS = 10
#: Batches that a corpus is dealt into at least, documents of a batch, and the most batches.
BATCHES, BATCH_DOCS, MAX_BATCHES = 4, 100_000_000, 1000
#: Runs that a level holds before they are merged.
FANOUT = 3
#: A document without an id comes after all others.
LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class RunStore:
    """Levelled sorted runs of (h1, h2, owner), each key in exactly one run.

    Runs have as many buckets as the session has shuffle partitions, so that what an exchange
    deals meets them bucket by bucket.
    """

    def __init__(self, space: Workspace, fanout: int = FANOUT):
        self.space, self.spark, self.fanout = space, space.spark, fanout
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix, self.tables = f"runs_{uuid.uuid4().hex}", []
        self.levels: dict[int, list[tuple[str, DataFrame]]] = defaultdict(list)

    def runs(self) -> list[DataFrame]:
        return [df for _, level in sorted(self.levels.items()) for _, df in level]

    def owners(self, keys: DataFrame) -> DataFrame:
        """Distinct keys with the owner that a run names (``old``, null where the key is new)."""
        names = []
        for i, run in enumerate(self.runs()):
            names.append(f"_owner_{i}")
            keys = keys.join(run.withColumnRenamed("owner", names[-1]), ["h1", "h2"], "left")
        return keys.withColumn("old", F.coalesce(*names) if names else F.lit(None).cast("long")).drop(*names)

    def write(self, keys: DataFrame) -> tuple[str, DataFrame]:
        """A table of its own, bucketed and sorted by key: its name and its rows."""
        name = f"{self.prefix}_{len(self.tables)}"
        keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.space.path(name)).saveAsTable(name)
        self.tables.append(name)
        return name, self.spark.table(name)

    def add(self, name: str, new: DataFrame) -> None:
        """Takes rows of a table that ``write`` made, keys that no run holds, as a run of level
        0, then merges full levels."""
        self.levels[0].append((name, new))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels.pop(level)
            # no key is in two runs; the aggregate lays their buckets side by side
            merged = reduce(DataFrame.union, [df for _, df in old]).groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
            self.levels[level + 1].append(self.write(merged))
            level += 1

    def clear(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.space.drop(name)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``docs`` with ``text_col`` less its duplicate lines, plus ``n_lines`` and ``n_dropped``.

    A text is split at ``\\n``. A line whose key (see ``line_key``) has at least ``min_chars``
    code points and lies in at least two documents is dropped from all but the one with the
    smallest id; lines repeated within that document stay. Null and empty texts are one empty
    line and come back as ''. A null id comes after all others and counts as one document, as
    do rows that share an id; each row comes back. Other columns pass unchanged, but for those
    named n_lines or n_dropped, which are replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "line-dedup")
    store = RunStore(space, fanout)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    cuts = _cuts(docs, doc, batches)
    batch = reduce(lambda c, cut: c + F.when(F.col("_doc") >= cut, 1).otherwise(0), cuts, F.lit(0))
    # _row tells rows that share an id apart; equal rows have equal duplicates
    keyed = docs.select(doc.alias("_doc"), whole_text(F.col(text_col)).alias("_text"))
    lines = (
        keyed.select("_doc", F.xxhash64("_text").alias("_row"), F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
        .select("_doc", "_row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "_doc", "_row", "pos", batch.alias("batch"))
    )
    lines = space.write(lines, "lines", partition_by="batch")
    drops = []
    for i in range(len(cuts) + 1):
        mine = lines.where(F.col("batch") == i).drop("batch")
        keys = mine.groupBy("h1", "h2").agg(F.min("_doc").alias("lo"), F.max("_doc").alias("hi"))
        name, keys = store.write(store.owners(keys))
        if i < len(cuts):
            store.add(name, keys.where("old is null").select("h1", "h2", F.col("lo").alias("owner")))
        # of a key that no other document holds, nothing is dropped; most keys end here. The plain
        # files, so that a line with very many rows can be split between tasks
        written = space.read(name, keys)
        shared = written.where("old is not null or lo < hi").select("h1", "h2", F.coalesce("old", "lo").alias("owner"))
        drops.append(mine.join(shared, ["h1", "h2"]).where("owner < _doc").select("_doc", "_row", "pos"))
    gone = reduce(DataFrame.union, drops).groupBy("_doc", "_row").agg(F.collect_set("pos").alias("_gone"))
    gone = space.write(gone, "gone")
    store.clear()
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # in a struct, so that no name of theirs meets one of ours
    others = F.struct(*[F.col(f"`{c}`") for c in rest if c != text_col]).alias("_rest")
    split = docs.select(others, doc.alias("_doc"), F.xxhash64(whole_text(F.col(text_col))).alias("_row"), F.split(whole_text(F.col(text_col)), "\n", -1).alias("_lines"))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    out = split.join(gone, ["_doc", "_row"], "left").withColumn("_kept", F.when(F.col("_gone").isNotNull(), F.array_except(every, F.col("_gone"))))
    text = F.when(F.col("_kept").isNull(), F.array_join("_lines", "\n")).otherwise(
        F.array_join(F.transform("_kept", lambda i: F.element_at("_lines", i + 1)), "\n")
    )
    return out.select(
        *[(text if c == text_col else F.col(f"_rest.`{c}`")).alias(c) for c in rest],
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_kept").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )


def _cuts(docs: DataFrame, doc: Column, batches: int) -> list[int]:
    """Ids that part the documents into about equal ranges, ``batches`` or more."""
    n, *grid = docs.agg(F.count("*"), F.percentile_approx(doc, [i / MAX_BATCHES for i in range(1, MAX_BATCHES)], 10_000)).first()
    batches = min(MAX_BATCHES, max(batches, math.ceil(n / BATCH_DOCS)))
    return sorted({grid[0][i * MAX_BATCHES // batches - 1] for i in range(1, batches)}) if n else []


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their duplicate lines; n_chars follows the text."""
    out = line_dedup(docs).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), owned AS (
  SELECT *, min(doc_id) OVER (PARTITION BY key) AS owner FROM keyed
), judged AS (
  SELECT *, length(key) >= 10 AND owner < doc_id AS gone FROM owned
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

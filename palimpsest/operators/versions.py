"""Version logs and what a snapshot makes of them.

A log row is one operation on one tuple: ``op`` I, U or D, the new values of the columns it
sets in ``payload`` and their names in ``set_cols`` (a column set to null is set). Its place
in the tuple's history is (commit_ts, own last, seq). A snapshot keeps the rows committed no
later than its start and the reader's own, and folds each tuple to the last value set of
each column; one shuffle on the tid, combined map-side, as all aggregates are ``max_by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, UPDATE, DELETE = "I", "U", "D"
#: Stamps of open transactions are their start plus this, which no commit reaches.
OPEN = 1 << 62
VISIBLE, DELETED, NOT_VISIBLE = "Visible", "Deleted", "NotVisible"


def log_schema(payload: T.StructType) -> T.StructType:
    loose = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in payload.fields])
    return T.StructType(
        [
            T.StructField("tid", T.LongType()),
            T.StructField("op", T.StringType()),
            T.StructField("seq", T.LongType()),
            T.StructField("txn_id", T.LongType()),
            T.StructField("set_cols", T.ArrayType(T.StringType())),
            T.StructField("payload", loose),
        ]
    )


def visible_rows(stamped: DataFrame, start: int, me: int | None = None) -> DataFrame:
    """Rows of a stamped log (with ``commit_ts``, null if not committed) that a snapshot sees."""
    own = F.lit(False) if me is None else F.col("txn_id") == me
    return stamped.where(F.coalesce(F.col("commit_ts") <= start, F.lit(False)) | own)


def place(me: int | None = None) -> Column:
    """A row's place in its tuple's history; the reader's own rows come last."""
    own = F.lit(0) if me is None else (F.col("txn_id") == me).cast("int")
    return F.struct(own, F.coalesce("commit_ts", F.lit(OPEN)), F.col("seq"))


def fold(stamped: DataFrame, columns: list[str], start: int, me: int | None = None, keep_deleted: bool = False) -> DataFrame:
    """The tuples of a snapshot: tid and the last value set of each column.

    ``keep_deleted`` keeps deleted tuples and adds ``status``.
    """
    rows = visible_rows(stamped, start, me).withColumn("_at", place(me))
    value = [F.max_by(F.col(f"payload.`{c}`"), F.when(F.array_contains("set_cols", c), F.col("_at"))).alias(c) for c in columns]
    out = rows.groupBy("tid").agg(F.max_by("op", "_at").alias("_op"), F.max(F.col("op") == INSERT).alias("_born"), *value)
    out = out.where("_born")
    if keep_deleted:
        return out.withColumn("status", F.when(F.col("_op") == DELETE, DELETED).otherwise(VISIBLE)).drop("_op", "_born")
    return out.where(F.col("_op") != DELETE).drop("_op", "_born")


def row_status(stamped: DataFrame, start: int, me: int | None = None) -> DataFrame:
    """(tid, status) of every tuple of the log: visible, deleted, or newer than the snapshot."""
    seen = F.coalesce(F.col("commit_ts") <= start, F.lit(False))
    if me is not None:
        seen = seen | (F.col("txn_id") == me)
    rows = stamped.withColumn("_at", F.when(seen, place(me)))
    head = rows.groupBy("tid").agg(F.max_by("op", "_at").alias("_op"))
    status = F.when(F.col("_op").isNull(), NOT_VISIBLE).when(F.col("_op") == DELETE, DELETED).otherwise(VISIBLE)
    return head.select("tid", status.alias("status"))


def heads(stamped: DataFrame) -> DataFrame:
    """(tid, op, stamp) of each tuple's newest version, open transactions' included."""
    stamp = F.coalesce("commit_ts", F.col("txn_id") + OPEN)
    at = F.struct(stamp, F.col("seq"))
    return stamped.groupBy("tid").agg(F.max_by("op", at).alias("op"), F.max(at)["col1"].alias("stamp"))


def conflicts(stamp: Column, start: int, me: int) -> Column:
    """Whether a newest version keeps this transaction from writing: another open one's, or
    one committed after this one began."""
    return F.when(stamp >= OPEN, stamp != me + OPEN).otherwise(stamp > start)


#: Operations that a slice of the history has at most, about; a key's operations in one slice
#: are one task's.
SLICE = 5_000_000


def earlier(rows: DataFrame, key: str, order: list[str], value: Column, how: str, name: str, rows_a_slice: int = SLICE) -> DataFrame:
    """``rows`` with a column ``name``: of the rows of the same key that come before in ``order``,
    the last value that is not null (``how`` "last") or the largest ("max").

    A key may have a third of all rows. So the history is cut into slices of about equal numbers
    of rows by the first column of ``order``, a number or a time. Each slice's outcome (one row for a
    key and slice) is carried into the later ones as a row that comes first there, and a window
    sees a key's rows of one slice. There is no join: null is a key like any other.
    """
    first = F.col(order[0])
    n = rows.count()
    slices = max(1, -(-n // rows_a_slice))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(key, "_slice").orderBy("_mine", *order).rowsBetween(Window.unboundedPreceding, -1)

    def of(c: str, w) -> Column:
        return F.last(c, ignorenulls=True).over(w) if how == "last" else F.max(c).over(w)

    cuts = []
    if slices > 1:
        # as text and back: a time without a zone is no number, and Python has no literal for it
        at_share = F.percentile_approx(first, [i / slices for i in range(1, slices)], 10_000)
        cuts = rows.agg(at_share.cast("array<string>")).first()[0] or []
    if not cuts:
        whole = rows.withColumns({"_slice": F.lit(0), "_mine": F.lit(True), "_value": value})
        return whole.withColumn(name, of("_value", within)).select(*rows.columns, name)
    kind = rows.schema[order[0]].dataType
    marks = F.array(*[F.lit(c).cast(kind) for c in sorted(set(cuts))])
    sliced = rows.withColumns({"_slice": F.size(F.filter(marks, lambda c: c <= first)), "_mine": F.lit(True), "_value": value})
    at = F.struct(*order)
    outcome = F.max_by("_value", F.when(F.col("_value").isNotNull(), at)) if how == "last" else F.max("_value")
    carried = sliced.groupBy(key, "_slice").agg(outcome.alias("_of")).withColumn("_value", of("_of", before))
    carried = carried.where(F.col("_value").isNotNull()).drop("_of").withColumn("_mine", F.lit(False))
    out = sliced.unionByName(carried, allowMissingColumns=True).withColumn(name, of("_value", within))
    return out.where("_mine").select(*rows.columns, name)


def accepted(operations: DataFrame, key: str, *order: str, rows_a_slice: int = SLICE) -> DataFrame:
    """Operations with ``ok``: an insert needs the key dead, updates and deletes need it live.

    The latest earlier insert or delete decides, whether it was itself accepted or not.
    """
    bears = F.when(F.col("op").isin(INSERT, DELETE), F.col("op"))
    judged = earlier(operations, key, list(order), bears, "last", "_last", rows_a_slice)
    live = F.coalesce(F.col("_last") == INSERT, F.lit(False))
    return judged.withColumn("ok", F.when(F.col("op") == INSERT, ~live).otherwise(live)).drop("_last")

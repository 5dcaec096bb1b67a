"""Key indexes over (key columns, tid) entries: lookups, unique checks, deletion.

An entry table is an ordinary DataFrame with the key columns and ``tid``. Keys compare as
their byte encodings do: text by its folded form, doubles with one zero and one NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.errors import UniqueViolation, WriteConflict
from palimpsest.functions.keys import fold, fold_text
from palimpsest.functions.types import Field
from palimpsest.operators import versions as V


def equals(field: Field, value) -> Column:
    """Whether a key column equals a value, as keys do. Numbers and booleans are plain
    comparisons, which reach the Parquet scan."""
    c = F.col(field.name)
    if value is None:
        return c.isNull()
    if field.type == "VARCHAR":
        return fold(c) == fold_text(value)
    return c == F.lit(value)


def folded_columns(fields: list[Field]) -> list[Column]:
    """Expressions that are equal just where the keys are."""
    out = []
    for f in fields:
        c = F.col(f.name)
        # 0.0 is added so that a group of zeros has one sign
        out.append((fold(c) if f.type == "VARCHAR" else c + F.lit(0.0) if f.type == "DOUBLE" else c).alias(f.name))
    return out


class KeyIndex:
    """An index on ``fields`` of an entry table (key columns and tid)."""

    def __init__(self, fields: list[Field], unique: bool = False):
        self.fields, self.unique = fields, unique
        self.names = [f.name for f in fields]

    def matching(self, entries: DataFrame, *values) -> DataFrame:
        """The entries whose whole key equals the values."""
        if len(values) != len(self.fields):
            raise ValueError(f"the key has {len(self.fields)} columns")
        found = entries
        for f, v in zip(self.fields, values):
            found = found.where(equals(f, v))
        return found

    def get(self, entries: DataFrame, *values) -> DataFrame:
        """tids of the entries whose whole key equals the values, ascending."""
        return self.matching(entries, *values).select("tid").orderBy("tid")

    def insert(self, entries: DataFrame, new: DataFrame) -> DataFrame:
        """Entries with new ones; equal keys accumulate."""
        return entries.select(*self.names, "tid").unionByName(new.select(*self.names, "tid"))

    def delete(self, entries: DataFrame, gone: DataFrame) -> DataFrame:
        """Entries without those (key, tid) pairs; other rows of the same key stay."""
        keys = [c.alias(f"_{n}") for c, n in zip(folded_columns(self.fields), self.names)]
        left = entries.select("*", *keys)
        right = gone.select(F.col("tid").alias("_tid"), *[c.alias(f"_gone_{n}") for c, n in zip(folded_columns(self.fields), self.names)])
        on = F.col("tid") == F.col("_tid")
        for n in self.names:
            on = on & F.col(f"_{n}").eqNullSafe(F.col(f"_gone_{n}"))
        return left.join(right, on, "left_anti").drop(*[f"_{n}" for n in self.names])

    def violations(self, entries: DataFrame) -> DataFrame:
        """Keys that more than one entry has, with their number of entries."""
        return entries.groupBy(*folded_columns(self.fields)).agg(F.count("*").alias("owners")).where("owners > 1")

    def insertable(self, entries: DataFrame, candidates: DataFrame) -> DataFrame:
        """Candidates whose key no entry owns and no other candidate has."""
        keys = [f"_{n}" for n in self.names]
        c = candidates.select("*", *[k.alias(n) for k, n in zip(folded_columns(self.fields), keys)])
        e = entries.select(*[k.alias(n) for k, n in zip(folded_columns(self.fields), keys)])
        twice = c.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)
        return c.join(e, keys, "left_anti").join(twice, keys, "left_anti").drop(*keys)

    def key_states(self, owners: DataFrame, start: int, me: int) -> DataFrame:
        """For each key ``free``: whether a transaction may take it.

        ``owners`` are entries with their tuple's newest version (op, stamp), null for rows that
        have none and so always own their key. A key is free if each owner is deleted, and the
        deletion is this transaction's or was committed before it began.
        """
        conflict = V.conflicts(F.col("stamp"), start, me)
        owned = F.col("op").isNull() | (F.col("op") != V.DELETE) | conflict
        keys = [k.alias(n) for k, n in zip(folded_columns(self.fields), self.names)]
        return owners.groupBy(*keys).agg(F.bool_and(~owned).alias("free"))

    def insert_unique(self, owners: DataFrame, candidates: DataFrame, start: int, me: int) -> DataFrame:
        """Candidates, if each may take its key (see ``key_states``); raises otherwise."""
        taken = self.key_states(owners, start, me).where(~F.col("free"))
        names = [f"_{n}" for n in self.names]
        c = candidates.select(*[k.alias(n) for k, n in zip(folded_columns(self.fields), names)])
        if not self.violations(candidates).isEmpty():
            raise UniqueViolation(f"a key ({', '.join(self.names)}) occurs twice among the new rows", column_name=self.names[0])
        if not c.join(taken.toDF(*names, "free"), names, "left_semi").isEmpty():
            raise UniqueViolation(f"a key ({', '.join(self.names)}) is taken", column_name=self.names[0])
        return candidates

    def target_for_modify(self, owners: DataFrame, start: int, me: int) -> DataFrame:
        """For each key (tid, conflict): the first tid that may be written, unless one before it
        conflicts. Deleted owners are passed over; keys with none left give no row."""
        conflict = F.col("op").isNotNull() & V.conflicts(F.col("stamp"), start, me)
        live = F.col("op").isNull() | (F.col("op") != V.DELETE)
        first = owners.where(conflict | live).withColumn("conflict", conflict)
        keys = [k.alias(n) for k, n in zip(folded_columns(self.fields), self.names)]
        return first.groupBy(*keys).agg(F.min("tid").alias("tid"), F.min_by("conflict", "tid").alias("conflict"))

    def pick_for_modify(self, owners: DataFrame, start: int, me: int, *values) -> int | None:
        """The tid to write for one key, None if there is none; raises on a conflict."""
        found = owners
        for f, v in zip(self.fields, values):
            found = found.where(equals(f, v))
        row = self.target_for_modify(found, start, me).limit(1).collect()
        if row and row[0].conflict:
            raise WriteConflict("the key's row was written by another transaction", column_name=self.names[0])
        return row[0].tid if row else None

    def exists(self, owners: DataFrame, *values) -> bool:
        """Whether a row of a snapshot has the key."""
        return not self.get(owners, *values).isEmpty()

    def _sorts(self) -> list[Column]:
        """Columns that sort and compare as the keys' bytes do: Spark puts nulls first, has one
        zero, puts NaN last and compares text by its UTF-8 bytes."""
        return [fold(F.col(f.name)) if f.type == "VARCHAR" else F.col(f.name) for f in self.fields]

    def ordered(self, entries: DataFrame) -> DataFrame:
        """Entries in key order, then by tid."""
        return entries.orderBy(*self._sorts(), "tid")

    def range(self, entries: DataFrame, low: tuple | None, high: tuple | None) -> DataFrame:
        """Extension: entries between two keys, ends included, in key order.

        Keys are compared column by column, nulls first. The bounds of a leading column that is
        no text also stand alone, so that they reach the Parquet scan.
        """
        out, lead = entries, self.fields[0]
        for bound, above in ((low, True), (high, False)):
            if bound is None:
                continue
            if lead.type != "VARCHAR" and bound[0] is not None:
                plain = F.col(lead.name) >= F.lit(bound[0]) if above else F.col(lead.name) <= F.lit(bound[0])
                out = out.where(plain if above or not lead.nullable else plain | F.col(lead.name).isNull())
            inside, equal = F.lit(False), F.lit(True)
            for f, c, v in zip(self.fields, self._sorts(), bound):
                if v is None:
                    beyond, same = (c.isNotNull() if above else F.lit(False)), c.isNull()
                else:
                    x = F.lit(fold_text(v) if f.type == "VARCHAR" else v)
                    beyond = F.coalesce(c > x if above else c < x, F.lit(not above))
                    same = F.coalesce(c == x, F.lit(False))
                inside, equal = inside | (equal & beyond), equal & same
            out = out.where(inside | equal)
        return out.orderBy(*self._sorts(), "tid")

"""Versioned tables: inserts, updates and deletes into a log, reads through snapshots.

A table's log is a folder ``log-<n>``; the highest n with a marker in ``current`` is the one in
use (none yet: 0). Compaction writes the next folder whole, then its marker, and only then
removes the one before, so a driver may stop anywhere and the next one reads the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.errors import NotNullViolation, NumericOutOfRange, UndefinedColumn, WriteConflict
from palimpsest.functions.types import TYPES, Field, missing, out_of_range, schema_of
from palimpsest.operators import versions as V
from palimpsest.operators.transactions import Engine, Transaction
from palimpsest.sources import pages


class VersionedTable:
    """A relation of the engine. Rows get a tid at insertion: their page and slot."""

    def __init__(self, engine: Engine, name: str, fields: list[Field]):
        self.engine, self.name, self.fields = engine, name, fields
        self.columns = [f.name for f in fields]
        self.schema = V.log_schema(schema_of(fields))
        self.per_page = pages.rows_per_page(pages.row_chunk_bytes(fields))
        self.spark = engine.spark
        engine.store.ensure(f"{name}/{self._log_name(self._generation())}")

    # the log

    @staticmethod
    def _log_name(generation: int) -> str:
        return f"log-{generation}"

    def _generation(self) -> int:
        return max((int(n) for n in self.engine.store.names(f"{self.engine.store.path(self.name)}/current") if n.isdigit()), default=0)

    def log_path(self) -> str:
        """The folder of the log in use."""
        return f"{self.engine.store.path(self.name)}/{self._log_name(self._generation())}"

    def _folder(self, txn: Transaction) -> str:
        return f"{self.engine.root}/staging/{self.engine.epoch}/{txn.start}/{self.name}"

    def stage(self, txn: Transaction, rows: DataFrame) -> None:
        """Writes log rows where only this transaction and conflict checks see them."""
        txn.check()
        txn.touched[self.name] = self
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.mode("append").parquet(f"{self._folder(txn)}/{txn.seq}-{uuid.uuid4().hex}")

    def publish(self, txn: Transaction) -> None:
        """Moves the staged files into the log. They count once the commit's marker is there."""
        base, store = self._folder(txn), self.engine.store
        log = self.log_path()
        for part in store.names(base):
            for file in store.names(f"{base}/{part}"):
                if file.endswith(".parquet"):
                    store.rename(f"{base}/{part}/{file}", f"{log}/{txn.start}-{part}-{file}")
        store.remove(base)

    def discard(self, txn: Transaction) -> None:
        self.engine.store.remove(self._folder(txn))

    def log(self, own: Transaction | None = None) -> DataFrame:
        """All versions with ``commit_ts``: null for rows of transactions that are still open, of
        which only ``own`` is read if it is given. Rows of aborted transactions are in no log.
        Rows of transaction 0 are a compaction's, which every snapshot sees."""
        store = self.engine.store
        stored = store.open(f"{self.name}/{self._log_name(self._generation())}", self.schema)
        stamps = self.engine.commits().unionByName(self.spark.createDataFrame([(0, 0)], "txn_id long, commit_ts long"))
        rows = stored.join(stamps, "txn_id")
        folders = [f"{self._folder(t)}/{part}" for t in ([own] if own else list(self.engine.open.values())) for part in store.names(self._folder(t)) if store.exists_path(f"{self._folder(t)}/{part}/_SUCCESS")]
        if folders:
            staged = self.spark.read.schema(self.schema).parquet(*folders).withColumn("commit_ts", F.lit(None).cast("long"))
            rows = rows.unionByName(staged)
        return rows

    # writes

    def _last_tid(self) -> int | None:
        if self.name not in self.engine.last_tid and self.is_new():
            self.engine.last_tid[self.name] = None
        elif self.name not in self.engine.last_tid:
            self.engine.last_tid[self.name] = self.engine.store.open(f"{self.name}/{self._log_name(self._generation())}", self.schema).agg(F.max("tid")).first()[0]
        return self.engine.last_tid[self.name]

    def insert(self, txn: Transaction, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
        """Appends rows and returns them with their tids. Tids follow ``order``, or else the rows'
        places in their partitions. One pass over ``rows`` checks ranges and nulls and numbers
        them; a row that is out of range or lacks a value raises, and none is inserted."""
        with self.engine.gate:
            seq = txn.next_seq()
            checks = Observation()
            wrong, lacking = out_of_range(self.fields), missing(self.fields)
            watched = rows.observe(checks, F.max(wrong).alias("wrong"), F.max(lacking).alias("lacking"))
            cast = watched.select(*[F.col(f"`{f.name}`").try_cast(TYPES[f.type].spark).alias(f.name) for f in self.fields])
            scratch = f"{self.engine.root}/staging/{self.engine.epoch}/{txn.start}/.numbered-{uuid.uuid4().hex}"

            def write(df: DataFrame) -> DataFrame:
                df.write.parquet(scratch)
                return self.spark.read.schema(df.schema).parquet(scratch)

            placed, n = pages.numbered_from(cast, *(order or ()), scratch=write)
            found = checks.get
            if found["wrong"] or found["lacking"]:
                self.engine.store.remove(scratch)
                kind, why = (NumericOutOfRange, "a value is out of range of its type") if found["wrong"] else (NotNullViolation, "a column that takes no null got one")
                raise kind(f"{why} ({', '.join(f'{f.name} {f.type}' for f in self.fields)})", table_name=self.name)
            last = self._last_tid()
            # the next page begins after the last that is in use, so slots never meet
            first = (last >> 32) * self.per_page if last is not None else 0
            made = placed.withColumn("tid", pages.tid_of(F.col("ordinal") + first, self.per_page)).drop("ordinal")
            self.stage(txn, self._rows(made, V.INSERT, seq, txn, self.columns))
            if n:
                at = first + n - 1
                self.engine.last_tid[self.name] = (at // self.per_page + 1) << 32 | at % self.per_page
            return made.select("tid", *self.columns)

    def insert_values(self, txn: Transaction, rows: list[tuple]) -> None:
        """Appends a statement's few rows, made on the driver, in their order: one write."""
        with self.engine.gate:
            seq = txn.next_seq()
            last = self._last_tid()
            first = (last >> 32) * self.per_page if last is not None else 0
            tids = [(at // self.per_page + 1) << 32 | at % self.per_page for at in range(first, first + len(rows))]
            made = self.spark.createDataFrame([(tid, *r) for tid, r in zip(tids, rows)], T.StructType([T.StructField("tid", T.LongType()), *schema_of(self.fields).fields])).coalesce(1)
            self.stage(txn, self._rows(made, V.INSERT, seq, txn, self.columns))
            if tids:
                self.engine.last_tid[self.name] = tids[-1]

    def is_new(self) -> bool:
        """Whether nothing was ever written, by open transactions either."""
        store = self.engine.store
        return not store.names(self.log_path()) and not any(store.names(self._folder(t)) for t in self.engine.open.values())

    def _rows(self, df: DataFrame, op: str, seq: int, txn: Transaction | None, columns: list[str]) -> DataFrame:
        payload = F.struct(*[(F.col(f"`{f.name}`") if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema["payload"].dataType.fields])
        return df.select("tid", F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), F.lit(txn.start if txn else 0).cast("long").alias("txn_id"), F.array(*map(F.lit, columns)).cast("array<string>").alias("set_cols"), payload.alias("payload"))

    def _check(self, txn: Transaction, tids: DataFrame) -> None:
        """Raises if any of the tids has a version that keeps the transaction from writing, or
        is deleted, or is no row at all."""
        heads = tids.select("tid").join(V.heads(self.log()), "tid", "left")
        bad = F.col("op").isNull() | V.conflicts(F.col("stamp"), txn.start, txn.start) | (F.col("op") == V.DELETE)
        found = heads.where(bad).limit(1).collect()
        if found:
            raise WriteConflict(f"row {found[0].tid} of {self.name} was written by another transaction, or is deleted or absent", table_name=self.name)

    def update(self, txn: Transaction, changes: DataFrame) -> None:
        """``changes`` has tid and the columns to set, once for each tid."""
        columns = [c for c in changes.columns if c != "tid"]
        if unknown := set(columns) - set(self.columns):
            raise UndefinedColumn(f"no column {sorted(unknown)} in {self.name}", table_name=self.name, column_name=sorted(unknown)[0])
        with self.engine.gate:
            seq = txn.next_seq()
            self._check(txn, changes)
            self.stage(txn, self._rows(changes, V.UPDATE, seq, txn, columns))

    def delete(self, txn: Transaction, tids: DataFrame) -> None:
        with self.engine.gate:
            seq = txn.next_seq()
            self._check(txn, tids)
            self.stage(txn, self._rows(tids.select("tid"), V.DELETE, seq, txn, []))

    # reads

    def snapshot(self, txn: Transaction) -> DataFrame:
        """tid and columns of the rows that the transaction sees, lazily."""
        txn.check()
        return V.fold(self.log(txn), self.columns, txn.start, txn.start)

    def get(self, txn: Transaction, tid: int | Column, columns: list[str] | None = None) -> DataFrame:
        """One row by its tid; the filter reaches the log's scan before the fold."""
        txn.check()
        rows = V.fold(self.log(txn).where(F.col("tid") == tid), self.columns, txn.start, txn.start)
        return rows.select("tid", *(columns or self.columns))

    def scan_slots(self, txn: Transaction, n: int) -> DataFrame:
        """The first ``n`` rows by tid."""
        return self.snapshot(txn).orderBy("tid").limit(n)

    def status(self, txn: Transaction) -> DataFrame:
        """(tid, status) of all versions' tuples: visible, deleted or not visible."""
        txn.check()
        return V.row_status(self.log(), txn.start, txn.start)

    def page_count(self, txn: Transaction) -> int:
        """Pages that rows were ever given, those of open transactions included."""
        txn.check()
        last = self._last_tid()
        return 0 if last is None else last >> 32

    # extension

    def compact(self) -> int:
        """Folds what every snapshot sees into one insert a row; returns the rows kept.

        Only when no transaction is open. Rows of transactions that never committed go too.
        The new log counts once its marker is there; the old one is removed after that.
        """
        store, engine = self.engine.store, self.engine
        with engine.gate:
            if engine.open:
                raise WriteConflict("a transaction is open", table_name=self.name)
            engine._check_epoch()
            self._last_tid()  # tids of deleted rows are not given out again
            base, old = store.path(self.name), self._generation()
            new = max([old, *(int(n[4:]) for n in store.names(base) if n.startswith("log-") and n[4:].isdigit())]) + 1
            txn = engine.begin()
            try:
                rows = self._rows(self.snapshot(txn), V.INSERT, 0, None, self.columns)
                rows.write.parquet(f"{base}/{self._log_name(new)}")
            finally:
                txn.abort()
            kept = store.open(f"{self.name}/{self._log_name(new)}", self.schema).count()
            if not store.mark(f"{base}/current/{new}"):
                raise WriteConflict(f"log {new} of {self.name} exists", table_name=self.name)
            for name in store.names(base):
                if name.startswith("log-") and name != self._log_name(new):
                    store.remove(f"{base}/{name}")
            for name in store.names(f"{base}/current"):
                if name.isdigit() and int(name) < new:
                    store.remove(f"{base}/current/{name}")
            engine.fold_commits()
            return kept

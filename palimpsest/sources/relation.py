"""Relation files: Parquet folders under one root, on any file system Spark knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from palimpsest.functions.errors import DuplicateTable, UndefinedTable


class RelationStore:
    """Create, open, extend, list and drop relations. A relation is a folder of Parquet files
    with an empty first file that carries its schema."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def exists_path(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def create(self, name: str, schema: T.StructType) -> DataFrame:
        """A new, empty relation; raises if there is one of that name."""
        if self.exists(name):
            raise DuplicateTable(f"relation {name!r} exists")
        self.spark.createDataFrame([], schema).write.mode("errorifexists").parquet(self.path(name))
        return self.open(name, schema)

    def open(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        if not self.exists(name):
            raise UndefinedTable(f"relation {name!r} does not exist")
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def open_or_create(self, name: str, schema: T.StructType) -> DataFrame:
        return self.open(name, schema) if self.exists(name) else self.create(name, schema)

    def ensure(self, name: str) -> None:
        """Makes the relation's folder if it isn't there; its readers bring the schema."""
        fs, p = self._fs(self.path(name))
        fs.mkdirs(p)

    def extend(self, name: str, rows: DataFrame) -> None:
        """Appends rows as new files; files that are there never change."""
        if not self.exists(name):
            raise UndefinedTable(f"relation {name!r} does not exist")
        rows.write.mode("append").parquet(self.path(name))

    def drop(self, name: str) -> None:
        fs, p = self._fs(self.path(name))
        if not fs.delete(p, True):
            raise UndefinedTable(f"relation {name!r} does not exist")

    def list(self) -> list[str]:
        """Names of the relations under the root."""
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName()[0] not in "._")

    def rename(self, old: str, new: str) -> None:
        """Moves a folder in one step; raises if the target is there."""
        fs, a = self._fs(old)
        _, b = self._fs(new)
        fs.mkdirs(b.getParent())
        if fs.exists(b) or not fs.rename(a, b):
            raise DuplicateTable(f"cannot move to {new!r}")

    def mark(self, path: str) -> bool:
        """Creates an empty file if it isn't there; tells whether it did."""
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        return fs.createNewFile(p)

    def names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

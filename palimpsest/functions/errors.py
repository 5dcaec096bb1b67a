"""Errors with the SQLSTATE codes of PostgreSQL's public table, and the fields of its messages."""

from __future__ import annotations

import json

SEVERITIES = ("DEBUG", "LOG", "INFO", "NOTICE", "WARNING", "ERROR", "FATAL", "PANIC")
#: Fields of an error besides its severity, SQLSTATE and message.
FIELDS = ("detail", "hint", "position", "internal_position", "internal_query", "where", "schema_name", "table_name", "column_name", "datatype_name", "constraint_name")


class EngineError(Exception):
    """An error of the engine; ``sqlstate`` tells its kind, ``fields`` what it is about."""

    sqlstate = "XX000"
    severity = "ERROR"

    def __init__(self, message: str, severity: str | None = None, **fields):
        super().__init__(message)
        if unknown := set(fields) - set(FIELDS):
            raise TypeError(f"no error fields {sorted(unknown)}")
        if severity is not None and severity not in SEVERITIES:
            raise ValueError(f"no severity {severity!r}")
        self.message, self.fields = message, {k: v for k, v in fields.items() if v is not None}
        self.severity = severity or type(self).severity

    def __getattr__(self, name: str):
        if name in FIELDS:
            return self.fields.get(name)
        raise AttributeError(name)

    def report(self) -> dict[str, str]:
        """Every field that is set, by name."""
        return {"severity": self.severity, "sqlstate": self.sqlstate, "message": self.message, **self.fields}

    def __str__(self) -> str:
        more = "".join(f"\n{k.upper().replace('_', ' ')}: {v}" for k, v in self.fields.items())
        return f"[{self.sqlstate}] {self.message}{more}"


def _kind(name: str, code: str, doc: str) -> type[EngineError]:
    return type(name, (EngineError,), {"sqlstate": code, "__doc__": doc})


UniqueViolation = _kind("UniqueViolation", "23505", "A live row owns the key.")
NotNullViolation = _kind("NotNullViolation", "23502", "A column that takes no null got one.")
NumericOutOfRange = _kind("NumericOutOfRange", "22003", "A number outside its type.")
WriteConflict = _kind("WriteConflict", "40001", "Another transaction wrote the row first.")
InvalidTransactionState = _kind("InvalidTransactionState", "25000", "The transaction has ended or was aborted.")
UndefinedTable = _kind("UndefinedTable", "42P01", "No such relation.")
UndefinedColumn = _kind("UndefinedColumn", "42703", "No such column.")
UndefinedObject = _kind("UndefinedObject", "42704", "No such object.")
DuplicateTable = _kind("DuplicateTable", "42P07", "A relation of that name exists.")
DuplicateColumn = _kind("DuplicateColumn", "42701", "A column of that name exists.")
DuplicateSchema = _kind("DuplicateSchema", "42P06", "A namespace of that name exists.")
DuplicateDatabase = _kind("DuplicateDatabase", "42P04", "A database of that name exists.")
DuplicateObject = _kind("DuplicateObject", "42710", "An object of that name exists.")
InvalidSchemaName = _kind("InvalidSchemaName", "3F000", "No such namespace.")
InvalidCatalogName = _kind("InvalidCatalogName", "3D000", "No such database.")
LockNotAvailable = _kind("LockNotAvailable", "55P03", "Another transaction changes the catalog.")

SQLSTATES = {c.sqlstate: c for c in list(globals().values()) if isinstance(c, type) and issubclass(c, EngineError)}


def sqlstates(spark) -> dict[str, str]:
    """The SQLSTATEs of PostgreSQL's table with their descriptions, out of the public table of
    error states that comes with Spark."""
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    raw = spark._jvm.scala.io.Source.fromInputStream(loader.getResourceAsStream("error/error-states.json"), "UTF-8").mkString()
    return {code: state["description"] for code, state in json.loads(raw).items() if "PostgreSQL" in state["usedBy"]}

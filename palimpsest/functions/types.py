"""The twelve column types, their widths, their Spark types and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnType:
    """A type: width in bytes, Spark type, and the range of an integer."""

    name: str
    width: int
    spark: T.DataType
    low: int | None = None
    high: int | None = None
    signed: bool = True


def _int(name: str, width: int, spark: T.DataType, signed: bool = True) -> ColumnType:
    bits = 8 * width
    return ColumnType(name, width, spark, -(1 << bits - 1) if signed else 0, (1 << bits - signed) - 1, signed)


TYPES = {
    t.name: t
    for t in (
        ColumnType("BOOLEAN", 1, T.BooleanType()),
        _int("TINYINT", 1, T.ByteType()),
        _int("SMALLINT", 2, T.ShortType()),
        _int("INTEGER", 4, T.IntegerType()),
        _int("BIGINT", 8, T.LongType()),
        # Spark has no unsigned integers: the next wider type and a range check
        _int("UTINYINT", 1, T.ShortType(), False),
        _int("USMALLINT", 2, T.IntegerType(), False),
        _int("UINTEGER", 4, T.LongType(), False),
        _int("UBIGINT", 8, T.DecimalType(20, 0), False),
        ColumnType("DOUBLE", 8, T.DoubleType()),
        ColumnType("VARCHAR", 16, T.StringType()),
        ColumnType("VARBINARY", 16, T.BinaryType()),
    )
}
#: Numbers of the types as stored in pg_attribute.
TYPE_OIDS = {name: i + 1 for i, name in enumerate(TYPES)}

_FROM_SPARK = {"boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "DOUBLE", "string": "VARCHAR", "binary": "VARBINARY"}


@dataclass(frozen=True)
class Field:
    """A column: its name, type, id, and whether it takes nulls."""

    name: str
    type: str
    oid: int = 0
    nullable: bool = False


def schema_of(fields: list[Field]) -> T.StructType:
    """The Spark schema; a column's id, place and type stay in its metadata."""
    return T.StructType([T.StructField(f.name, TYPES[f.type].spark, f.nullable, {"oid": f.oid, "position": i, "type": f.type}) for i, f in enumerate(fields)])


def fields_of(schema: T.StructType) -> list[Field]:
    """Columns of a Spark schema; types without a counterpart are VARCHAR."""
    return [Field(f.name, f.metadata.get("type") or _FROM_SPARK.get(f.dataType.simpleString(), "VARCHAR"), f.metadata.get("oid", i + 1), f.nullable) for i, f in enumerate(schema.fields)]


def out_of_range(fields: list[Field]) -> Column:
    """True where some value is outside its column's type."""
    kind, any_ = "decimal(20,0)", F.lit(False)
    for f in fields:
        t, c = TYPES[f.type], F.col(f"`{f.name}`")
        bad = c.isNotNull() & c.try_cast(t.spark).isNull()
        if t.low is not None:
            wide = c.try_cast(kind)
            bad = bad | F.coalesce((wide < F.lit(str(t.low)).cast(kind)) | (wide > F.lit(str(t.high)).cast(kind)), F.lit(False))
        any_ = any_ | bad
    return any_


def missing(fields: list[Field]) -> Column:
    """True where a column that takes no null has one."""
    any_ = F.lit(False)
    for f in fields:
        if not f.nullable:
            any_ = any_ | F.col(f"`{f.name}`").isNull()
    return any_

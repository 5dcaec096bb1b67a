"""Page arithmetic: how many rows a page holds, where a row goes, tombstone bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.keys import align_up, pack_tid
from palimpsest.functions.types import TYPES, Field

PAGE_BYTES = 8192
ROW_COUNT_BYTES = 4
MAX_INDEX_ROW = PAGE_BYTES // 10
#: Bytes of a page that rows fill before the next page begins.
FILL_BYTES = PAGE_BYTES - ROW_COUNT_BYTES


@dataclass(frozen=True)
class PageLayout:
    """Column-major placement of a schema in one page."""

    row_bytes: int
    max_rows: int
    deleted_offset: int
    column_offsets: tuple[int, ...]


def page_layout(fields: list[Field]) -> PageLayout:
    """A page: row count, a bit per row for tombstones, then each column's values."""
    widths = [TYPES[f.type].width for f in fields]
    spare = sum(w - 1 for w in widths)
    rows = (PAGE_BYTES - ROW_COUNT_BYTES - spare) * 8 // (1 + 8 * sum(widths))
    at = ROW_COUNT_BYTES + -(-rows // 8)
    offsets = []
    for w in widths:
        at = align_up(at, w)
        offsets.append(at)
        at += w * rows
    return PageLayout(sum(widths), rows, ROW_COUNT_BYTES, tuple(offsets))


def row_chunk_bytes(fields: list[Field]) -> int:
    """Bytes of one row as a self-describing chunk: two 4-byte numbers, a 4-byte id and a 2-byte
    offset for each column, then the values at multiples of their width (8 at most)."""
    at = 8 + 6 * len(fields)
    for f in fields:
        w = TYPES[f.type].width
        at = align_up(at, min(w, 8)) + w
    return align_up(at, 8)


def rows_per_page(chunk_bytes: int) -> int:
    return FILL_BYTES // chunk_bytes


def page_of(ordinal: Column, per_page: int) -> Column:
    """The page (from 1) of the row with a 1-based ordinal."""
    return (F.floor((ordinal - 1) / per_page) + 1).cast("bigint")


def tid_of(ordinal: Column, per_page: int) -> Column:
    """The tid of the row with a 1-based ordinal: its page, and its slot from 0."""
    return pack_tid(page_of(ordinal, per_page), F.pmod(ordinal - 1, F.lit(per_page)))


def tombstone(ordinal: Column) -> tuple[Column, Column]:
    """(byte, bit) of the tombstone of the row with a 0-based place in its page."""
    return (F.lit(ROW_COUNT_BYTES) + F.floor(ordinal / 8)).cast("bigint"), F.pmod(ordinal, F.lit(8)).cast("bigint")


#: Rows of a range that one task sorts: so many that it needs tens of MB, until there are
#: MANY ranges, to which map tasks write without a buffer of their own; at most MOST_SORTED then.
SORTED, MANY, MOST_SORTED = 250_000, 200, 2_000_000


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` sorted by ``order``, in as many ranges as its number of rows asks for, so that
    no sort spills however few partitions the session sets."""
    n = df.count()
    ranges = max(1, min(MANY, -(-n // SORTED)), -(-n // MOST_SORTED))
    return df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)


def numbered(df: DataFrame, *order: str, scratch, name: str = "ordinal", keep: list[str] | None = None) -> DataFrame:
    """``df`` with its rows' 1-based places in a total order, without a single-task window."""
    return numbered_from(df, *order, scratch=scratch, name=name, keep=keep)[0]


def numbered_from(df: DataFrame, *order: str, scratch, name: str = "ordinal", keep: list[str] | None = None) -> tuple[DataFrame, int]:
    """``numbered``, and the number of rows. Without an ``order`` rows are numbered as they lie in
    their partitions, with no exchange.

    Rows are (``ranged`` by ``order`` and) written once by ``scratch``, only the columns to
    ``keep`` (None: all); each partition's number of rows (one number for each partition) shifts
    its rows' places as they are read.
    """
    at = F.monotonically_increasing_id()
    kept = ["*"] if keep is None else keep
    placed = scratch((ranged(df, *order) if order else df).select(*kept, at.alias("_at")))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    shifts, total = [], 0
    for p, n in sizes:
        shifts.append((p, total))
        total += n
    if not shifts:
        return placed.withColumn(name, F.lit(None).cast("bigint")).drop("_at"), 0
    table = F.broadcast(df.sparkSession.createDataFrame(shifts, "_p long, _shift long"))  # a row for each partition
    return placed.withColumn("_p", part).join(table, "_p").withColumn(name, F.col("_shift") + row + 1).drop("_at", "_p", "_shift"), total

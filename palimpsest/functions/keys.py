"""Byte-comparable keys: memory order of the bytes is the order of the values.

Encodings are column expressions, but for folding text with characters beyond ASCII and the
raw bits of a double, which take an Arrow function.
"""

from __future__ import annotations

import struct
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.types import TYPES, Field

#: A text's bytes in a key are bounded by this much for planning; a tid takes 8 bytes more.
TEXT_KEY_BYTES, TID_BYTES = 52, 8
NULL_FIRST, NOT_NULL = b"\x00", b"\x01"


def encode_signed(c: Column, width: int) -> Column:
    """Big-endian with the sign bit flipped."""
    bits = 8 * width
    if width == 8:
        return F.unhex(F.lpad(F.hex(c.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.unhex(F.lpad(F.hex((c.cast("bigint") + (1 << bits - 1)).bitwiseAND(F.lit((1 << bits) - 1))), 2 * width, "0"))


def encode_unsigned(c: Column, width: int) -> Column:
    """Big-endian."""
    if width < 8:
        return F.unhex(F.lpad(F.hex(c.cast("bigint")), 2 * width, "0"))
    # numbers of 2 ** 63 and more are decimals; their bytes are those of a negative long
    d = c.cast("decimal(20,0)")
    half = F.lit(str(1 << 63)).cast("decimal(20,0)")
    low = F.when(d >= half, (d - half).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))).otherwise(d.cast("bigint"))
    return F.unhex(F.lpad(F.hex(low), 16, "0"))


def double_key(x: float) -> bytes:
    """-0.0 is 0.0, all NaN are one and come last."""
    if x != x:
        bits = 0x7FF8000000000000
    else:
        (bits,) = struct.unpack(">Q", struct.pack(">d", x + 0.0))
    return struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))


def encode_double(c: Column) -> Column:
    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else double_key(x) for x in values.to_pylist()], pa.binary())

    return encode(c.cast("double"))


def fold_text(s: str) -> str:
    """Case folded and canonically decomposed, so that equivalents are one key."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", s).casefold())


def fold(c: Column) -> Column:
    """``fold_text`` of a column. ASCII alone never leaves the JVM's fast path in its result;
    the Arrow function gets null for such rows and so no text to fold."""

    @F.arrow_udf("string")
    def beyond_ascii(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fold_text(x) for x in values.to_pylist()], pa.string())

    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(beyond_ascii(F.when(~ascii_only, c)))


def encode_text(c: Column) -> Column:
    """Folded UTF-8 and a zero byte, so that a prefix comes before what it begins."""
    return F.concat(F.encode(fold(c), "UTF-8"), F.lit(b"\x00"))


def encode(c: Column, type_name: str) -> Column:
    """The key bytes of one value of a type."""
    t = TYPES[type_name]
    if type_name == "BOOLEAN":
        return encode_unsigned(c.cast("int"), 1)
    if type_name == "DOUBLE":
        return encode_double(c)
    if type_name == "VARCHAR":
        return encode_text(c)
    if type_name == "VARBINARY":
        return c
    return encode_signed(c, t.width) if t.signed else encode_unsigned(c, t.width)


def encode_nullable(c: Column, type_name: str) -> Column:
    """A byte that tells null from not null before the value: nulls come first."""
    return F.when(c.isNull(), F.lit(NULL_FIRST)).otherwise(F.concat(F.lit(NOT_NULL), encode(c, type_name)))


def composite(fields: list[Field], tid: Column | None = None) -> Column:
    """The fields' keys in their order, then the tid."""
    parts = [encode_nullable(F.col(f.name), f.type) if f.nullable else encode(F.col(f.name), f.type) for f in fields]
    return F.concat(*parts, *([encode_unsigned(tid, 8)] if tid is not None else []))


def key_size(fields: list[Field]) -> int:
    """Most bytes that a key takes, tid included, as planned for."""
    return sum(TEXT_KEY_BYTES if f.type in ("VARCHAR", "VARBINARY") else TYPES[f.type].width for f in fields) + TID_BYTES


def pack_tid(page: Column, slot: Column) -> Column:
    return F.shiftleft(page.cast("bigint"), 32).bitwiseOR(slot.cast("bigint"))


def tid_page(tid: Column) -> Column:
    return F.shiftrightunsigned(tid.cast("bigint"), 32)


def tid_slot(tid: Column) -> Column:
    return tid.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))


def tid_of_key(key: Column) -> Column:
    """The tid in the last eight bytes of a key."""
    return F.conv(F.hex(F.substring(key, -8, 8)), 16, 10).cast("bigint")


def byte_swap(c: Column, width: int) -> Column:
    """A non-negative integer's bytes in the other order, as hexadecimal digits."""
    digits = F.lpad(F.hex(c.cast("bigint")), 2 * width, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])


def _unsigned(c: Column) -> Column:
    """A long's bits as an unsigned decimal."""
    d = c.cast("decimal(38,0)")
    return F.when(c < 0, d + F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(d)


def _times(c: Column, factor: int) -> Column:
    """c * factor modulo 2 ** 64 of longs, as unsigned numbers. Halves of the factor keep each
    product within a decimal's digits."""
    whole, half = F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(str(1 << 32)).cast("decimal(10,0)")
    x = _unsigned(c).cast("decimal(20,0)")
    low = x * F.lit(str(factor & 0xFFFFFFFF)).cast("decimal(10,0)") % whole
    high = x * F.lit(str(factor >> 32)).cast("decimal(10,0)") % half * half
    made = ((low + high) % whole).cast("decimal(20,0)")
    return F.when(made >= F.lit(str(1 << 63)).cast("decimal(20,0)"), (made - whole).cast("bigint")).otherwise(made.cast("bigint"))


def mix64(c: Column) -> Column:
    """The 64-bit finalizer of MurmurHash3 (public domain) of a long. Spark deals rows by its own
    hash; this one is for values that must equal others' mixing."""
    c = c.cast("bigint")
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        c = _times(c.bitwiseXOR(F.shiftrightunsigned(c, 33)), factor)
    return c.bitwiseXOR(F.shiftrightunsigned(c, 33))


def mix32(c: Column) -> Column:
    """The 32-bit finalizer of MurmurHash3 of an unsigned 32-bit number, held by a long."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")

    def times(c: Column, factor: int) -> Column:
        return (c * (factor & 0xFFFF) + F.shiftleft((c * (factor >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)

    c = c.cast("bigint").bitwiseAND(mask)
    c = times(c.bitwiseXOR(F.shiftright(c, 16)), 0x85EBCA6B)
    c = times(c.bitwiseXOR(F.shiftright(c, 13)), 0xC2B2AE35)
    return c.bitwiseXOR(F.shiftright(c, 16))


def align_up(n, to: int):
    """The next multiple of ``to``, of a number or a column."""
    return (F.ceil(n / to) * to).cast("bigint") if isinstance(n, Column) else -(-n // to) * to


def align_down(n, to: int):
    """The multiple of ``to`` at or before a number or a column's."""
    return (F.floor(n / to) * to).cast("bigint") if isinstance(n, Column) else n // to * to

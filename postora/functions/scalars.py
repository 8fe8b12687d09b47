"""Scalar functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A packed posting has 8 bits of position below its document.
POSITION_BITS, POSITION_MASK = 8, 255


def pack_posting(doc_id: Column, position: Column) -> Column:
    return F.shiftleft(doc_id.cast("long"), POSITION_BITS).bitwiseOR(position.cast("long").bitwiseAND(F.lit(POSITION_MASK)))


def packed_doc(posting: Column) -> Column:
    return F.shiftrightunsigned(posting, POSITION_BITS)


def packed_position(posting: Column) -> Column:
    return posting.bitwiseAND(F.lit(POSITION_MASK)).cast("int")


def parse_int(text: Column, radix: int = 10, offset: int = 0, length: int | None = None) -> Column:
    """A 32-bit integer in a radix from 2 to 36, after an optional minus, in `length` characters from `offset` (all that
    follow without it); null for anything else."""
    text = F.substring(text, offset + 1, length if length is not None else 2147483647) if offset or length is not None else text
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    sound = F.lower(text).rlike(f"^-?[{digits}]{{1,40}}$")
    magnitude = F.conv(F.regexp_replace(text, "^-", ""), radix, 10).try_cast("long")
    value = F.when(text.startswith("-"), -magnitude).otherwise(magnitude)
    return F.when(sound & value.between(-(1 << 31), (1 << 31) - 1), value.try_cast("int"))


def to_longs(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.when(t.rlike("^-?[0-9]+$"), t.try_cast("long")))


def to_ints(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.when(t.rlike("^-?[0-9]+$"), t.try_cast("int")))


def to_floats(texts: Column) -> Column:
    return F.transform(texts, lambda t: t.try_cast("float"))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16BE")


def utf32(text: Column) -> Column:
    return F.encode(text, "UTF-32")


def from_utf8(data: Column) -> Column:
    return F.decode(data, "UTF-8")


def is_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def code_points(text: Column) -> Column:
    return F.char_length(text)


def hex_dump(data: Column) -> Column:
    return F.lower(F.hex(data))


def popcount(n: Column) -> Column:
    return F.bit_count(n)


def trailing_zeros(n: Column) -> Column:
    """Zero bits below the lowest set bit of a long; 64 for 0."""
    n = n.cast("long")
    return F.when(n == 0, 64).when(n == F.lit(-(1 << 63)), 63).otherwise(F.bit_count(n.bitwiseAND(-n) - 1).cast("int"))


def is_power_of_two(n: Column) -> Column:
    """As of bit patterns: 0 counts too."""
    n = n.cast("long")
    return n.bitwiseAND(n - 1) == 0


def next_power_of_two(n: Column) -> Column:
    """The least power of two from n on, for n from 0 to 2**62."""
    return F.when(n <= 1, n.cast("long")).otherwise(F.pow(F.lit(2.0), F.char_length(F.bin(n.cast("long") - 1))).cast("long"))


def crc32(data: Column) -> Column:
    return F.crc32(data)


def joined(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def split_up(text: Column) -> Column:
    return F.split(text, "_")


def hashed(*parts: Column) -> Column:
    return F.hash(*parts)


def now_seconds() -> Column:
    return F.unix_timestamp()

"""Sets of small integers as arrays of 64-bit words, bit i in word i // 64, as Columns. Words beyond the last are 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postora.functions.scalars import trailing_zeros


def _word(bits: Column, at: Column) -> Column:
    return F.coalesce(F.get(bits, at.cast("int")), F.lit(0).cast("long"))


def _mask(index: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(index, F.lit(64)).cast("int"))


def _place(index: Column) -> Column:
    return F.floor(index / 64)


def empty(size: int) -> Column:
    """No member, in as many words as `size` members need."""
    return F.array_repeat(F.lit(0).cast("long"), -(-size // 64))


def get(bits: Column, index: Column) -> Column:
    return _word(bits, _place(index)).bitwiseAND(_mask(index)) != 0


def _changed(bits: Column, index: Column, change) -> Column:
    """The set with one word changed, and as many words as that needs."""
    last = F.greatest(F.size(bits) - 1, _place(index).cast("int"))
    own = lambda i: F.when(i == _place(index), change(_word(bits, i), _mask(index))).otherwise(_word(bits, i))
    return F.transform(F.sequence(F.lit(0), last), own)


def with_bit(bits: Column, index: Column) -> Column:
    return _changed(bits, index, lambda word, mask: word.bitwiseOR(mask))


def without_bit(bits: Column, index: Column) -> Column:
    return _changed(bits, index, lambda word, mask: word.bitwiseAND(F.bitwise_not(mask)))


def flipped(bits: Column, index: Column) -> Column:
    return _changed(bits, index, lambda word, mask: word.bitwiseXOR(mask))


def _joined(left: Column, right: Column, join) -> Column:
    last = F.greatest(F.size(left), F.size(right)) - 1
    return F.when(last < 0, left).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: join(_word(left, i), _word(right, i))))


def both(left: Column, right: Column) -> Column:
    return _joined(left, right, lambda x, y: x.bitwiseAND(y))


def either(left: Column, right: Column) -> Column:
    return _joined(left, right, lambda x, y: x.bitwiseOR(y))


def one_only(left: Column, right: Column) -> Column:
    return _joined(left, right, lambda x, y: x.bitwiseXOR(y))


def left_only(left: Column, right: Column) -> Column:
    return _joined(left, right, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def cardinality(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda n, word: n + F.bit_count(word))


def is_empty(bits: Column) -> Column:
    return ~F.exists(bits, lambda word: word != 0)


def intersects(left: Column, right: Column) -> Column:
    return ~is_empty(both(left, right))


def members(bits: Column) -> Column:
    """The members in order."""
    each = lambda word, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(word, b) == 1), lambda b: b + i * 64)
    return F.flatten(F.transform(bits, each))


def next_member(bits: Column, index: Column) -> Column:
    """The least member from index on, -1 without one."""
    above = F.call_function("shiftleft", F.lit(-1).cast("long"), F.pmod(index, F.lit(64)).cast("int"))
    from_here = _word(bits, _place(index)).bitwiseAND(above)
    later = F.array_min(F.transform(bits, lambda word, i: F.when((i > _place(index)) & (word != 0), i * 64 + trailing_zeros(word))))
    return F.when(from_here != 0, _place(index) * 64 + trailing_zeros(from_here)).otherwise(F.coalesce(later, F.lit(-1))).cast("int")


def previous_member(bits: Column, index: Column) -> Column:
    """The greatest member up to index, -1 without one."""
    return F.coalesce(F.array_max(F.filter(members(bits), lambda m: m <= index)), F.lit(-1)).cast("int")

"""Bit vectors as array<boolean> columns, with 64-bit words for storage. Reads outside the vector give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(n) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def zeroes(n) -> Column:
    return F.array_repeat(F.lit(False), _n(n).cast("int"))


def ones(n) -> Column:
    return F.array_repeat(F.lit(True), _n(n).cast("int"))


def empty() -> Column:
    return zeroes(0)


def extend_zeroes(v: Column, n) -> Column:
    return F.concat(v, zeroes(n))


def extend_ones(v: Column, n) -> Column:
    return F.concat(v, ones(n))


def push(v: Column, bit) -> Column:
    return F.concat(v, F.array(_n(bit).cast("boolean")))


def get(v: Column, i) -> Column:
    return F.get(v, _n(i).cast("int"))


def put(v: Column, i, bit) -> Column:
    """v with bit i set; unchanged when i is outside."""
    return F.transform(v, lambda x, k: F.when(k == _n(i), _n(bit).cast("boolean")).otherwise(x))


def append_bits(v: Column, bits, n: int) -> Column:
    """v followed by the n (up to 64) low bits of a number, lowest first."""
    return F.concat(v, F.array(*(F.getbit(_n(bits).cast("long"), F.lit(k)).cast("boolean") for k in range(n))))


def get_bits(v: Column, i, n: int) -> Column:
    """Bits i to i+n-1 (n up to 64) as a number, lowest first; null when not all are inside."""
    at = _n(i).cast("int")
    parts = [F.when(F.get(v, at + k), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(n)]
    value = parts[0] if parts else F.lit(0).cast("long")
    for p in parts[1:]:
        value = value.bitwiseOR(p)
    return F.when((at >= 0) & (at + n <= F.size(v)), value)


def positions(v: Column) -> Column:
    """Places of the set bits, ascending."""
    return F.filter(F.transform(v, lambda x, k: F.when(x, k)), lambda k: k.isNotNull())


def next_one(v: Column, p) -> Column:
    """The first set bit after p; null if none."""
    return F.array_min(F.filter(positions(v), lambda k: k > _n(p)))


def prev_one(v: Column, p) -> Column:
    """The last set bit before p; null if none."""
    return F.array_max(F.filter(positions(v), lambda k: k < _n(p)))


def length(v: Column) -> Column:
    return F.size(v)


def is_empty(v: Column) -> Column:
    return F.size(v) == 0


def words(v: Column) -> Column:
    """The vector as 64-bit words, lowest bit first; the last word is padded with zeroes."""
    count = F.ceil(F.size(v) / 64).cast("int")
    return F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda w: get_bits(extend_zeroes(v, 64), w * 64, 64)))

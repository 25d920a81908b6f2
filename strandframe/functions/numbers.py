"""Column expressions on integers: zigzag, wrapping, bit widths, entropy terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unzigzag(v: Column) -> Column:
    return F.when(v % 2 == 0, F.floor(v / 2)).otherwise(-F.floor(v / 2) - 1).cast("long")


def wrapped(v: Column, bits: int) -> Column:
    """``v`` modulo 2^bits, as the unsigned number (bits at most 62)."""
    return F.pmod(v, F.lit(1 << bits))


def signed(v: Column, bits: int) -> Column:
    """The two's-complement number of ``bits`` bits that ``v`` is equal to modulo 2^bits."""
    low = wrapped(v, bits)
    return F.when(low >= (1 << bits - 1), low - (1 << bits)).otherwise(low)


def bit_width(v: Column) -> Column:
    """Bits of a non-negative number: 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v))).cast("int")


def varint_length(v: Column) -> Column:
    """Bytes of a non-negative number at seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil(bit_width(v) / 7)).cast("int")


def entropy(total: Column, weighted: Column) -> Column:
    """Shannon entropy in bits from the sum of counts and the sum of count * log2(count); nothing: 0."""
    return F.when(total > 0, F.log2(total) - weighted / total).otherwise(0.0)

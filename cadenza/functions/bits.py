"""Integers of few bits, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_extend(value: Column, bits: int) -> Column:
    """The two's complement value of the low ``bits`` bits; 0 if bits is not in 1 to 16."""
    if not 1 <= bits <= 16:
        return F.lit(0)
    low = value.bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low)


def wrap(value: Column, bits: int) -> Column:
    """Overflow as a signed integer of ``bits`` bits has it."""
    half = 1 << (bits - 1)
    return (value + half).bitwiseAND(F.lit((1 << bits) - 1)) - half


def significant_bits(delta: Column, most: int = 8) -> Column:
    """Bits from 3 to ``most`` that hold a delta and keep the code of the most negative value free."""
    size = F.abs(delta)
    out = F.lit(most)
    for bits in range(most - 1, 2, -1):
        out = F.when(size < 1 << (bits - 1), F.lit(bits)).otherwise(out)
    return out


def diag_map(value: Column) -> Column:
    """Signed to unsigned by size: 0, 1, -1, 2, -2 become 0, 1, 2, 3, 4."""
    return F.when(value > 0, 2 * value - 1).otherwise(-2 * value)


def diag_unmap(value: Column) -> Column:
    return F.when(value % 2 == 1, (value + 1) / 2).otherwise(-value / 2).cast("int")

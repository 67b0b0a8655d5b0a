"""Conversions between PCM sample types, as column expressions.

Integer targets shift; float targets divide by the positive full scale; float
sources are clamped to -1 to 1, scaled and cut towards zero.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_SCALE = {8: 127, 16: 32767, 24: 8388607, 32: 2147483647}


def full_scale(kind: str) -> float:
    """The positive full scale of a sample type by its Spark name; 1 for floating types."""
    return {"tinyint": 127.0, "smallint": 32767.0, "int": 2147483647.0}.get(kind, 1.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def to_int16(x: Column, bits: int) -> Column:
    """Signed integers of 16, 24 (clamped) or 32 bits to 16."""
    if bits == 24:
        x = clamp(x, -8388608, 8388607)
    return F.shiftright(x, bits - 16) if bits > 16 else x


def from_int16(x: Column, bits: int) -> Column:
    """16 bits to signed integers of 16, 24 or 32."""
    return F.shiftleft(x, bits - 16) if bits > 16 else x


def to_float(x: Column, bits: int) -> Column:
    return x / F.lit(float(FULL_SCALE[bits]))


def from_float(x: Column, bits: int) -> Column:
    """A float sample to signed integers; what exceeds full scale saturates."""
    return (clamp(x.cast("double"), -1.0, 1.0) * FULL_SCALE[bits]).cast("long")


def to_unsigned_byte(x: Column, scaled: bool = False) -> Column:
    """16 bits to the unsigned bytes of 8-bit files: clamped, or with ``scaled`` shifted."""
    return (F.shiftright(x, 8) if scaled else clamp(x, -128, 127)) + 128


def from_unsigned_byte(x: Column, scaled: bool = False) -> Column:
    return F.shiftleft(x - 128, 8) if scaled else x - 128


def to_signed_byte(x: Column) -> Column:
    return clamp(x, -128, 127)


def float_to_unsigned_byte(x: Column) -> Column:
    return (clamp(x.cast("double"), -1.0, 1.0) * 127).cast("int") + 128


def signed_to_unsigned(x: Column, bits: int) -> Column:
    return x + (1 << (bits - 1))


def rounded_int16(x: Column) -> Column:
    """Half to even, then clamped, as the resampled files are written."""
    return clamp(F.bround(x * 32767), -32768, 32767).cast("int")

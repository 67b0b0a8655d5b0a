"""Block scaling to 8 or 12 bits, on arrays of samples, inside Catalyst.

A block's scale is its peak in 16-bit units over 128, at least 1 and kept in a
byte; a value is the sample over scale + 1, cut towards zero.  The peak is
taken in wide integers, so -32768 counts, and values are clamped, so they
never wrap.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a 12-bit value for one of 8 bits.
FINER = 2047 / 127


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))


def scale(samples: Column, full: float = 32767.0) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(255), F.shiftright((peak(samples) / full * 32767).cast("int"), 7)))


def beside(values: Column, by: Column) -> Column:
    """A block's scale once for each of its values: worked out once, where a lambda would do so for every value."""
    return F.array_repeat(by, F.size(values))


def scaled(samples: Column, by: Column, full: float = 32767.0, bits: int = 8) -> Column:
    """Values of 8 or 12 bits of samples whose scale is ``by``."""
    most = 127 if bits == 8 else 2047

    def value(x: Column, s: Column) -> Column:
        v = x.cast("double") * ((F.lit(32767.0) / full) / (s + 1))
        return F.greatest(F.lit(-most - (bits == 8)), F.least(F.lit(most), (v if bits == 8 else v * FINER).cast("int")))

    return F.zip_with(samples, beside(samples, by), value)


def unscaled(values: Column, by: Column, full: float = 32767.0, bits: int = 8) -> Column:
    """Samples, as doubles, of values."""

    def sample(q: Column, s: Column) -> Column:
        factor = (s + 1) * full / 32767.0
        return q * factor if bits == 8 else q * factor / FINER

    return F.zip_with(values, beside(values, by), sample)


def quantized(blocks: DataFrame, column: str = "samples", full: float = 32767.0, bits: int = 8) -> DataFrame:
    """Adds the block's scale ``s`` and its values ``q``."""
    return blocks.withColumn("s", scale(F.col(column), full)).withColumn("q", scaled(F.col(column), F.col("s"), full, bits))

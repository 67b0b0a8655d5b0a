"""Decibels and gains, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET_LUFS, CEILING_DBTP = -16.0, -1.0


def db(ratio: Column) -> Column:
    """20 log10; minus infinity for nothing."""
    return F.when(ratio > 0, 20 * F.log10(ratio)).otherwise(F.lit(float("-inf")))


def snr_db(signal_rms: Column, residual_rms: Column) -> Column:
    """200 where there is no residual."""
    return F.when(residual_rms <= 1e-12, F.lit(200.0)).when(signal_rms <= 0, F.lit(0.0)).otherwise(20 * F.log10(signal_rms / residual_rms))


def gain_db(loudness: Column, peak: Column, target: float = TARGET_LUFS, ceiling: float = CEILING_DBTP) -> tuple[Column, Column]:
    """The gain to the target that keeps the peak under the ceiling, to 0.01 dB, and whether the peak held it back."""
    wanted = F.lit(target) - loudness
    gain = F.least(wanted, F.lit(ceiling) - peak)
    return F.round(gain, 2), gain < wanted - 1e-6

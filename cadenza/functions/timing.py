"""Frame times, sample counts and size bounds, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_BYTES, SEEK_BYTES = 64, 16


def count_frames(total: Column, rate: Column, ms: Column) -> Column:
    """Frames of ``ms`` that hold ``total`` samples; 0 if any is 0."""
    return F.when((total <= 0) | (rate <= 0) | (ms <= 0), F.lit(0)).otherwise(F.ceil(total * 1000.0 / rate / ms)).cast("long")


def pcm_index(frame: Column, total: Column, rate: Column, ms: Column) -> Column:
    """The first sample of a frame, rounded half up, at most the total."""
    return F.least(F.floor(frame * ms * rate / 1000.0 + 0.5).cast("long"), total.cast("long"))


def packets_begin(frames: Column) -> Column:
    """Where the packets start in a container."""
    return HEADER_BYTES + SEEK_BYTES * frames


def most_bytes(n: Column, coder: str) -> Column:
    """The most bytes that ``n`` samples take: scaled8, scaled12, vbr8, vbr12 or raw16."""
    return {
        "scaled8": n + 1,
        "scaled12": 2 * n + 1,
        "vbr8": F.ceil(((n - 1) * 8 + 19) / 8),
        "vbr12": F.ceil((F.greatest(n - 1, F.lit(0)) * 12 + 28) / 8),
        "raw16": 2 * n,
    }[coder].cast("long")


def resampled(n: Column, up: int, down: int) -> Column:
    """Outputs after the first ``n`` inputs of a rational resampler that starts with an output."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.floor((n * up - 1) / down) + 1).cast("long")


def resampled_between(before: Column, n: Column, up: int, down: int) -> Column:
    """Outputs of a block of ``n`` inputs after ``before`` others: no state, a difference of totals."""
    return resampled(before + n, up, down) - resampled(before, up, down)


def decimated(n: Column, by: int) -> Column:
    return F.floor(n / by).cast("long")


def seconds(n: Column, rate: Column) -> Column:
    return n / rate

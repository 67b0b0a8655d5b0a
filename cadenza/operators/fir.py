"""Decimation, expansion and rational resampling.

One closed form covers them all: output m of a filter h that goes up by L and
down by M sums h[p + L k] x[n - k] over k, with n = floor((m M + d) / L) and
p = (m M + d) mod L.  It needs no state, only the inputs shortly before, so
signals are cut into blocks of frames and each block gets the end of what is before
it: one shuffle by (stream, block), which splits long signals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.design import polyphase, prototype


@dataclass(frozen=True)
class Rational:
    """A resampler: the filter's name, up and down, and its delay in steps of the higher rate."""

    name: str
    up: int
    down: int
    delay: int = 0

    def phases(self) -> np.ndarray:
        return polyphase(np.array(prototype(self.name)), self.up) * self.up

    @property
    def history(self) -> int:
        return -(-len(prototype(self.name)) // self.up) - 1


RESAMPLERS = {
    "none": Rational("none", 1, 1),
    "decimate2": Rational("2x", 1, 2),
    "expand2": Rational("2x", 2, 1),
    "decimate4": Rational("4x", 1, 4),
    "expand4": Rational("4x", 4, 1),
    "decimate44": Rational("44100_12000", 40, 147),
    "expand44": Rational("44100_12000", 147, 40),
    "resample24": Rational("44100_24000", 80, 147, 10 * 147),
}
#: Filter ids of the container by PCM rate: (id, down, up).
BY_RATE = {48_000: (1, "decimate4", "expand4"), 44_100: (2, "decimate44", "expand44")}


def for_rate(rate: int) -> tuple[int, str, str]:
    if rate not in BY_RATE:
        raise ValueError(f"no filter for {rate} Hz; there are {sorted(BY_RATE)}")
    return BY_RATE[rate]


def pass_through(rate: int) -> tuple[int, str, str]:
    """The filter that leaves samples as they are, at any rate."""
    return 0, "none", "none"


def halved(rate: int) -> tuple[int, str, str]:
    """The 2X filter, whatever the rate."""
    return 0, "decimate2", "expand2"


def outputs(n: int, r: Rational) -> int:
    """Outputs that start at or before the last of n inputs; whole groups only when decimating by a whole number."""
    return n // r.down if r.up == 1 else (n * r.up - 1) // r.down + 1 if n else 0


#: Outputs that are worked out at a time.
OUTPUTS = 4096


def apply(x: np.ndarray, r: Rational, phases: np.ndarray, first: int, last: int, start: int = 0) -> np.ndarray:
    """Outputs first to last - 1, where x begins at input ``start`` and is zero elsewhere.

    Goes by blocks, each over the inputs that it reaches, so time and memory
    follow the outputs asked for, not the signal's length.
    """
    out = np.empty(max(0, last - first))
    taps = phases.shape[1]
    for lo in range(first, last, OUTPUTS):
        at = np.arange(lo, min(last, lo + OUTPUTS), dtype=np.int64) * r.down + r.delay
        n, p = at // r.up - start, at % r.up
        a, b = int(n[0]) - taps + 1, int(n[-1]) + 1
        own = np.zeros(b - a)
        s, e = max(a, 0), min(b, len(x))
        if s < e:
            own[s - a : e - a] = x[s:e]
        out[lo - first : lo - first + len(n)] = (own[(n - a)[:, None] - np.arange(taps)] * phases[p]).sum(axis=1)
    return out


def whole(signals: DataFrame, kind: str, column: str = "x") -> DataFrame:
    """Adds ``y``, the filtered signal, where each row holds one signal whole."""
    r = RESAMPLERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phases = r.phases()
        for b in batches:
            xs = b.column(column)
            ys = [apply(x := xs[i].values.to_numpy(zero_copy_only=False), r, phases, 0, outputs(len(x), r)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([y.tolist() for y in ys], pa.list_(pa.float64()))], names=[*b.schema.names, "y"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signals.schema)
    return signals.mapInArrow(run, f"{schema}, y array<double>")


#: Inputs of a stream that are filtered together.
BLOCK = 4096


def framed(frames: DataFrame, kind: str, block: int = BLOCK) -> DataFrame:
    """(stream, frame_idx, first, y) of frames (stream, frame_idx, pcm_start, samples) of any sizes.

    Frames that begin in the same ``block`` inputs go together.  Of those before
    it a block gets the samples that it reaches and no others, so what is
    copied follows the number of blocks, however short some frames are.
    """
    r = RESAMPLERS[kind]
    n, end, own = F.size("samples"), F.col("pcm_start") + F.size("samples"), F.floor(F.col("pcm_start") / block)
    least, most = F.greatest(own + 1, F.floor(end / block)), F.floor((end + (r.history - 1)) / block)
    reached = F.when((n > 0) & (least <= most), F.sequence(least, most)).otherwise(F.array().cast("array<bigint>"))
    copies = frames.select("stream", "frame_idx", "pcm_start", "samples", own.alias("own"), F.explode(F.concat(F.array(own), reached)).alias("block"))
    here = F.col("block") == F.col("own")
    kept = F.when(here, n).otherwise(F.least(n, r.history - F.greatest(F.lit(0), F.col("block") * block - end))).cast("int")
    parts = copies.select("stream", "block", F.when(here, F.col("frame_idx")).alias("frame_idx"), (end - kept).alias("pcm_start"), F.when(here, F.col("samples")).otherwise(F.slice("samples", n - kept + 1, kept)).alias("samples"))
    parts = parts.repartition("stream", "block").sortWithinPartitions("stream", "block", "pcm_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phases, key, tail, tail_end = r.phases(), None, np.empty(0), 0
        for b in batches:
            keys = list(zip(b.column("stream").to_pylist(), b.column("block").to_pylist(), strict=True))
            starts, sizes = (np.asarray(c, np.int64) for c in (b.column("pcm_start"), b.column("samples").value_lengths()))
            values, offsets = np.asarray(b.column("samples").flatten(), float), np.concatenate([[0], np.cumsum(sizes)])
            own, firsts = np.asarray(b.column("frame_idx").is_valid()), -(-starts * r.up // r.down)
            counts, ys = -(-(starts + sizes) * r.up // r.down) - firsts, []
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if keys[i] != key:  # else the batch before ended within the block
                    key, tail, tail_end = keys[i], np.empty(0), int(starts[i])
                lo, hi = tail_end - len(tail), max(tail_end, int((starts[i:j] + sizes[i:j]).max()))
                x = np.zeros(hi - lo)
                x[: len(tail)] = tail
                x[placed(starts[i:j] - lo, sizes[i:j])] = values[offsets[i] : offsets[j]]
                tail, tail_end = x[max(0, len(x) - r.history) :], hi
                if own[i:j].any():
                    f, c = firsts[i:j][own[i:j]], counts[i:j][own[i:j]]
                    ys.append(apply(x, r, phases, int(f[0]), int((f + c).max()), lo)[placed(f - f[0], c)])
            ends = np.concatenate([[0], np.cumsum(counts[own])])
            y = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0), *ys])))
            mask = pa.array(own)
            yield pa.RecordBatch.from_arrays([b.column("stream").filter(mask), b.column("frame_idx").filter(mask), pa.array(firsts[own]), y], names=["stream", "frame_idx", "first", "y"])

    kind_, index = (frames.schema[c].dataType.simpleString() for c in ("stream", "frame_idx"))
    return parts.mapInArrow(run, f"stream {kind_}, frame_idx {index}, first long, y array<double>")


def placed(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[i] to starts[i] + sizes[i] - 1 of all i, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def joined(signals: DataFrame, kind: str) -> DataFrame:
    """(stream, m, y) of long signals (stream, idx, x, total) by a join with the coefficients.

    Says the same as ``whole`` in relational terms; every input meets the
    outputs that it reaches, so rows grow by the filter's length over M / L.
    """
    r = RESAMPLERS[kind]
    taps = list(prototype(r.name))
    coef = F.broadcast(signals.sparkSession.createDataFrame(list(enumerate(float(c) * r.up for c in taps)), "i int, h double"))
    low = F.ceil((F.col("idx") * r.up - r.delay) / r.down)
    high = F.floor((F.col("idx") * r.up - r.delay + len(taps) - 1) / r.down)
    n_out = F.floor(F.col("total") / r.down) if r.up == 1 else F.floor((F.col("total") * r.up - 1) / r.down) + 1
    span = F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, low, F.lit(0)))
    meets = signals.withColumn("m", F.explode(span)).where(F.col("m") < n_out).withColumn("i", (F.col("m") * r.down + r.delay - F.col("idx") * r.up).cast("int"))
    return meets.join(coef, "i").groupBy("stream", "m").agg(F.sum(F.col("h") * F.col("x")).alias("y"))


#: Fixed values of the short decimator.
SHORT = (0.1, 0.25, 0.3, 0.25, 0.1)


def short_decimated(x: Column) -> Column:
    """Every fourth sample of a five-tap average that leaves out what lies beyond the array and stays normalised."""

    def one(k: Column) -> Column:
        total, share = F.lit(0.0), F.lit(0.0)
        for j, c in enumerate(SHORT):
            at = 4 * k + j
            there = at < F.size(x)
            total = total + F.when(there, F.get(x, at) * c).otherwise(0.0)
            share = share + F.when(there, F.lit(c)).otherwise(0.0)
        return total / share

    n = F.floor(F.size(x) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


def linear_expanded(x: Column) -> Column:
    """Four samples for each, on the line from the one before; the signal starts from zero."""
    return F.flatten(F.transform(x, lambda v, i: F.transform(F.array(*[F.lit(k / 4) for k in (1, 2, 3, 4)]), lambda w: F.when(i > 0, F.get(x, i - 1)).otherwise(0.0) * (1 - w) + v * w)))

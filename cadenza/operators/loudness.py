"""Programme loudness by ITU-R BS.1770 and EBU Tech 3342, for tracks and albums.

A track gives its gating blocks (400 ms, each 100 ms) and a peak; an album
pools the blocks of its tracks, in order, so its loudness is not a mean of theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.levels import gain_db

#: Fixed value of the sidecar format.
FORMAT = "WAV24"


def weighting(rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two K-weighting sections at any rate, from their analogue parameters."""
    out = []
    f, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k, vh = math.tan(math.pi * f / rate), 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    out.append((np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])))
    f, q = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f / rate)
    a0 = 1 + k / q + k * k
    out.append((np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])))
    return out


def weighted(x: np.ndarray, rate: float) -> np.ndarray:
    """K-weighted samples, by the response's FFT on zero-padded blocks (the impulse dies out in under a second)."""
    tail = int(rate)
    n = 1 << int(np.ceil(np.log2(max(2 * tail, 1 << 16))))
    z = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n)
    h = np.ones(len(z), complex)
    for b, a in weighting(rate):
        h *= np.polyval(b[::-1], z) / np.polyval(a[::-1], z)
    out = np.zeros(len(x) + n)
    step = n - tail
    for at in range(0, len(x), step):
        out[at : at + n] += np.fft.irfft(np.fft.rfft(x[at : at + step], n) * h, n)
    return out[: len(x)]


def blocks(channels: list[np.ndarray], rate: float, seconds: float = 0.4, hop: float = 0.1) -> np.ndarray:
    """Mean squares of K-weighted blocks, summed over channels."""
    size, step = round(seconds * rate), round(hop * rate)
    total = 0.0
    for c in channels:
        s = np.concatenate([[0.0], np.cumsum(weighted(np.asarray(c, float), rate) ** 2)])
        at = np.arange(0, max(0, len(c) - size + 1), step)
        total = total + (s[at + size] - s[at]) / size
    return np.atleast_1d(np.asarray(total, float)) if channels and len(channels[0]) >= size else np.empty(0)


def lufs(power) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return -0.691 + 10 * np.log10(power)


def integrated(power: np.ndarray) -> float:
    """Gated loudness: over -70 LUFS, then over 10 LU below the mean of those; -inf for silence."""
    loud = power[lufs(power) > -70]
    if not len(loud):
        return -math.inf
    loud = loud[lufs(loud) > lufs(loud.mean()) - 10]
    return float(lufs(loud.mean()))


def loudness_range(power: np.ndarray) -> float | None:
    """From the 10th to the 95th percentile of short-term loudness over -70 LUFS and 20 LU below the mean."""
    loud = power[lufs(power) > -70]
    if not len(loud):
        return None
    loud = loud[lufs(loud) > lufs(loud.mean()) - 20]
    low, high = np.percentile(lufs(loud), [10, 95])
    return float(high - low)


def true_peak(channels: list[np.ndarray]) -> float:
    """The peak in dB after fourfold oversampling by a windowed sinc."""
    t = np.arange(-48, 49) / 4
    h = np.sinc(t) * np.kaiser(len(t), 8)
    top = 0.0
    for c in channels:
        for p in range(4):
            top = max(top, float(np.abs(np.convolve(c, h[p::4])).max(initial=0.0)))
        top = max(top, float(np.abs(c).max(initial=0.0)))
    return 20 * math.log10(top) if top > 0 else -math.inf


def measured(tracks: DataFrame) -> DataFrame:
    """(album, track, rate, power, short, true_peak) of tracks with ``channels`` (arrays of samples from -1 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for i in range(b.num_rows):
                sound = [c.values.to_numpy(zero_copy_only=False) for c in b.column("channels")[i].values]
                rate = b.column("rate")[i].as_py()
                for column, x in zip(rows, (blocks(sound, rate).tolist(), blocks(sound, rate, 3.0, 1.0).tolist(), true_peak(sound)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column("album"), b.column("track"), pa.array(rows[0], pa.list_(pa.float64())), pa.array(rows[1], pa.list_(pa.float64())), pa.array(rows[2], pa.float64())], names=["album", "track", "power", "short", "true_peak"])

    return tracks.select("album", "track", "rate", "channels").mapInArrow(run, "album string, track string, power array<double>, short array<double>, true_peak double")


def albums(tracks: DataFrame) -> DataFrame:
    """(album, integrated_lufs, loudness_range_lu, true_peak_dbtp, tracks) from measured tracks, blocks pooled in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = lambda c, i: np.concatenate([np.array(x[c], float) for x in b.column("parts")[i].as_py()])  # noqa: B023, E731
            level = [integrated(flat("power", i)) for i in range(b.num_rows)]
            span = [loudness_range(flat("short", i)) for i in range(b.num_rows)]
            each = [[{"file": p["track"], "integrated_lufs": integrated(np.array(p["power"], float)), "true_peak_dbtp": p["true_peak"]} for p in b.column("parts")[i].as_py()] for i in range(b.num_rows)]
            peak = [max(t["true_peak_dbtp"] for t in e) for e in each]
            listed = pa.list_(pa.struct([("file", pa.string()), ("integrated_lufs", pa.float64()), ("true_peak_dbtp", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("album"), pa.array(level), pa.array(span, pa.float64()), pa.array(peak), pa.array(each, listed)], names=["album", "integrated_lufs", "loudness_range_lu", "true_peak_dbtp", "tracks"])

    parts = tracks.groupBy("album").agg(F.sort_array(F.collect_list(F.struct("track", "power", "short", "true_peak"))).alias("parts"))
    return parts.mapInArrow(run, "album string, integrated_lufs double, loudness_range_lu double, true_peak_dbtp double, tracks array<struct<file: string, integrated_lufs: double, true_peak_dbtp: double>>")


def sidecars(levels: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The loudness sidecar of each album; the trim of an old one is kept, 0 without one."""
    gain, capped = gain_db(F.col("integrated_lufs"), F.col("true_peak_dbtp"))
    rows = levels.withColumn("default_gain_db", gain).withColumn("peak_capped", capped)
    rows = rows.join(trims(old), "album", "left") if old is not None else rows.withColumn("trim_db", F.lit(None).cast("double"))
    return rows.select("album", F.lit(1).alias("v"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("scanned_at"), F.lit(FORMAT).alias("format"), F.lit(-16.0).alias("target_lufs"), F.lit(-1.0).alias("peak_ceiling_dbtp"), F.round("integrated_lufs", 2).alias("integrated_lufs"), F.round("true_peak_dbtp", 2).alias("true_peak_dbtp"), "default_gain_db", F.coalesce("trim_db", F.lit(0.0)).alias("trim_db"), F.round("loudness_range_lu", 2).alias("loudness_range_lu"), "peak_capped", "tracks")


def trims(old: DataFrame) -> DataFrame:
    """(album, trim_db) of old sidecars as text; what does not parse is 0."""
    return old.select("album", F.coalesce(F.get_json_object("text", "$.trim_db").try_cast("double"), F.lit(0.0)).alias("trim_db")).dropDuplicates(["album"])

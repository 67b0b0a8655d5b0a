"""The codec end to end: sound files to containers and back.

The squelch follows all samples before, so a channel is one task's work; files and channels
are independent.  Everything after it is per frame or packet.  Its three stages are
exchangeable, and each has one that passes samples through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import fir
from cadenza.operators.compressors import Compressor, Vbr, scale_of
from cadenza.operators.signals import PACKET
from cadenza.operators.squelch import THRESHOLD, squelch_array
from cadenza.sources import files


__all__ = ["Stages", "containers", "decode", "decode_channel", "encode", "encode_channel", "resample_24", "scale_of"]


@dataclass(frozen=True)
class Stages:
    """The exchangeable parts of a codec: what goes between samples and payloads.

    ``filters`` gives, for a PCM rate, the filter's id and the names of its
    decimator and expander; ``squelch`` is None for none.
    """

    compressor: Compressor = Vbr()
    filters: Callable[[int], tuple[int, str, str]] = fir.for_rate
    squelch: Callable | None = squelch_array
    threshold: float = THRESHOLD


def frame_starts(total: int, rate: int, ms: int) -> np.ndarray:
    """The first sample of every frame, and the end."""
    n = -(-total * 1000 // (rate * ms)) if total and rate and ms else 0
    return np.minimum(np.floor(np.arange(n + 1) * ms * rate / 1000 + 0.5).astype(np.int64), total)


def packed_sizes(starts: np.ndarray, r: fir.Rational) -> np.ndarray:
    """Compressed samples of each frame."""
    if r.up == 1:
        return np.diff(starts) // r.down
    return np.diff(np.array([fir.outputs(int(s), r) for s in starts]))


def encode_channel(x: np.ndarray, rate: int, ms: int, stages: Stages = Stages()) -> Iterator[tuple[int, int, int, bytes]]:
    """(frame, packet, samples, payload) of one channel of 16-bit samples."""
    _, down, _ = stages.filters(rate)
    r = fir.RESAMPLERS[down]
    if stages.squelch:
        x = np.trunc(stages.squelch(x, full=32767.0, threshold=stages.threshold)[0])
    starts = frame_starts(len(x), rate, ms)
    phases, done = r.phases(), 0
    for frame, n in enumerate(packed_sizes(starts, r).tolist()):
        if r.up == 1:
            first = int(starts[frame])
            y = fir.apply(x, fir.Rational(r.name, 1, r.down, first), phases, 0, n)  # from the frame's own first sample
        else:
            y = fir.apply(x, r, phases, done, done + n)
        done += n
        y = np.clip(np.trunc(y), -32768, 32767).astype(np.int64)
        for k in range(0, n, PACKET):
            part = y[k : k + PACKET]
            yield frame, k // PACKET, len(part), stages.compressor.compress(part)


def decode_channel(packets: list[tuple[int, int, bytes]], rate: int, total: int, ms: int, stages: Stages = Stages(), compensate: bool = False) -> np.ndarray:
    """16-bit samples from (frame, samples, payload) in order; the filters' delay stays unless ``compensate``."""
    _, down, up = stages.filters(rate)
    r, starts = fir.RESAMPLERS[up], frame_starts(total, rate, ms)
    sizes = np.zeros(max(0, len(starts) - 1), np.int64)
    parts = [np.empty(0)]
    for frame, n, payload in packets:
        parts.append(stages.compressor.decompress(payload, n))
        sizes[frame] += n
    y = np.concatenate(parts)
    out = np.zeros(total, np.int16)
    ends = np.array([fir.outputs(int(n), r) if r.down > 1 else int(n) * r.up for n in np.concatenate([[0], np.cumsum(sizes)])])
    wave = np.clip(np.trunc(fir.apply(y, r, r.phases(), 0, int(ends[-1]))), -32768, 32767).astype(np.int16)
    for frame in range(len(sizes)):
        n = min(starts[frame + 1] - starts[frame], ends[frame + 1] - ends[frame])
        out[starts[frame] : starts[frame] + n] = wave[ends[frame] : ends[frame] + n]
    if compensate:
        one = fir.RESAMPLERS[down]
        delay = round((len(fir.prototype(one.name)) - 1) / one.up)
        out = np.concatenate([out[delay:], np.zeros(min(delay, total), np.int16)])
    return out


def encode(channels: DataFrame, ms: int = 100, stages: Stages = Stages()) -> DataFrame:
    """Packets (file, frame_idx, channel, pkt_seq, comp_samples, payload) of rows (file, channel, rate, samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, channel, rate = (b.column(c)[i].as_py() for c in ("file", "channel", "rate"))
                rows = list(encode_channel(b.column("samples")[i].values.to_numpy(zero_copy_only=False), rate, ms, stages))
                cells = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.int32()), (3, pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), cells[0], pa.array([channel] * len(rows), pa.int32()), *cells[1:]], names=["file", "frame_idx", "channel", "pkt_seq", "comp_samples", "payload"])

    return channels.select("file", "channel", "rate", "samples").mapInArrow(run, files.PACKET_SCHEMA)


def decode(packets: DataFrame, headers: DataFrame, stages: Stages = Stages(), compensate: bool = False) -> DataFrame:
    """(file, channel, rate, samples) of packets and their headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.select(["pcm_sample_rate", "pcm_total_samples", "frame_ms", "parts"]).to_pylist():
                parts = [(p["frame_idx"], p["comp_samples"], p["payload"]) for p in r["parts"]]
                out.append(decode_channel(parts, r["pcm_sample_rate"], r["pcm_total_samples"], r["frame_ms"], stages, compensate))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("channel"), b.column("pcm_sample_rate").cast(pa.int32()), pa.array(out, pa.list_(pa.int16()))], names=["file", "channel", "rate", "samples"])

    parts = packets.groupBy("file", "channel").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "pkt_seq", "comp_samples", "payload"))).alias("parts"))
    met = parts.join(headers.select("file", "pcm_sample_rate", "pcm_total_samples", "frame_ms"), "file")
    return met.mapInArrow(run, "file string, channel int, rate int, samples array<smallint>")


def containers(channels: DataFrame, ms: int = 100) -> DataFrame:
    """(path, content) of container files from rows (file, channel, rate, samples)."""
    meta = channels.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("channels"), F.first("rate").alias("rate"), F.max(F.size("samples")).cast("long").alias("total"))
    ids = F.when(F.col("rate") == 48_000, 1).when(F.col("rate") == 44_100, 2).otherwise(F.raise_error(F.concat(F.lit("no filter for "), F.col("rate").cast("string"))).cast("int"))
    return files.write_container(encode(channels, ms), meta.select("file", "channels", ids.alias("filter_id"), "rate", F.lit(ms).alias("frame_ms"), "total"))


def resample_24(channels: DataFrame) -> DataFrame:
    """44.1 kHz channels (file, channel, rate, samples) at 24 kHz, rounded half to even."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = fir.RESAMPLERS["resample24"]
        phases = r.phases()
        for b in batches:
            out = []
            for i in range(b.num_rows):
                if b.column("rate")[i].as_py() != 44_100:
                    raise ValueError("44.1 kHz is wanted")
                x = b.column("samples")[i].values.to_numpy(zero_copy_only=False) / 32768
                y = fir.apply(x, r, phases, 0, -(-len(x) * r.up // r.down))
                out.append(np.clip(np.round(y * 32767), -32768, 32767).astype(np.int16))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("channel"), pa.array([24_000] * b.num_rows, pa.int32()), pa.array(out, pa.list_(pa.int16()))], names=["file", "channel", "rate", "samples"])

    return channels.select("file", "channel", "rate", "samples").mapInArrow(run, "file string, channel int, rate int, samples array<smallint>")

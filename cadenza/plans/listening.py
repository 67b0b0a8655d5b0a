"""A listening set: each sound through two codecs, with residuals, and both results side by side.

A channel goes through a codec in one task, packets and back, and is laid over
its source at the delay of least mean square; what is left is the residual.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import fir
from cadenza.operators.compressors import Vbr
from cadenza.operators.runs import VBR12
from cadenza.plans.codec import Stages, decode_channel, encode_channel
from cadenza.sources import files

#: The two codecs that are compared, and the longest delay that is tried for each.
PLAIN, FINE = (Stages(), 512), (Stages(Vbr(VBR12), fir.halved), 192)
MEASURES = "bytes long, delay int, input_rms double, residual_rms double, snr_db double, mismatches int"


def best_delay(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """The delay of y behind x, up to ``most``, of least mean square difference; the smallest of equals."""
    n = min(len(x), len(y))
    if not n:
        return 0
    size = 1 << int(np.ceil(np.log2(2 * n)))
    both = np.fft.irfft(np.conj(np.fft.rfft(x[:n], size)) * np.fft.rfft(y[:n], size), size)
    delays = np.arange(min(most, n - 1) + 1)
    left = np.cumsum(np.square(x[:n], dtype=float))[n - 1 - delays]
    right = np.cumsum(np.square(y[:n], dtype=float))
    right = right[-1] - np.concatenate([[0.0], right])[delays]
    return int(np.argmin(np.round((left + right - 2 * both[delays]) / (n - delays), 6)))


def through(channels: DataFrame, stages: Stages, most_delay: int, ms: int = 100) -> DataFrame:
    """(file, channel, bytes, delay, input_rms, residual_rms, snr_db, mismatches, decoded, residual) of rows (file, channel, rate, samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i in range(b.num_rows):
                x, rate = b.column("samples")[i].values.to_numpy(zero_copy_only=False), b.column("rate")[i].as_py()
                packets = list(encode_channel(x, rate, ms, stages))
                y = decode_channel([(f, n, p) for f, _, n, p in packets], rate, len(x), ms, stages)
                d = best_delay(x.astype(float), y.astype(float), most_delay)
                n = len(x) - d
                rest = np.zeros(len(x), np.int64)
                rest[:n] = x[:n].astype(np.int64) - y[d : d + n]
                rms = [float(np.sqrt(np.mean(np.square(v[:n], dtype=float)))) if n > 0 else 0.0 for v in (x, rest)]
                snr = 200.0 if rms[1] <= 1e-12 else 20 * np.log10(rms[0] / rms[1]) if rms[0] > 0 else 0.0
                rows.append((sum(len(p) for *_, p in packets), d, *rms, float(snr), int(len(y) != len(x)), y, np.clip(rest, -32768, 32767).astype(np.int16)))
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.int16()), pa.list_(pa.int16())]
            cells = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("channel"), *cells], names=["file", "channel", "bytes", "delay", "input_rms", "residual_rms", "snr_db", "mismatches", "decoded", "residual"])

    return channels.select("file", "channel", "rate", "samples").mapInArrow(run, f"file string, channel int, {MEASURES}, decoded array<smallint>, residual array<smallint>")


def compared(channels: DataFrame) -> DataFrame:
    """One row per channel: the measures of both codecs, the gain in SNR and the ratio of sizes, and the sounds."""
    names = [m.split()[0] for m in MEASURES.split(", ")] + ["decoded", "residual"]
    plain, fine = (through(channels, *codec).withColumnsRenamed({c: f"{k}_{c}" for c in names}) for k, codec in (("plain", PLAIN), ("fine", FINE)))
    both = channels.select("file", "channel", "rate", "samples").join(plain, ["file", "channel"]).join(fine, ["file", "channel"])
    return both.withColumn("snr_gain_db", F.col("fine_snr_db") - F.col("plain_snr_db")).withColumn("size_ratio", F.col("fine_bytes") / F.greatest(F.col("plain_bytes"), F.lit(1)))


def listening_files(rows: DataFrame) -> DataFrame:
    """(path, content): for every file its source, decoded and residual sounds and a summary, from rows of ``compared``."""
    parts = {"source": "samples", "plain_decoded": "plain_decoded", "fine_decoded": "fine_decoded", "plain_residual": "plain_residual", "fine_residual": "fine_residual"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(c).alias("x")) for k, c in parts.items()]))
    sounds = rows.select("file", "channel", "rate", each.alias("p"))
    sounds = files.write_sound(sounds.select(F.concat("file", F.lit("_"), "p.part", F.lit(".wav")).alias("file"), "channel", "rate", F.col("p.x").alias("samples")))
    line = lambda k, name: F.format_string(f"  {name}: %d bytes, SNR %.2f dB, residual RMS %.2f, delay %d samples, %d mismatches", *[F.col(f"{k}_{c}") for c in ("bytes", "snr_db", "residual_rms", "delay", "mismatches")])
    told = F.concat_ws("\n", F.format_string("channel %d: %d samples at %d Hz", "channel", F.size("samples"), "rate"), line("plain", "plain"), line("fine", "fine"), F.format_string("  SNR gain %.2f dB, size ratio %.2f", "snr_gain_db", "size_ratio"))
    texts = rows.select("file", F.struct("channel", told.alias("t")).alias("c")).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["t"]), "\n").alias("t"))
    return sounds.unionByName(texts.select(F.concat("file", F.lit("_summary.txt")).alias("path"), F.concat("t", F.lit("\n")).cast("binary").alias("content")))

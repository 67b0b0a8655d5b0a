"""Registered queries: one or more for each operator, over the driver's tables as signals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import bits, levels, names, pcm, timing
from cadenza.operators import entropy, fir, quality, runs, scaling, signals, squelch, vbr
from cadenza.plans import codec
from cadenza.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Frames in the framing queries: samples a second and milliseconds, chosen to fall between samples.
RATE, MS = 11_025, 10


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def long(df: DataFrame, column: str, name: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("idx", name))


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        sc.setCheckpointDir(found)
    return f"{found.rstrip('/')}/cadenza/{uuid.uuid4().hex}"


# Scaling, quality of scaling, squelch


def emb_blocks(spark: SparkSession, sf_dir: str, n_bits: int) -> DataFrame:
    return scaling.quantized(signals.embeddings(spark, sf_dir), "x", 1.0, n_bits)


@query
def quantize8(spark, sf_dir):
    return long(emb_blocks(spark, sf_dir, 8), "q", "q", "stream", "s")


@query
def quantize12(spark, sf_dir):
    return long(emb_blocks(spark, sf_dir, 12), "q", "q", "stream", "s")


def snr_of(spark, sf_dir, n_bits):
    blocks = emb_blocks(spark, sf_dir, n_bits).withColumn("y", scaling.unscaled(F.col("q"), F.col("s"), 1.0, n_bits))
    pairs = blocks.select("stream", F.explode(F.arrays_zip(F.col("x").alias("ref"), F.col("y").alias("dec"))).alias("p")).select("stream", "p.ref", "p.dec")
    return quality.snr(pairs, "stream").select("stream", *[F.round(c, 6).alias(c) for c in ("input_rms", "residual_rms", "snr_db")])


@query
def snr8(spark, sf_dir):
    return snr_of(spark, sf_dir, 8)


@query
def snr12(spark, sf_dir):
    return snr_of(spark, sf_dir, 12)


@query
def dequantize8(spark, sf_dir):
    out = emb_blocks(spark, sf_dir, 8).withColumn("y", scaling.unscaled(F.col("q"), F.col("s"), 1.0, 8))
    return long(out, "y", "y", "stream").withColumn("y", F.round("y", 6))


@query
def squelch_gate(spark, sf_dir):
    gated = signals.embeddings(spark, sf_dir).withColumn("y", squelch.squelched(F.col("x"), 1.0, 0.12))
    return long(gated, "y", "y", "stream").withColumn("y", F.round("y", 6))


# Frames, ticks, sizes


def frame_sizes(spark, sf_dir):
    return signals.frames(signals.prices(spark, sf_dir), RATE, MS)


@query
def frames(spark, sf_dir):
    return frame_sizes(spark, sf_dir).select("stream", "frame_idx", "pcm_start", "n_pcm", F.array_max("samples").alias("peak"), F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query
def frame_plan(spark, sf_dir):
    totals = signals.prices(spark, sf_dir).groupBy("stream").agg(F.count(F.lit(1)).alias("total"))
    return signals.frame_table(totals, RATE, MS)


def tick_table(spark, sf_dir):
    sizes = frame_sizes(spark, sf_dir).select("stream", "frame_idx", timing.decimated(F.col("n_pcm"), 4).alias("n"))
    return signals.ticks(sizes, F.col("n"))


@query
def ticks(spark, sf_dir):
    return tick_table(spark, sf_dir)


@query
def seek_lookup(spark, sf_dir):
    index = tick_table(spark, sf_dir)
    probes = index.groupBy("stream").agg((F.max(F.col("tick") + F.col("n")) - 1).alias("last")).select("stream", F.explode(F.sequence(F.lit(0).cast("long"), "last", F.lit(7).cast("long"))).alias("at"))
    return signals.seek(index, probes)


@query
def frame_lengths(spark, sf_dir):
    index = tick_table(spark, sf_dir)
    totals = index.groupBy("stream").agg(F.sum("n").alias("total"))
    return signals.frame_lengths(index, totals).select("stream", "frame_idx", "tick", "length")


@query
def rate_counts(spark, sf_dir):
    n = F.col("n")
    return spark.range(0, 3000).withColumnRenamed("id", "n").select(
        "n", timing.decimated(n, 2).alias("by2"), timing.decimated(n, 4).alias("by4"), (n * 4).alias("up4"),
        timing.resampled(n, 40, 147).alias("down44"), timing.resampled(n, 147, 40).alias("up44"), timing.resampled_between(n, F.lit(256), 40, 147).alias("next256"),
        timing.count_frames(n, F.lit(RATE), F.lit(MS)).alias("frames"), timing.packets_begin(n).alias("offset"),
    )


@query
def size_bounds(spark, sf_dir):
    n = F.col("n")
    rows = spark.range(1, 600).withColumnRenamed("id", "n")
    return rows.select("n", *[timing.most_bytes(n, c).alias(c) for c in ("scaled8", "scaled12", "vbr8", "vbr12", "raw16")], F.round(timing.seconds(n, F.lit(48_000)), 9).alias("seconds"))


# Deltas, runs, payloads


def event_packets(spark, sf_dir, coding=runs.VBR8):
    """Packets of 64 of the events, with long quiet stretches, as values ``q``."""
    s = signals.events(spark, sf_dir).withColumn("sample", F.when(F.col("idx") % 41 < 23, 0).otherwise(F.col("sample")))
    return scaling.quantized(signals.packets(s, 64), "samples", 32767.0, coding.bits).select("stream", "packet", "s", "q")


def price_packets(spark, sf_dir, coding=runs.VBR8):
    return scaling.quantized(signals.packets(signals.prices(spark, sf_dir)), "samples", 32767.0, coding.bits).select("stream", "packet", "s", "q")


KEYS = ["stream", "packet"]


def delta_rows(packets, coding):
    return runs.deltas(packets, coding).select("stream", "packet", "i", "delta", "width")


@query
def delta_width8(spark, sf_dir):
    return delta_rows(price_packets(spark, sf_dir), runs.VBR8)


@query
def delta_width12(spark, sf_dir):
    return delta_rows(price_packets(spark, sf_dir, runs.VBR12), runs.VBR12)


@query
def delta_histogram(spark, sf_dir):
    return runs.deltas(price_packets(spark, sf_dir)).groupBy("delta").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width"))


@query
def symbol_ranges(spark, sf_dir):
    symbols = runs.deltas(price_packets(spark, sf_dir)).select(bits.diag_map(F.col("delta")).alias("symbol"))
    return entropy.cumulative(symbols, "symbol")


@query
def bit_fields(spark, sf_dir):
    v = F.col("v")
    return spark.range(0, 4096).select(F.col("id").cast("int").alias("v")).select(
        "v", *[bits.sign_extend(v, k).alias(f"s{k}") for k in (3, 5, 8, 12)], bits.significant_bits(v - 2048, 12).alias("w12"), bits.significant_bits(bits.wrap(v, 8), 8).alias("w8"),
        bits.diag_map(v - 2048).alias("mapped"), bits.diag_unmap(v).alias("unmapped"), bits.wrap(v, 8).alias("wrapped"),
    )


def coded(packets, coding):
    return runs.codes(runs.deltas(packets, coding), KEYS, coding)


@query
def bitrun_codes(spark, sf_dir):
    return coded(event_packets(spark, sf_dir), runs.VBR8).select("stream", "packet", "i", "code")


@query
def silent_runs(spark, sf_dir):
    return coded(event_packets(spark, sf_dir), runs.VBR8).where("silent is not null").select("stream", "packet", "i", "silent")


@query
def payload_bits8(spark, sf_dir):
    return runs.bit_costs(runs.deltas(event_packets(spark, sf_dir), runs.VBR8), KEYS, runs.VBR8)


@query
def payload_bits12(spark, sf_dir):
    return runs.bit_costs(runs.deltas(event_packets(spark, sf_dir, runs.VBR12), runs.VBR12), KEYS, runs.VBR12)


def round_trip(packets, coding):
    checked = vbr.self_check(vbr.decompressed(vbr.compressed(packets, coding), coding))
    return checked.groupBy("stream").agg(F.count(F.lit(1)).alias("packets"), F.sum("comp_samples").alias("samples"), F.sum(F.length("payload")).alias("bytes"), F.sum("wrong").alias("wrong"), F.sum("error").cast("long").alias("error"))


@query
def vbr_roundtrip8(spark, sf_dir):
    return round_trip(event_packets(spark, sf_dir), runs.VBR8)


@query
def vbr_roundtrip12(spark, sf_dir):
    return round_trip(event_packets(spark, sf_dir, runs.VBR12), runs.VBR12)


@query
def bitrate(spark, sf_dir):
    report = quality.size_report(vbr.compressed(price_packets(spark, sf_dir)), 12_000, "stream")
    return report.select("stream", "bytes", "samples", "packets", F.round("ratio", 6).alias("ratio"), F.round("kbps", 6).alias("kbps"))


# Filters


@query
def fir4_short(spark, sf_dir):
    out = signals.embeddings(spark, sf_dir).withColumn("y", fir.short_decimated(F.col("x")))
    return long(out, "y", "y", "stream").withColumn("y", F.round("y", 6))


@query
def expand4_linear(spark, sf_dir):
    out = signals.embeddings(spark, sf_dir).withColumn("y", fir.linear_expanded(F.col("x")))
    return long(out, "y", "y", "stream").withColumn("y", F.round("y", 6))


def filtered(kind: str) -> Query:
    def run(spark, sf_dir):
        out = fir.whole(signals.embeddings(spark, sf_dir).select("stream", "x"), kind)
        return long(out, "y", "y", "stream").withColumn("y", F.round("y", 5))

    return run


FILTERED = {f"fir_{k}": k for k in fir.RESAMPLERS}
QUERIES |= {name: filtered(kind) for name, kind in FILTERED.items()}


@query
def fir_join(spark, sf_dir):
    """The 2X decimator as a relational join."""
    x = signals.embeddings(spark, sf_dir).select("stream", F.posexplode("x").alias("idx", "x"), F.size("x").alias("total"))
    return fir.joined(x, "decimate2").select("stream", F.col("m").cast("int").alias("idx"), F.round("y", 5).alias("y"))


@query
def fir_frames(spark, sf_dir):
    """The 4X decimator over frames with halos."""
    packed = signals.packets(signals.prices(spark, sf_dir), 64)
    frames_ = packed.select("stream", F.col("packet").alias("frame_idx"), (F.col("packet") * 64).cast("long").alias("pcm_start"), "samples")
    out = fir.framed(frames_, "decimate4")
    return out.select("stream", F.posexplode("y").alias("k", "y"), "first").select("stream", (F.col("first") + F.col("k")).alias("m"), F.round("y", 3).alias("y"))


# Quality


def delayed_pair(spark, sf_dir):
    """The events, and a copy 3 samples later, slightly smaller and a little off."""
    x = signals.events(spark, sf_dir).select("stream", "idx", F.col("sample").cast("double").alias("x"))
    return x, x.select("stream", (F.col("idx") + 3).alias("idx"), (F.col("x") * 0.96875 + F.col("idx") % 5).alias("x"))


@query
def best_delay(spark, sf_dir):
    return quality.best_delay(*delayed_pair(spark, sf_dir), 8).select("stream", "delay", F.round("mse", 4).alias("mse"))


@query
def best_delay_coarse(spark, sf_dir):
    return quality.best_delay_coarse(*delayed_pair(spark, sf_dir), 12).select("stream", F.col("delay").cast("int").alias("delay"), F.round("mse", 4).alias("mse"))


@query
def residual(spark, sf_dir):
    """Over all streams together, and by stream (null: all)."""
    pairs = quality.paired(*delayed_pair(spark, sf_dir), 3)
    each = quality.residual_ratio(pairs, "stream")
    whole = quality.residual_ratio(pairs).select(F.lit(None).cast("long").alias("stream"), "ratio")
    return each.unionByName(whole).select("stream", F.round("ratio", 6).alias("ratio"))


def price_pairs(spark, sf_dir):
    x = signals.prices(spark, sf_dir).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("stream")))
    return x.select("stream", "idx", "total", F.col("sample").cast("double").alias("ref"), (F.col("sample") * 0.96875 + F.col("idx") % 5).alias("dec"))


@query
def window_ratio_stats(spark, sf_dir):
    stats = quality.ratio_stats(quality.window_ratios(price_pairs(spark, sf_dir), 128, 64), "stream")
    return stats.select("stream", "windows", *[F.round(c, 6).alias(c) for c in ("mean", "peak", "median", "p99")])


def emb_long(spark, sf_dir):
    return signals.embeddings(spark, sf_dir).select("stream", F.posexplode("x").alias("place", "x"))


@query
def goertzel_bins(spark, sf_dir):
    out = quality.bins(emb_long(spark, sf_dir), ["stream"], 64.0, 64, 0, 32)
    return out.select("stream", F.col("k").cast("int").alias("k"), F.round("size", 5).alias("size"))


@query
def band_energy(spark, sf_dir):
    return quality.band_energy(emb_long(spark, sf_dir), ["stream"], 64.0, 64, 4, 12).select("stream", F.round("energy", 5).alias("energy"))


@query
def pitch_lag(spark, sf_dir):
    return quality.pitch_lag(emb_long(spark, sf_dir), ["stream"], 2, 20).select("stream", F.col("lag").cast("int").alias("lag"))


@query
def band_spill(spark, sf_dir):
    rows = emb_long(spark, sf_dir).withColumn("by", F.col("stream") % 10)
    return quality.spill_db(rows, ["by", "stream"], 64.0, 64, (24, 31), (2, 20), ["by"]).select("by", "windows", F.round("spill_db", 4).alias("spill_db"))


@query
def harmonic_ratio(spark, sf_dir):
    rows = emb_long(spark, sf_dir).withColumn("by", F.col("stream") % 10)
    lags = quality.pitch_lag(rows, ["by", "stream"], 12, 40)
    return quality.harmonic_db(rows, lags, ["by", "stream"], 64.0, 5, ["by"]).select("by", "windows", F.round("thd_db", 3).alias("thd_db"))


@query
def sweep_3db(spark, sf_dir):
    """Where the 2X cascade first falls by 3 dB, on a sweep of tones."""
    sweep = [1000, 2000, 4000, 6000, 8000, 8500, 9000, 9250, 9500, 9750, 10000, 11000, 12000]
    gains = quality.cascade_gains(spark, "decimate2", "expand2", 48_000.0, sweep)
    return quality.crossing(gains, -3.0).select(F.round("at", 1).alias("hertz"))


@query
def gain_crossing(spark, sf_dir):
    points = signals.events(spark, sf_dir).select("stream", F.col("idx").cast("double").alias("hertz"), F.col("sample").cast("double").alias("gain"))
    return quality.crossing(points, 0.0, "stream").select("stream", F.round("at", 6).alias("at"))


# Sample types, channels, gains, names


@query
def pcm_convert(spark, sf_dir):
    x = F.col("x")
    wide = spark.range(-40_000, 40_000, 7).select((F.col("id") * 53_000).alias("x"))
    small = (x / 2_200_000_000.0).alias("f")
    rows = wide.withColumn("f", small).withColumn("h", F.shiftright(F.greatest(F.least(x, F.lit(2147483647)), F.lit(-2147483648)), 16))
    return rows.select(
        "x", pcm.to_int16(F.greatest(F.least(x, F.lit(2147483647)), F.lit(-2147483648)), 32).alias("from32"), pcm.to_int16(x, 24).alias("from24"), pcm.from_int16(F.col("h"), 24).alias("to24"), pcm.from_int16(F.col("h"), 32).alias("to32"),
        F.round(pcm.to_float(F.col("h"), 16), 9).alias("float16"), pcm.from_float(F.col("f"), 16).alias("back16"), pcm.from_float(F.col("f") * 2, 24).alias("back24"), pcm.to_unsigned_byte(F.col("h")).alias("u8"),
        pcm.to_unsigned_byte(F.col("h"), True).alias("u8scaled"), pcm.from_unsigned_byte(pcm.to_unsigned_byte(F.col("h"))).alias("s16"), pcm.to_signed_byte(F.col("h")).alias("s8"), pcm.float_to_unsigned_byte(F.col("f")).alias("f8"), pcm.signed_to_unsigned(F.col("h"), 16).alias("u16"),
    )


def label_channels(spark, sf_dir):
    """All vectors of a label as channels of one stream: components as samples."""
    t = signals.embeddings(spark, sf_dir).where("label is not null")
    return t.select(F.col("label").alias("stream"), F.col("stream").alias("channel"), F.posexplode("x").alias("idx", "sample"))


@query
def mono_mixdown(spark, sf_dir):
    return signals.mono(label_channels(spark, sf_dir)).select("stream", "idx", F.round("sample", 7).alias("sample"))


@query
def channel_alignment(spark, sf_dir):
    return signals.aligned(label_channels(spark, sf_dir))


@query
def concat_tracks(spark, sf_dir):
    """Streams of the events as tracks of albums of ten."""
    tracks = signals.events(spark, sf_dir).select(F.floor(F.col("stream") / 10).alias("album"), F.col("stream").alias("track"), "idx", "sample")
    return signals.concatenated(tracks)


def loud(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return t.select(F.col("s_suppkey").alias("album"), (-30 + F.col("s_suppkey") % 25 + 0.25).cast("double").alias("loudness"), (-12 + F.col("s_suppkey") % 13).cast("double").alias("peak"))


@query
def gain_db(spark, sf_dir):
    gain, capped = levels.gain_db(F.col("loudness"), F.col("peak"))
    return loud(spark, sf_dir).select("album", gain.alias("gain_db"), capped.alias("peak_capped"))


@query
def trim_join(spark, sf_dir):
    """Albums with the trim of an earlier sidecar, 0 without one or where it doesn't parse."""
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"trim_db": '), (F.col("s_suppkey") % 7 - 3).cast("string"), F.lit(".5}"))).otherwise(F.lit("broken"))
    old = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("album"), text.alias("text"))
    from cadenza.operators.loudness import trims

    return loud(spark, sf_dir).select("album").join(trims(old), "album", "left").select("album", F.coalesce("trim_db", F.lit(0.0)).alias("trim_db"))


#: Samples a second in the loudness query, so that the tracks have many gating blocks.
LOUD_RATE = 800


@query
def album_loudness(spark, sf_dir):
    """Loudness and true peak of albums of ten streams of the prices, blocks pooled over their tracks."""
    from cadenza.operators import loudness

    whole = signals.prices(spark, sf_dir).groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("idx", "sample"))).alias("s"))
    sound = F.transform("s.sample", lambda v: v / 32768.0)
    tracks = whole.select(F.floor(F.col("stream") / 10).cast("string").alias("album"), F.col("stream").cast("string").alias("track"), F.lit(LOUD_RATE).alias("rate"), F.array(sound).alias("channels"))
    out = loudness.albums(loudness.measured(tracks))
    return out.select("album", F.size("tracks").alias("tracks"), *[F.round(c, 4).alias(c) for c in ("integrated_lufs", "true_peak_dbtp")])


def paths(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat((k % 4).cast("string"), F.lit("-"), F.lpad((k % 20).cast("string"), 2, "0"), F.lit(" Song "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lpad((k % 20).cast("string"), 2, "0"), F.lit(" Tune "), k.cast("string"))).otherwise(F.concat(F.lit("Bonus "), k.cast("string")))
    folder = F.when(k % 7 == 0, "done").otherwise("Artist")
    return t.select(F.concat(F.lit("/music/"), folder, F.lit("/A"), (k % 10).cast("string"), F.lit("/"), name, F.when(k % 5 == 0, ".WAV").when(k % 11 == 0, ".txt").otherwise(".wav")).alias("path"))


@query
def track_sort(spark, sf_dir):
    disc, number, title = names.track_key(F.col("path"))
    rows = paths(spark, sf_dir).select("path", names.parent(F.col("path")).alias("album"), disc.alias("disc"), number.alias("number"), title.alias("title"))
    order = Window.partitionBy("album").orderBy("disc", "number", "title", "path")
    return rows.withColumn("place", F.row_number().over(order))


@query
def path_filter(spark, sf_dir):
    p = F.col("path")
    rows = paths(spark, sf_dir).where(names.has_extension(p, "wav") & ~names.has_component(p, "done"))
    return rows.select("path", names.stem(p).alias("stem"), names.mirrored(p, "/music", "/out", "pkt").alias("target"))


@query
def files_left(spark, sf_dir):
    return files.without(paths(spark, sf_dir), paths(spark, sf_dir).where(names.has_component(F.col("path"), "done")))


@query
def album_folders(spark, sf_dir):
    return files.albums(paths(spark, sf_dir).where(names.has_extension(F.col("path"), "wav")))


@query
def report_numbers(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    text = F.concat(F.lit("I: -70.0 LUFS\n  I:   "), (-F.col("s_suppkey") % 30).cast("string"), F.lit(".5 LUFS\n"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("LRA: 7.8 LU"))
    return t.select("s_suppkey", names.last_number(text, "I").alias("integrated"), names.last_number(text, "LRA").alias("span"))


@query
def level_db(spark, sf_dir):
    x = signals.embeddings(spark, sf_dir).select("stream", F.explode("x").alias("x"))
    out = x.groupBy("stream").agg(quality.rms(F.col("x")).alias("r"))
    return out.select("stream", F.round(levels.db(F.col("r")), 6).alias("db"))


# Files, containers, streams


def sound_rows(spark, sf_dir):
    """Long streams of the prices as files of two channels at 48 kHz."""
    p = signals.prices(spark, sf_dir)
    whole = p.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("idx", "sample"))).alias("s"), F.count(F.lit(1)).alias("n"))
    x = F.transform("s.sample", lambda v: v.cast("smallint"))
    both = whole.withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select(F.col("stream").cast("string").alias("file"), "channel", F.lit(48_000).alias("rate"), F.when(F.col("channel") == 0, x).otherwise(F.reverse(x)).alias("samples"))


def sound_trip(form: str, n_bits: int) -> Query:
    def run(spark, sf_dir):
        rows = sound_rows(spark, sf_dir)
        back = files.read_sound(files.write_sound(rows, form, n_bits))
        met = rows.join(back.select("file", "channel", F.col("samples").alias("got"), "bits"), ["file", "channel"], "left")
        return met.select("file", "channel", F.size("samples").alias("n"), "bits", F.coalesce(F.col("samples") == F.col("got"), F.lit(False)).alias("same"))

    return run


QUERIES |= {"wav_roundtrip": sound_trip("wav", 16), "wav24_roundtrip": sound_trip("wav", 24), "aiff_roundtrip": sound_trip("aiff", 16)}


@query
def container_roundtrip(spark, sf_dir):
    """Files through the whole codec: frames and samples by file and channel, as the container tells them."""
    content = codec.containers(sound_rows(spark, sf_dir), 5)
    header, packets = files.read_container(content, "header"), files.read_container(content, "packets")
    sizes = packets.groupBy("file", "channel").agg(F.sum("comp_samples").alias("comp_samples"), (F.max("frame_idx") + 1).alias("frames"))
    decoded = codec.decode(packets, header).select("file", "channel", F.size("samples").alias("n"))
    return sizes.join(decoded, ["file", "channel"]).join(header.select("file", "channels", "pcm_sample_rate"), "file")


@query
def container_seek(spark, sf_dir):
    return files.read_container(codec.containers(sound_rows(spark, sf_dir), 5), "seek").select("file", "frame_idx", "tick")


@query
def streaming_equals_batch(spark, sf_dir):
    """Packets of the prices through a stream with state, against the same from a table: outputs and largest difference by stream."""
    from cadenza.streaming.packets import decimated_batch, decimated_stream

    folder = shared_folder(spark)
    packed = signals.packets(signals.prices(spark, sf_dir), 64).select("stream", F.col("packet").alias("seq"), F.col("samples").cast("array<double>").alias("samples"))
    packed.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(packed.schema).parquet(f"{folder}/in")
    run = decimated_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    one = spark.read.schema("stream long, seq long, first long, y array<double>").parquet(f"{folder}/out")
    two = decimated_batch(spark.read.parquet(f"{folder}/in")).withColumnsRenamed({"y": "z", "first": "first2"})
    gap = F.aggregate(F.zip_with("y", "z", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: F.greatest(s, v))
    return one.join(two, ["stream", "seq"], "full").groupBy("stream").agg(F.sum(F.size("y")).alias("outputs"), F.bool_and((F.size("y") == F.size("z")) & (F.col("first") == F.col("first2")) & (gap < 1e-6)).alias("same"))


@query
def sink_roundtrip(spark, sf_dir):
    """Files through the sink, folders kept, and back through the file source."""
    folder = shared_folder(spark).removeprefix("file:")
    files.register(spark)
    made = files.write_sound(sound_rows(spark, sf_dir).withColumn("file", F.concat(F.lit("disc"), (F.col("file").cast("long") % 3).cast("string"), F.lit("/"), "file", F.lit(".wav"))))
    made.write.format("signalfiles").mode("append").save(folder)
    back = files.read_sound(files.listed(spark, folder, "wav"))
    return back.groupBy(names.stem(F.col("file")).alias("file"), F.element_at(F.split("file", "/"), -2).alias("folder")).agg(F.count(F.lit(1)).alias("channels"), F.sum("n").alias("samples"))


@query
def ixml_roundtrip(spark, sf_dir):
    """Text that goes along with a file, in both formats."""
    rows = sound_rows(spark, sf_dir).withColumn("ixml", F.when(F.col("file").cast("long") % 2 == 0, F.concat(F.lit("<take>é "), "file", F.lit("</take>"))))
    both = [files.read_sound(files.write_sound(rows, form)).where("channel = 0").select("file", F.lit(form).alias("form"), "ixml") for form in ("wav", "aiff")]
    return both[0].unionByName(both[1])


@query
def range_coding(spark, sf_dir):
    """Deltas of packets as symbols through the range coder and back."""
    rows = runs.deltas(price_packets(spark, sf_dir)).select("stream", "packet", "i", bits.diag_map(F.col("delta")).cast("int").alias("symbol"))
    packed = rows.groupBy("stream", "packet").agg(F.sort_array(F.collect_list(F.struct("i", "symbol"))).alias("s")).select("stream", "packet", F.col("s.symbol").alias("symbols"), F.size("s").alias("n"))
    back = entropy.decoded(entropy.encoded(packed))
    return back.groupBy("stream").agg(F.count(F.lit(1)).alias("packets"), F.sum("n").alias("symbols"), F.bool_and(F.col("symbols") == F.col("decoded")).alias("same"), F.bool_and(F.aggregate("freq", F.lit(0), lambda s, v: s + v) == 4096).alias("whole"))


@query
def fir_table(spark, sf_dir):
    """The 2X filter's coefficients by phase."""
    from cadenza.operators import design

    return design.table(spark, "2x").select("filter", "phase", "tap", F.round("h", 9).alias("h"))


@query
def raw_codec(spark, sf_dir):
    """Channels through the codec with stages that pass samples through: nothing may change."""
    from cadenza.operators.compressors import Raw

    rows = sound_rows(spark, sf_dir)
    heads = rows.groupBy("file").agg(F.first("rate").cast("long").alias("pcm_sample_rate"), F.max(F.size("samples")).cast("long").alias("pcm_total_samples"), F.lit(5).alias("frame_ms"))
    stages = codec.Stages(Raw(), fir.pass_through, None)
    back = codec.decode(codec.encode(rows, 5, stages), heads, stages).select("file", "channel", F.col("samples").alias("got"))
    return rows.join(back, ["file", "channel"], "left").select("file", "channel", F.size("samples").alias("n"), F.coalesce(F.col("samples") == F.col("got"), F.lit(False)).alias("same"))


@query
def scaled_codec(spark, sf_dir):
    """Channels through block scaling to 8 bits alone, in frames of 5 ms: whether the largest error stays within two steps of the largest scale."""
    from cadenza.operators.compressors import Scaled

    rows = sound_rows(spark, sf_dir)
    heads = rows.groupBy("file").agg(F.first("rate").cast("long").alias("pcm_sample_rate"), F.max(F.size("samples")).cast("long").alias("pcm_total_samples"), F.lit(5).alias("frame_ms"))
    stages = codec.Stages(Scaled(), fir.pass_through, None)
    back = codec.decode(codec.encode(rows, 5, stages), heads, stages).select("file", "channel", F.col("samples").alias("got"))
    off = F.zip_with("samples", "got", lambda a, b: F.abs(a.cast("int") - b.cast("int")))
    return rows.join(back, ["file", "channel"]).select("file", "channel", F.size("got").alias("n"), (F.array_max(off) < F.array_max("samples") / 64 + 3).alias("close"))


@query
def listening(spark, sf_dir):
    """Both codecs of the listening set side by side, by file and channel."""
    from cadenza.plans.listening import compared

    rows = compared(sound_rows(spark, sf_dir))
    return rows.select("file", "channel", "plain_bytes", "fine_bytes", "plain_delay", "fine_delay", *[F.round(c, 4).alias(c) for c in ("plain_snr_db", "fine_snr_db", "snr_gain_db", "size_ratio")], "plain_mismatches", "fine_mismatches")


@query
def flagship(spark, sf_dir):
    """Encoding of all vectors to payloads: bytes, ratio to 8-bit scaled and SNR by label."""
    blocks = emb_blocks(spark, sf_dir, 8)
    packed = vbr.decompressed(vbr.compressed(blocks.select("stream", "label", "x", "s", "q")))
    y = scaling.unscaled(F.col("q2"), F.col("s2"), 1.0, 8)
    power = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    each = packed.withColumn("y", y).select("label", "comp_samples", F.length("payload").alias("b"), power(F.col("x")).alias("p"), power(F.zip_with("x", "y", lambda a, b: a - b)).alias("e"))
    out = each.groupBy("label").agg(F.count(F.lit(1)).alias("packets"), F.sum("b").alias("bytes"), F.sum("comp_samples").alias("samples"), F.sum("p").alias("p"), F.sum("e").alias("e"))
    return out.select("label", "packets", "bytes", F.round((F.col("samples") + F.col("packets")) / F.col("bytes"), 6).alias("ratio"), F.round(10 * F.log10(F.col("p") / F.col("e")), 4).alias("snr_db"))

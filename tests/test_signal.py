"""Operators on signals: hand-derived vectors, invariants, tones, files and streams."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.functions import bits, levels, timing
from cadenza.operators import design, entropy, fir, loudness, quality, runs, scaling, signals, squelch, vbr
from cadenza.operators.runs import VBR8, VBR12
from cadenza.plans import codec
from cadenza.sources import container, files, sound


def q8(x):
    s = codec.scale_of(np.array(x))
    return s, np.trunc(np.array(x) / (s + 1)).astype(int)


def test_vectors():
    s, q = q8([0] * 256)
    assert vbr.encode(q, s).hex(" ") == "01 00 49 92 24 49 92 24"
    assert vbr.encode(np.zeros(512, int), 1, VBR12).hex() == "010000" + "11" * 16
    s, q = q8([1000])
    assert vbr.encode(q, s).hex(" ") == "07 7d"
    s, q = q8([1000, 1008, 1016, 1008])
    assert vbr.encode(q, s).hex(" ") == "07 7d 0f 08 f8 07"
    assert vbr.decode(vbr.encode(np.array([-28, 100, 100]), 1), 3)[1].tolist() == [-28, 101, 100]
    # The top value has no higher one: it goes one lower instead.
    assert vbr.decode(vbr.encode(np.array([-1, 127, 127]), 1), 3)[1].tolist() == [-1, 126, 127]


def test_column_vectors(spark):
    row = spark.range(1).select(
        F.array(*[bits.significant_bits(F.lit(d)) for d in (0, 3, -4, 4, 7, 8, -128)]).alias("widths"),
        F.array(*[bits.diag_map(F.lit(v)) for v in (0, 1, -1, 2, -2)]).alias("mapped"),
        F.array(*[timing.resampled(F.lit(n), 40, 147) for n in (1, 3, 4, 147, 148)]).alias("counts"),
        F.array(*[timing.pcm_index(F.lit(k), F.lit(24_000), F.lit(48_000), F.lit(100)) for k in range(6)]).alias("starts"),
        timing.count_frames(F.lit(24_000), F.lit(48_000), F.lit(100)).alias("frames"), timing.most_bytes(F.lit(256), "vbr8").alias("most"),
        *[c.alias(n) for n, c in zip(("g", "capped", "g2", "capped2"), [*levels.gain_db(F.lit(-20.0), F.lit(-6.0)), *levels.gain_db(F.lit(-20.0), F.lit(-3.0))], strict=True)],
    ).first()
    assert row.widths == [3, 3, 4, 4, 4, 5, 8] and row.mapped == [0, 1, 2, 3, 4]
    assert row.counts == [1, 1, 2, 40, 41] and row.starts == [0, 4800, 9600, 14400, 19200, 24000]
    assert (row.frames, row.most) == (5, 258)
    assert (row.g, row.capped, row.g2, row.capped2) == (4.0, False, 2.0, True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(-100, 100), st.integers(-3, 3)), min_size=1, max_size=256), st.sampled_from([VBR8, VBR12]))
def test_round_trip_is_lossless_without_end_marks(values, c):
    q = np.array(values) * (1 if c.bits == 8 else 10)
    d = vbr.wrapped(np.diff(q), c.bits)
    payload = vbr.encode(q, 7, c)
    s, back = vbr.decode(payload, len(q), c)
    # A silent end may cost an end mark and a code over the stated bound.
    assert s == 7 and len(payload) <= -(-(len(q) * c.bits + c.head_bits + 2 * c.code_bits) // 8)
    if not (d == -(1 << (c.bits - 1))).any():
        assert back.tolist() == q.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0, 1 / 127]), min_size=1, max_size=64), st.sampled_from([VBR8, VBR12]))
def test_no_value_is_off_by_more_than_one(values, c):
    top = (1 << (c.bits - 1)) - 1
    q = np.round(np.array(values) * top).astype(int)
    assert np.abs(vbr.decode(vbr.encode(q, 7, c), len(q), c)[1] - q).max() <= 1


def test_bad_payloads():
    with pytest.raises(ValueError):
        vbr.encode(np.empty(0, int), 1)
    with pytest.raises(ValueError):
        vbr.decode(b"\x01", 4)
    with pytest.raises(ValueError):
        vbr.decode(b"\x01\x00\x07", 40)
    with pytest.raises(ValueError):
        vbr.decode(b"\x01\x00\x00\xff", 4, VBR12)


def test_windows_and_bitstream_agree(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(30):
        q = np.cumsum(rng.integers(-3, 4, 200)) * rng.integers(0, 2, 200).repeat(1) if k % 2 else rng.integers(-127, 128, 100)
        q[rng.integers(0, 60) : rng.integers(60, 100)] = 0
        rows.append((k, 0, 3, [int(np.clip(v, -127, 127)) for v in q]))
    rows += [(50, 0, 1, [5]), (51, 0, 1, [0] * 40), (52, 0, 1, [1, *[0] * 30, 2]), (53, 0, 1, [-28, 100, 100, -28])]
    packets = spark.createDataFrame(rows, "stream int, packet int, s int, q array<int>")
    costs = {r.stream: r.bytes for r in runs.bit_costs(runs.deltas(packets), ["stream", "packet"]).collect()}
    for r in vbr.compressed(packets).collect():
        assert len(r.payload) == costs.get(r.stream, 2), r.stream


def test_scaling_never_wraps(spark):
    df = spark.createDataFrame([(1, [-32768, 32767, 0]), (2, [0, 0]), (3, [100, -100])], "stream int, samples array<int>")
    for r in scaling.quantized(df).collect():
        assert all(-128 <= v <= 127 for v in r.q) and 1 <= r.s <= 255
    empty = scaling.quantized(df.where("stream = 2")).first()
    assert (empty.s, empty.q) == (1, [0, 0])


def test_squelch_fold_equals_loop(spark):
    x = (np.sin(np.arange(300) / 7) * np.where(np.arange(300) % 100 < 40, 0.5, 1e-4)).tolist()
    y = spark.createDataFrame([(x,)], "x array<double>").select(squelch.squelched(F.col("x")).alias("y")).first().y
    one, a, g = squelch.squelch_array(x[:111])
    two, *_ = squelch.squelch_array(x[111:], a, g)
    assert np.allclose(y, np.concatenate([one, two]), atol=1e-12)


def test_filter_specifications():
    four = design.response(np.array(design.prototype("4x")), 48_000, 5_500, 6_500)
    assert four["stop_db"] >= 60 and four["ripple_db"] <= 0.5
    two = design.response(np.array(design.prototype("2x")), 48_000, 8_500, 12_000)
    assert two["stop_db"] >= 85 and two["ripple_db"] < 0.02
    rational = design.response(np.array(design.prototype("44100_12000")), 1_764_000, 5_500, 6_500)
    assert rational["stop_db"] >= 55 and rational["deviation_db"] <= 0.3
    assert len(design.prototype("44100_12000")) == 5880
    assert design.polyphase(np.arange(7), 3).tolist() == [[0, 3, 6], [1, 4, 0], [2, 5, 0]]


def test_decimation_matches_convolution():
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    for kind in ("decimate2", "decimate4", "expand2", "expand4", "decimate44", "expand44"):
        r = fir.RESAMPLERS[kind]
        up = np.zeros(len(x) * r.up)
        up[:: r.up] = x * r.up
        want = np.convolve(up, design.prototype(r.name))[:: r.down]
        got = fir.apply(x, r, r.phases(), 0, fir.outputs(len(x), r))
        assert np.allclose(got, want[: len(got)], atol=1e-9)


def test_blocks_of_any_size_give_the_same_outputs(spark):
    x = signals.tone(spark, 1000, 48_000, 440).withColumn("stream", F.lit(1))
    r = fir.RESAMPLERS["decimate44"]
    whole = fir.apply(np.array([v.sample for v in x.orderBy("idx").collect()]), r, r.phases(), 0, fir.outputs(1000, r))
    for size in (50, 147, 300):
        packed = signals.packets(x, size).select("stream", F.col("packet").alias("frame_idx"), (F.col("packet") * size).cast("long").alias("pcm_start"), "samples")
        parts = fir.framed(packed, "decimate44", size).orderBy("first").collect()
        assert np.allclose(np.concatenate([p.y for p in parts]), whole, atol=1e-6)


def plan_rows(df, node):
    """Rows out of the nodes of that name in the plan that has run."""
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName() == node:
            rows += p.metrics().apply("numOutputRows").value()
        inner = {"executedPlan": "AdaptiveSparkPlan", "plan": "QueryStage"}
        todo += [getattr(p, f)() for f, name in inner.items() if name in p.getClass().getSimpleName()]
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows


@pytest.mark.parametrize("kind", ["decimate4", "decimate44", "expand4", "none"])
def test_frames_of_uneven_sizes_are_not_copied_over_and_over(spark, kind):
    """One short packet, or a large one, makes no more copies of the others; arrow batches may end anywhere."""
    from cadenza.streaming.packets import decimated_batch

    rng, r = np.random.default_rng(7), fir.RESAMPLERS[kind]
    sizes = {1: [64] * 200 + [1], 2: [1] * 300 + [9000, 0, 3, 5000, 128], 3: [5], 4: rng.integers(0, 400, 60).tolist(), 5: [4095, 1, 1, 4096, 4096, 2]}
    parts = {k: [rng.integers(-99, 99, n).astype(float) for n in v] for k, v in sizes.items()}
    rows = [(k, i, x.tolist()) for k, v in parts.items() for i, x in enumerate(v)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = decimated_batch(spark.createDataFrame(rows, "stream long, seq long, samples array<double>"), kind)
        got = {(g.stream, g.seq): g for g in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for k, v in parts.items():
        x, end = np.concatenate(v), 0
        want = fir.apply(x, r, r.phases(), 0, -(-len(x) * r.up // r.down))
        for i, part in enumerate(v):
            start, end = end, end + len(part)
            first = -(-start * r.up // r.down)
            assert got[k, i].first == first and len(got[k, i].y) == -(-end * r.up // r.down) - first, (k, i)
            assert np.allclose(got[k, i].y, want[first : first + len(got[k, i].y)], atol=1e-9), (k, i)
    assert len(rows) <= plan_rows(out, "Generate") <= 2 * len(rows)


def test_tone_through_the_rational_filter():
    n, rate = 147 * 80, 44_100
    x = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(n) / rate)
    down, up = fir.RESAMPLERS["decimate44"], fir.RESAMPLERS["expand44"]
    y = fir.apply(x, down, down.phases(), 0, fir.outputs(n, down))
    z = fir.apply(y, up, up.phases(), 0, fir.outputs(len(y), up))
    assert len(y) == n * 40 // 147 and len(z) == n
    assert min(np.sqrt(np.mean((x[2000 : n - 400] - z[2000 + d : n - 400 + d]) ** 2)) for d in range(400)) < 0.05


@pytest.mark.parametrize("rate", [48_000, 44_100])
def test_codec_on_a_tone(spark, rate):
    n = rate // 2
    x = np.trunc(16000 * np.sin(2 * np.pi * 440 * np.arange(n) / rate)).astype(np.int16)
    rows = spark.createDataFrame([("a", 0, rate, x.tolist()), ("a", 1, rate, (x // 2).tolist())], "file string, channel int, rate int, samples array<smallint>")
    content = codec.containers(rows)
    h = files.read_container(content, "header").first()
    assert (h.channels, h.filter_id, h.pcm_sample_rate, h.frame_ms, h.pcm_total_samples, h.codec_id, h.compressed_rate) == (2, 1 if rate == 48_000 else 2, rate, 100, n, 1, 12_000)
    assert h.compressed_total_samples == 6000 and h.seek_entry_count == 5
    packets = files.read_container(content, "packets")
    assert packets.where("channel = 0 and frame_idx = 1").orderBy("pkt_seq").select("comp_samples").toPandas().comp_samples.tolist() == [256, 256, 256, 256, 176]
    back = codec.decode(packets, files.read_container(content, "header")).where("channel = 0").first().samples
    y = np.array(back, float)
    assert min(np.sqrt(np.mean((x[1000:-2000] - y[1000 + d : n - 2000 + d]) ** 2)) for d in range(1000)) < 800
    shifted = np.array(codec.decode(packets, files.read_container(content, "header"), compensate=True).where("channel = 0").first().samples, float)
    assert np.sqrt(np.mean((x[1000:-2000] - shifted[1000:-2000]) ** 2)) < 1500


@pytest.mark.parametrize(("form", "n_bits", "floating"), [("wav", 8, False), ("wav", 16, False), ("wav", 24, False), ("wav", 32, False), ("wav", 32, True), ("aiff", 8, False), ("aiff", 16, False), ("aiff", 24, False), ("aiff", 32, False), ("aiff", 32, True)])
def test_sound_files(form, n_bits, floating):
    rng = np.random.default_rng(n_bits)
    top = 1 << (n_bits - 1)
    data = [rng.uniform(-1, 1, 77).astype(np.float32).astype(float) if floating else rng.integers(-top, top, 77) for _ in range(3)]
    s = sound.Sound(44_100, n_bits, data, floating, "<x/>")
    raw = (sound.write_wav if form == "wav" else sound.write_aiff)(s)
    back = sound.parse(raw)
    assert (back.rate, back.bits, back.floating, back.ixml) == (44_100, n_bits, floating, "<x/>")
    assert all(np.array_equal(a, b) for a, b in zip(data, back.channels, strict=True))
    assert len(raw) % 2 == 0


def test_sample_conversion():
    assert sound.Sound(1, 24, [np.array([1_000_000])]).as_int16()[0].tolist() == [3906]
    assert sound.Sound(1, 32, [np.array([0, 16000 << 16, -16000 << 16])]).as_int16()[0].tolist() == [0, 16000, -16000]
    assert sound.Sound(1, 32, [np.array([2.0, -0.5])], True).as_int16()[0].tolist() == [32767, -16383]


@pytest.mark.parametrize("raw", [b"", b"RIFF", b"RIFF\0\0\0\0WAVE", b"FORM\0\0\0\0AIFFxxxx", b"junkjunkjunkjunk"])
def test_bad_sound_files(spark, raw):
    with pytest.raises(sound.SoundError):
        sound.parse(raw)
    df = spark.createDataFrame([("p", raw), ("q", None)], "path string, content binary")
    assert [r.error is not None for r in files.read_sound(df).collect()] == [True, True]


def test_container_checks():
    packets = [container.Packet(f, c, 0, 4, bytes([1, 0, 1])) for f in range(3) for c in range(2)]
    raw = container.assemble(2, 1, 48_000, 5, 48, packets)
    h = container.read_header(raw)
    assert (len(raw), h.seek_entry_count, h.compressed_total_samples) == (64 + 48 + 6 * 8, 3, 12)
    assert [t for t, _ in container.read_seek(raw, h)] == [0, 4, 8]
    assert container.read_packets(raw, h) == packets and container.read_packets(raw, h, 1, 2) == packets[2:4]
    for bad in (raw[:60], b"X" + raw[1:], raw[:-1], raw[:8] + b"\0" + raw[9:]):
        with pytest.raises(container.ContainerError):
            container.read_packets(bad, container.read_header(bad))
    assert len(container.plain_header(True, 48_000, 1024)) == 8


def test_data_sources(spark, tmp_path):
    files.register(spark)
    packets = [container.Packet(f, 0, 0, 4, bytes([1, 0, 1])) for f in range(5)]
    rows = spark.createDataFrame([(f"{k}.pkt", container.assemble(1, 1, 48_000, 5, 80, packets)) for k in range(3)], "path string, content binary")
    rows.write.format("signalfiles").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0.pkt", "1.pkt", "2.pkt"]
    load = lambda part: spark.read.format("signal").option("part", part).load(str(tmp_path))
    assert load("header").count() == 3 and load("seek").where("frame_idx >= 2 and frame_idx < 4").count() == 6
    assert load("packets").where("frame_idx = 3").count() == 3
    assert files.read_container(files.listed(spark, str(tmp_path), "PKT"), "packets").count() == 15
    with pytest.raises(Exception, match="0.pkt|1.pkt|2.pkt"):
        rows.write.format("signalfiles").mode("append").save(str(tmp_path))
    rows.write.format("signalfiles").mode("overwrite").save(str(tmp_path))


def test_loudness():
    rate = 48_000
    t = np.arange(rate * 5) / rate
    tone = 0.5 * np.sin(2 * np.pi * 997 * t)
    power = loudness.blocks([tone], rate)
    assert abs(loudness.integrated(power) - (-3.01 - 6.02)) < 0.1
    assert abs(loudness.integrated(loudness.blocks([tone, tone], rate)) - (-6.02)) < 0.1
    assert abs(loudness.integrated(np.concatenate([power, np.full(200, 1e-9)])) - loudness.integrated(power)) < 0.01  # silence is gated
    assert loudness.integrated(loudness.blocks([np.zeros(rate)], rate)) == -math.inf
    assert abs(loudness.true_peak([0.5 * np.sin(2 * np.pi * rate / 4 * t[:4000] + np.pi / 4)]) - (-6.02)) < 0.3
    steps = np.concatenate([loudness.blocks([tone * g], rate, 3.0, 1.0) for g in (1, 0.1)])
    assert abs(loudness.loudness_range(steps) - 20) < 2


def test_album_sidecars(spark):
    rate = 8000
    tone = lambda g: (g * np.sin(2 * np.pi * 997 * np.arange(rate) / rate)).tolist()
    rows = [("A", "02 b.wav", rate, [tone(0.1)]), ("A", "01 a.wav", rate, [tone(0.5)]), ("B", "x.wav", rate, [tone(0.25)])]
    tracks = loudness.measured(spark.createDataFrame(rows, "album string, track string, rate int, channels array<array<double>>"))
    old = spark.createDataFrame([("A", '{"trim_db": 1.5}'), ("C", "broken")], "album string, text string")
    out = {r.album: r for r in loudness.sidecars(loudness.albums(tracks), old).collect()}
    assert [t.file for t in out["A"].tracks] == ["01 a.wav", "02 b.wav"]
    assert (out["A"].trim_db, out["B"].trim_db, out["A"].v) == (1.5, 0.0, 1)
    assert abs(out["B"].integrated_lufs - (-3.01 - 12.04)) < 0.3
    assert out["A"].default_gain_db == round(min(-16 - out["A"].integrated_lufs, -1 - out["A"].true_peak_dbtp), 2) or abs(out["A"].default_gain_db - (-16 - out["A"].integrated_lufs)) < 0.02


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=400))
def test_range_coder(values):
    table = entropy.AdaptiveTable()
    for v in values:
        table.update(v, 8)
    freq = table.frequencies()
    assert freq.sum() == 4096 and freq.min() >= 1
    data = entropy.encode(np.array(values, int), freq)
    assert entropy.decode(data, len(values), freq).tolist() == values


def test_prior_counts():
    prior = entropy.geometric_prior()
    assert prior.sum() == 4096 and prior.min() >= 1 and (np.diff(prior) <= 0).all()


def test_seek_and_lengths(spark):
    index = spark.createDataFrame([(1, 0, 0), (1, 1, 10), (1, 2, 25)], "stream int, frame_idx int, tick long")
    probes = spark.createDataFrame([(1, 0), (1, 9), (1, 10), (1, 99)], "stream int, at long")
    assert {r["at"]: r.frame_idx for r in signals.seek(index, probes).collect()} == {0: 0, 9: 0, 10: 1, 99: 2}
    totals = spark.createDataFrame([(1, 30)], "stream int, total long")
    assert [r.length for r in signals.frame_lengths(index, totals).orderBy("frame_idx").collect()] == [10, 15, 5]


def test_best_delay_of_silence_is_the_lowest(spark):
    z = spark.range(20).select(F.lit(1).alias("stream"), F.col("id").alias("idx"), F.lit(0.0).alias("x"))
    assert quality.best_delay(z, z, 5).first().delay == 0


def test_resampling_to_24k(spark):
    x = np.trunc(10000 * np.sin(2 * np.pi * 500 * np.arange(4410) / 44_100)).astype(int)
    out = codec.resample_24(spark.createDataFrame([("a", 0, 44_100, x.tolist())], "file string, channel int, rate int, samples array<smallint>")).first()
    want = 10000 * np.sin(2 * np.pi * 500 * np.arange(len(out.samples)) / 24_000)
    assert out.rate == 24_000 and len(out.samples) == 2400
    assert np.abs(np.array(out.samples)[200:-200] - want[200:-200]).max() < 60


def test_stream_resets_and_waits_for_early_packets(spark, tmp_path):
    from cadenza.streaming.packets import decimated_stream

    rng = np.random.default_rng(4)
    parts = [rng.integers(-9, 9, 40).astype(float).tolist() for _ in range(4)]
    rows = [(1, 1, parts[1]), (1, 0, parts[0]), (1, 2, []), (1, 3, parts[0]), (2, 0, parts[3])]
    spark.createDataFrame(rows, "stream long, seq long, samples array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream long, seq long, samples array<double>").parquet(str(tmp_path / "in"))
    q = decimated_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.stream, r.seq): r.y for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    r = fir.RESAMPLERS["decimate4"]
    want = fir.apply(np.array(parts[0] + parts[1]), r, r.phases(), 0, 20)
    assert np.allclose(got[(1, 0)] + got[(1, 1)], want) and np.allclose(got[(1, 3)], want[:10]) and (2, 0) in got


@pytest.mark.parametrize("timed", [False, True])
def test_stream_gives_up_lost_packets(spark, tmp_path, timed):
    """Packet 2 never comes: with too many waiting, or once the watermark has passed, the rest goes on without it."""
    import datetime

    from cadenza.streaming.packets import decimated_stream

    start = datetime.datetime(2024, 1, 1)
    rows = [(1, s, [float(s + 1)] * 40, start + datetime.timedelta(seconds=s)) for s in (0, 1, 3, 4, 5)] + [(1, 1, [9.0] * 40, start)]
    schema = "stream long, seq long, samples array<double>, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    if timed:  # another stream's later packet moves the watermark
        spark.createDataFrame([(2, 0, [1.0] * 40, start + datetime.timedelta(hours=1))], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = decimated_stream(stream if timed else stream.drop("ts"), late="1 minute", most_early=256 if timed else 2)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {r.seq: r for r in spark.read.parquet(str(tmp_path / "out")).where("stream = 1").collect()}
    assert sorted(got) == [0, 1, 3, 4, 5]
    r = fir.RESAMPLERS["decimate4"]
    assert got[3]["first"] == 0 and np.allclose(got[3].y, fir.apply(np.full(40, 4.0), r, r.phases(), 0, 10))


def test_levels_by_minute(spark):
    from cadenza.streaming.packets import levels_by_minute

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 20) AS ts, 1 AS stream, cast(id - 2 AS double) AS x FROM range(6)")
    out = levels_by_minute(rows).orderBy("window").collect()
    assert [(r.peak, r.n, round(r.rms, 6)) for r in out] == [(2.0, 3, round(math.sqrt(5 / 3), 6)), (3.0, 3, round(math.sqrt(14 / 3), 6))]


def test_sink_keeps_folders_and_refuses_doubles(spark, tmp_path):
    files.register(spark)
    rows = spark.createDataFrame([("A/01 x.wav", b"1"), ("B/01 x.wav", b"2"), ("file:/C/y.wav", b"3")], "path string, content binary")
    rows.write.format("signalfiles").mode("append").save(str(tmp_path / "one"))
    found = {str(p.relative_to(tmp_path / "one")): p.read_bytes() for p in (tmp_path / "one").rglob("*") if p.is_file()}
    assert found == {"A/01 x.wav": b"1", "B/01 x.wav": b"2", "C/y.wav": b"3"}
    for bad in ([("a", b"1"), ("a", b"2")], [("../a", b"1")]):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame(bad, "path string, content binary").write.format("signalfiles").mode("append").save(str(tmp_path / "two"))
    assert not [p for p in (tmp_path / "two").rglob("*") if p.is_file()]


def test_range_reads_see_the_wanted_frames_only(spark, tmp_path):
    x = (np.sin(np.arange(48_000) / 9) * 9000).astype(int).tolist()
    content = codec.containers(spark.createDataFrame([("a", c, 48_000, x) for c in (0, 1)], "file string, channel int, rate int, samples array<smallint>"), 20).first().content
    path = tmp_path / "a.pkt"
    path.write_bytes(content)
    with open(path, "rb") as f:
        h, table, part, base = container.read_part(f, 10, 12)
    assert len(part) == table[12][1] - table[10][1] < len(content) / 10
    assert container.read_packets(part, h, 10, 12, table, base) == container.read_packets(content, h, 10, 12)
    files.register(spark)
    load = spark.read.format("signal").option("part", "packets").option
    assert {r.frame_idx for r in load("low", 10).option("high", 12).load(str(tmp_path)).collect()} == {10, 11}
    rows = spark.read.format("signal").option("part", "packets").load(str(tmp_path))
    assert {r.frame_idx for r in rows.where("frame_idx >= 10 and frame_idx < 12").collect()} == {10, 11}
    assert rows.count() == len(container.read_packets(content, h))


def test_a_short_sound_chunk_is_an_error_row(spark):
    good = sound.write_aiff(sound.Sound(8000, 16, [np.arange(4)]))
    at = good.index(b"SSND")
    bad = good[: at + 4] + (2).to_bytes(4, "big") + b"\0\0"
    row = files.read_sound(spark.createDataFrame([("a", bad)], "path string, content binary")).first()
    assert row.error and row.samples is None
    floats = files.read_sound(spark.createDataFrame([("a", good)], "path string, content binary"), floats=True).first()
    assert np.allclose(floats.samples, np.arange(4) / 32768)


def test_a_long_channel_takes_linear_time():
    import time

    from cadenza.plans.codec import Stages, decode_channel, encode_channel

    took = []
    for seconds in (5, 20):
        x = (np.sin(np.arange(48_000 * seconds) / 30) * 8000).astype(np.int16)
        began = time.process_time()
        packets = list(encode_channel(x, 48_000, 100, Stages(squelch=None)))
        y = decode_channel([(f, n, p) for f, _, n, p in packets], 48_000, len(x), 100, Stages(squelch=None))
        took.append(time.process_time() - began)
        assert len(y) == len(x)
    assert took[1] < 8 * took[0]


def test_listening_set(spark):
    from cadenza.plans import listening

    x = (np.sin(2 * np.pi * 440 * np.arange(24_000) / 48_000) * 9000).astype(int).tolist()
    rows = listening.compared(spark.createDataFrame([("t", 0, 48_000, x)], "file string, channel int, rate int, samples array<smallint>"))
    r = rows.first()
    assert r.fine_snr_db > r.plain_snr_db > 15 and r.snr_gain_db == r.fine_snr_db - r.plain_snr_db and r.size_ratio > 1
    assert 120 <= r.plain_delay <= 135 and 120 <= r.fine_delay <= 135
    made = {f.path: bytes(f.content) for f in listening.listening_files(rows).collect()}
    assert sorted(made) == ["t_fine_decoded.wav", "t_fine_residual.wav", "t_plain_decoded.wav", "t_plain_residual.wav", "t_source.wav", "t_summary.txt"]
    assert sound.parse(made["t_source.wav"]).channels[0].tolist() == x and b"size ratio" in made["t_summary.txt"]


def test_album_levels(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    nested = paths("/m/A/B/1.wav", "/m/A/B/2.wav", "/m/A/3.wav", "/m/.h/B/4.wav", "/m/A/B/C/5.wav")
    names = lambda df: sorted(r.album for r in df.collect())
    assert names(files.albums(nested)) == ["/m/A", "/m/A/B", "/m/A/B/C"]
    assert names(files.albums(nested, "/m", False)) == ["/m/A/B"]
    assert names(files.albums(paths("/m/1.wav", "/m/A/B/2.wav"), "/m/", False)) == ["/m"]

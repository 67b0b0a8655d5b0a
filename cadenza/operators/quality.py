"""How a decoded signal differs from its source, and what is in the difference.

Signals are long: (stream, idx, x) or, for a pair, (stream, idx, ref, dec).
All measures are sums over rows, so partial aggregation does most of the work
before a shuffle; lags are summed up by block, and bins are small tables that are broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.levels import snr_db


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def paired(ref: DataFrame, dec: DataFrame, delay: Column | int = 0) -> DataFrame:
    """(stream, idx, ref, dec) where the decoded signal lags by ``delay`` (a number, or a column of ref)."""
    later = ref.select("stream", "idx", F.col("x").alias("ref"), (F.col("idx") + delay).alias("_at"))
    return later.join(dec.select("stream", F.col("idx").alias("_at"), F.col("x").alias("dec")), ["stream", "_at"]).drop("_at")


def snr(pairs: DataFrame, *keys: str) -> DataFrame:
    """Input and residual RMS and their ratio in dB, by keys."""
    off = F.col("ref") - F.col("dec")
    out = pairs.groupBy(*keys).agg(rms(F.col("ref")).alias("input_rms"), rms(off).alias("residual_rms"))
    return out.withColumn("snr_db", snr_db(F.col("input_rms"), F.col("residual_rms")))


def residual_ratio(pairs: DataFrame, *keys: str) -> DataFrame:
    """RMS of the error over RMS of the source; null on silence."""
    out = pairs.groupBy(*keys).agg(rms(F.col("ref")).alias("r"), rms(F.col("dec") - F.col("ref")).alias("e"))
    return out.select(*keys, F.when(F.col("r") > 0, F.col("e") / F.col("r")).alias("ratio"))


#: Samples of a block in the search for a delay, at least; a block is at least as long as the range of lags.
BLOCK = 4096


def lag_errors(ref: DataFrame, dec: DataFrame, lags: range) -> DataFrame:
    """(stream, d, s, n): the sum of squared differences at each lag, and how many pairs have it.

    A signal is cut into blocks, and the other goes to the two or three that
    its samples can meet; a block sums up all lags and sends one row for each.
    """
    least, most = lags[0], lags[-1]
    size = max(BLOCK, most - least)
    # New names for the columns: both signals may come from one table.
    own = ref.where("x is not null").select(F.col("stream").alias("stream"), F.col("idx").alias("idx"), F.col("x").cast("double").alias("x"), F.floor(F.col("idx") / size).alias("block"))
    reach = F.sequence(F.floor((F.col("idx") - most) / size), F.floor((F.col("idx") - least) / size))
    other = dec.where("x is not null").select(F.col("stream").alias("stream"), F.col("idx").alias("idx"), F.col("x").cast("double").alias("x"), F.explode(reach).alias("block"))
    kind = ref.schema["stream"].dataType.simpleString()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"stream": a["stream"][:0], "d": pa.array([], pa.int32()), "s": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        start = a["block"][0].as_py() * size
        x, y = np.zeros(size), np.zeros(size + most - least)
        here, there = np.zeros(size, bool), np.zeros(len(y), bool)
        for t, values, known, first in ((a, x, here, start), (b, y, there, start + least)):
            at = t["idx"].to_numpy() - first
            ok = (at >= 0) & (at < len(values))
            values[at[ok]], known[at[ok]] = t["x"].to_numpy()[ok], True
        sums, counts = [], []
        for d in lags:
            part = slice(d - least, d - least + size)
            both = here & there[part]
            off = x[both] - y[part][both]
            sums.append(float(off @ off))
            counts.append(int(both.sum()))
        return pa.table({"stream": pa.concat_arrays([a["stream"].combine_chunks()[:1]] * len(lags)), "d": pa.array(list(lags), pa.int32()), "s": pa.array(sums), "n": pa.array(counts, pa.int64())})

    blocks = own.groupBy("stream", "block").cogroup(other.groupBy("stream", "block")).applyInArrow(run, f"stream {kind}, d int, s double, n long")
    return blocks.groupBy("stream", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")


def best_delay(ref: DataFrame, dec: DataFrame, most: int, least: int = 0, step: int = 1) -> DataFrame:
    """(stream, delay, mse): the lag of least mean squared difference; the lowest on ties.

    A signal has a sample at most once at each index, and may have gaps; samples pair where both are.
    """
    best = F.min(F.struct((F.col("s") / F.col("n")).alias("mse"), "d"))
    return lag_errors(ref, dec, range(least, most + 1, step)).groupBy("stream").agg(best.alias("b")).select("stream", F.col("b.d").alias("delay"), F.col("b.mse").alias("mse"))


def best_delay_coarse(ref: DataFrame, dec: DataFrame, most: int) -> DataFrame:
    """The same over -most to most in two passes: coarse steps, then one by one around the best."""
    step = max(1, min(32, most // 256))
    rough = best_delay(ref, dec, most, -most, step).select("stream", F.col("delay").alias("near"))
    moved = ref.join(rough, "stream").select("stream", (F.col("idx") + F.col("near")).alias("idx"), "x")
    fine = best_delay(moved, dec, step, -step)
    return fine.join(rough, "stream").select("stream", (F.col("near") + F.col("delay")).alias("delay"), "mse")


def hops(rows: DataFrame, size: int, hop: int, total: str = "total") -> DataFrame:
    """Rows with every window ``w`` that holds them whole: windows start each ``hop`` and end within ``total``."""
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / hop)).cast("int")
    last = F.least(F.floor(F.col("idx") / hop), F.floor((F.col(total) - size) / hop)).cast("int")
    fits = rows.withColumn("_first", first).withColumn("_last", last).where(F.col("_first") <= F.col("_last"))
    return fits.withColumn("w", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def window_ratios(pairs: DataFrame, size: int, hop: int, quiet: float = 1e-3) -> DataFrame:
    """(stream, w, ratio) of windows that are not quiet; pairs have a ``total``."""
    out = hops(pairs, size, hop).groupBy("stream", "w").agg(rms(F.col("ref")).alias("r"), rms(F.col("dec") - F.col("ref")).alias("e"))
    return out.where(F.col("r") >= quiet).select("stream", "w", (F.col("e") / F.col("r")).alias("ratio"))


def ratio_stats(ratios: DataFrame, *keys: str) -> DataFrame:
    """Mean, peak, median and 99th percentile (linear between ranks)."""
    r = F.col("ratio")
    return ratios.groupBy(*keys).agg(F.count(r).alias("windows"), F.avg(r).alias("mean"), F.max(r).alias("peak"), F.percentile(r, 0.5).alias("median"), F.percentile(r, 0.99).alias("p99"))


def magnitude(x: Column, place: Column, hertz: Column, rate: float) -> Column:
    """The size of one frequency in a group of rows; 0 outside 0 to half the rate."""
    turn = 2 * math.pi * hertz * place / rate
    size = F.sqrt(F.sum(x * F.cos(turn)) ** 2 + F.sum(x * F.sin(turn)) ** 2)
    inside = (F.max(hertz) > 0) & (F.max(hertz) < rate / 2)
    return F.when(inside, size).otherwise(0.0)


def bins(rows: DataFrame, keys: list[str], rate: float, n: int, low: float, high: float) -> DataFrame:
    """(keys, k, size): the spectrum at bin centres k * rate / n from low to high; rows have ``place`` and ``x``."""
    width = rate / n
    high = min(high, rate / 2 - 1)
    ks = F.explode(F.sequence(F.lit(math.ceil(max(low, 0) / width)), F.lit(math.floor(high / width))))
    spread = rows.withColumn("k", ks)
    return spread.groupBy(*keys, "k").agg(magnitude(F.col("x"), F.col("place"), F.col("k") * width, rate).alias("size"))


def band_energy(rows: DataFrame, keys: list[str], rate: float, n: int, low: float, high: float) -> DataFrame:
    """(keys, energy): squared sizes of the bins of a band."""
    return bins(rows, keys, rate, n, low, high).groupBy(*keys).agg(F.sum(F.col("size") ** 2).alias("energy"))


def pitch_lag(rows: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """(keys, lag): the lag of greatest autocorrelation in windows of rows (``place``, ``x``); the first on ties."""
    window = Window.partitionBy(*keys).orderBy("place")
    lagged = rows.select(*keys, *[(F.col("x") * F.lead("x", d).over(window)).alias(f"l{d}") for d in range(max(1, least), most + 1)])
    sums = lagged.groupBy(*keys).agg(*[F.sum(f"l{d}").alias(f"l{d}") for d in range(max(1, least), most + 1)])
    options = F.array(*[F.struct(F.col(f"l{d}").alias("c"), F.lit(-d).alias("d")) for d in range(max(1, least), most + 1)])
    return sums.select(*keys, (-F.array_max(F.filter(options, lambda o: o["c"].isNotNull()))["d"]).alias("lag"))


def spill_db(rows: DataFrame, keys: list[str], rate: float, n: int, guard: tuple[float, float], inner: tuple[float, float], by: list[str]) -> DataFrame:
    """The mean over windows of energy in the guard band over the inner one, in dB, by ``by``; -200 if there is none."""
    ratio = band_energy(rows, keys, rate, n, *guard).withColumnRenamed("energy", "g").join(band_energy(rows, keys, rate, n, *inner), keys).where("energy > 1e-18")
    out = ratio.groupBy(*by).agg(F.avg(F.col("g") / F.col("energy")).alias("m"), F.count(F.lit(1)).alias("windows"))
    return out.select(*by, "windows", (10 * F.log10(F.greatest(F.col("m"), F.lit(1e-18)))).alias("spill_db"))


def harmonic_db(rows: DataFrame, lags: DataFrame, keys: list[str], rate: float, harmonics: int, by: list[str]) -> DataFrame:
    """The mean over windows of harmonics 2 and up over the fundamental at the pitch, in dB, by ``by``."""
    pitched = rows.join(lags, keys).where((F.col("lag") > 0) & (rate / F.col("lag") * harmonics < rate / 2))
    spread = pitched.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(harmonics))))
    sizes = spread.groupBy(*keys, "h").agg(magnitude(F.col("x"), F.col("place"), F.col("h") * rate / F.col("lag"), rate).alias("size"))
    fund = F.max(F.when(F.col("h") == 1, F.col("size")))
    power = F.sum(F.when(F.col("h") > 1, F.col("size") ** 2))
    ratio = sizes.groupBy(*keys).agg(fund.alias("f"), power.alias("p")).where("f >= 1e-9")
    out = ratio.groupBy(*by).agg(F.avg(F.sqrt("p") / F.col("f")).alias("m"), F.count(F.lit(1)).alias("windows"))
    return out.select(*by, "windows", (20 * F.log10(F.greatest(F.col("m"), F.lit(1e-12)))).alias("thd_db"))


def crossing(points: DataFrame, level: float, *keys: str) -> DataFrame:
    """(keys, at): where ``gain`` over ``hertz`` first falls below a level, on the line between two points.

    With keys each has a window of its own.  Without, the points are one curve
    and aggregates find it: the first point below the level that a point at or
    above it comes before, and the last point before that one.
    """
    between = lambda f, g, hertz, gain: f + (g - level) / (g - gain) * (hertz - f)
    if keys:
        order = Window.partitionBy(*keys).orderBy("hertz")
        steps = points.withColumn("_f", F.lag("hertz").over(order)).withColumn("_g", F.lag("gain").over(order))
        hits = steps.where((F.col("_g") >= level) & (F.col("gain") < level))
        at = between(F.col("_f"), F.col("_g"), F.col("hertz"), F.col("gain"))
        return hits.groupBy(*keys).agg(F.min_by(at, F.col("hertz")).alias("at"))
    rows = points.where("hertz is not null and gain is not null").select("hertz", "gain")
    above = F.broadcast(rows.where(F.col("gain") >= level).agg(F.min("hertz").alias("_a")))  # one row
    low = F.broadcast(rows.where(F.col("gain") < level).join(above, F.col("hertz") > F.col("_a")).agg(F.min_by(F.struct("hertz", "gain"), "hertz").alias("_b")))  # one row
    last = rows.join(low, F.col("hertz") < F.col("_b.hertz")).agg(F.max_by(F.struct("hertz", "gain"), "hertz").alias("_l"), F.first("_b").alias("_b"))
    return last.where("_l is not null").select(between(F.col("_l.hertz"), F.col("_l.gain"), F.col("_b.hertz"), F.col("_b.gain")).alias("at"))


def size_report(packets: DataFrame, rate: int, *keys: str) -> DataFrame:
    """Bytes, ratio to 8-bit scaled, and kilobits a second of packets with payloads."""
    out = packets.groupBy(*keys).agg(F.sum(F.length("payload")).alias("bytes"), F.sum("comp_samples").alias("samples"), F.count(F.lit(1)).alias("packets"))
    return out.withColumn("ratio", (F.col("samples") + F.col("packets")) / F.col("bytes")).withColumn("kbps", F.col("bytes") * 8 / (F.col("samples") / rate) / 1000)


def cascade_gains(spark, down: str, up: str, rate: float, hertz: list[float], n: int = 8192, amplitude: float = 0.5, skip: int = 512) -> DataFrame:
    """(hertz, gain): steady sines through a decimator and its expander, output over input RMS in dB."""
    from cadenza.operators.fir import whole

    tones = spark.createDataFrame([(float(f),) for f in hertz], "hertz double").withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: amplitude * F.sin(2 * math.pi * F.col("hertz") * i / rate)))
    through = whole(whole(tones, down).select("hertz", F.col("x").alias("input"), F.col("y").alias("x")), up)
    level = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v) / F.size(a))
    cut = lambda c: F.slice(c, skip + 1, F.size("y") - skip)
    return through.select("hertz", (20 * F.log10(F.greatest(level(cut("y")), F.lit(1e-12)) / level(cut("input")))).alias("gain"))

"""Signals in tables, their frames and packets.

Long form is (stream, idx, sample); packed form has an array of samples per
frame or packet.  A packet has at most 256 samples, so packing is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import timing

PACKET = 256


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, label, x): every vector as a float signal of its components."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("stream"), "label", F.col("embedding").cast("array<double>").alias("x"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, idx, sample): each user's values in order of time, around 50, as 16 bits."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    level = ((F.col("value") - 50) * 64).cast("long")
    return t.select(F.col("user_id").alias("stream"), (F.row_number().over(at) - 1).cast("long").alias("idx"), F.greatest(F.lit(-32767), F.least(F.lit(32767), level)).cast("int").alias("sample"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, idx, sample): each supplier's prices in order of shipping, as 16 bits."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return t.select(F.col("l_suppkey").alias("stream"), (F.row_number().over(at) - 1).cast("long").alias("idx"), (F.col("l_extendedprice") / 4).cast("int").alias("sample"))


def packets(pcm: DataFrame, size: int = PACKET, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """(keys, packet, samples): runs of ``size`` samples by index, each one array."""
    numbered = pcm.withColumn("packet", F.floor(F.col("idx") / size).cast("int"))
    packed = numbered.groupBy(*keys, "packet").agg(F.sort_array(F.collect_list(F.struct("idx", "sample"))).alias("s"))
    return packed.select(*keys, "packet", F.col("s.sample").alias("samples"))


def frame_table(totals: DataFrame, rate: int, ms: int) -> DataFrame:
    """(..., frame_idx, pcm_start, n_pcm) for every frame of signals with a ``total``."""
    total, r, m = F.col("total"), F.lit(rate), F.lit(ms)
    n = timing.count_frames(total, r, m)
    every = totals.withColumn("frame_idx", F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    start = timing.pcm_index(F.col("frame_idx"), total, r, m)
    end = F.when(F.col("frame_idx") + 1 >= n, total).otherwise(timing.pcm_index(F.col("frame_idx") + 1, total, r, m))
    return every.withColumn("pcm_start", start).withColumn("n_pcm", (end - start).cast("long"))


def frames(pcm: DataFrame, rate: int, ms: int) -> DataFrame:
    """(stream, frame_idx, pcm_start, n_pcm, samples): a frame's index follows from a sample's, so nothing is joined."""
    size = rate * ms / 1000.0
    guess = F.floor((F.col("idx") + 0.5) / size).cast("int")
    start = lambda k: F.floor(k * size + 0.5)
    frame = F.when(F.col("idx") < start(guess), guess - 1).when(F.col("idx") >= start(guess + 1), guess + 1).otherwise(guess)
    packed = pcm.withColumn("frame_idx", frame).groupBy("stream", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("idx", "sample"))).alias("s"))
    return packed.select("stream", "frame_idx", F.col("s.idx")[0].alias("pcm_start"), F.size("s").cast("long").alias("n_pcm"), F.col("s.sample").alias("samples"))


def ticks(frame_sizes: DataFrame, samples: Column, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Adds ``tick``, the compressed samples before each frame."""
    before = Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    return frame_sizes.withColumn("tick", F.coalesce(F.sum(samples).over(before), F.lit(0)).cast("long"))


def seek(index: DataFrame, probes: DataFrame) -> DataFrame:
    """The frame that holds each probe (stream, at): the last whose tick is not after it.

    Probes and ticks are laid into one order per stream, so no range join is needed.
    """
    marks = index.select("stream", F.col("tick").alias("at"), F.lit(0).alias("kind"), "frame_idx").unionByName(probes.select("stream", "at", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("frame_idx")))
    so_far = Window.partitionBy("stream").orderBy("at", "kind", "frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("frame_idx", F.last("frame_idx", ignorenulls=True).over(so_far)).where("kind = 1").select("stream", "at", "frame_idx")


def frame_lengths(index: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds the length in ticks of each frame: the next tick less its own, the last up to ``total``."""
    following = Window.partitionBy("stream").orderBy("frame_idx")
    joined = index.join(totals, "stream")
    return joined.withColumn("length", F.coalesce(F.lead("tick").over(following), F.col("total")) - F.col("tick"))


def aligned(pcm: DataFrame) -> DataFrame:
    """Whether all channels of each stream have the same number of samples."""
    sizes = pcm.groupBy("stream", "channel").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("stream").agg((F.count_distinct("n") == 1).alias("aligned"), F.max("n").alias("n"))


def mono(pcm: DataFrame) -> DataFrame:
    """The mean of the channels at each index."""
    return pcm.groupBy("stream", "idx").agg(F.avg("sample").alias("sample"))


def concatenated(tracks: DataFrame, keys: tuple[str, ...] = ("album",), order: tuple[str, ...] = ("track",)) -> DataFrame:
    """Samples of all tracks of an album under one running index, in track order."""
    sizes = tracks.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return tracks.join(starts, [*keys, *order]).withColumn("idx", F.col("idx") + F.col("start")).drop("start")


def tone(spark: SparkSession, n: int, rate: int, hertz: float, amplitude: float = 16000.0) -> DataFrame:
    """(idx, sample): a sine cut to whole numbers."""
    return spark.range(n).select(F.col("id").alias("idx"), (amplitude * F.sin(F.lit(2 * 3.141592653589793 * hertz) * F.col("id") / rate)).cast("int").alias("sample"))


def noise(spark: SparkSession, n: int, seed: int, amplitude: float = 16000.0) -> DataFrame:
    """(idx, sample): seeded white noise."""
    return spark.range(n).select(F.col("id").alias("idx"), ((F.rand(seed) * 2 - 1) * amplitude).cast("int").alias("sample"))

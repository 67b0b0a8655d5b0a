"""Command line: ``spark-submit cadenza/cli.py COMMAND ...``.

encode IN OUT    WAV and AIFF files to containers (``--frame-ms``); folders are mirrored
all IN           all WAV files of a folder (``-r``: and those below it) to containers in its folder ``--folder``,
                 whose own files are left out
decode IN OUT    containers to WAV files
resample IN OUT  44.1 kHz WAV files to 24 kHz
loudness IN      sidecars of album folders, written beside the tracks (``-r``, ``--dry-run``, ``--skip-tracks``)
listen IN OUT    a listening set: source, decoded and residual sounds of two codecs, and a summary
compare A B      residual of decoded files against their sources
design NAME OUT  the coefficient table of a filter, as Parquet, and its measured response
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.names import parent, stem
from cadenza.operators import design, loudness, quality
from cadenza.plans import codec, listening
from cadenza.sources import files

#: Fixed value: the name of a sidecar.
SIDECAR = "loudness.json"


def channels(found: DataFrame) -> DataFrame:
    rows = files.read_sound(found).where("error is null")
    return rows.select("file", "channel", "rate", "samples")


def plain(path: Column) -> Column:
    """A path without the scheme that Spark puts before it."""
    return F.regexp_replace(path, "^file:/*", "/")


def below(path: Column, root: str, extension: str | None = None) -> Column:
    """A path relative to the root, with another extension."""
    at = plain(path)
    root = "/" + root.removeprefix("file:").strip("/") + "/"
    rest = F.when(at.startswith(root), F.substr(at, F.lit(len(root) + 1))).otherwise(F.element_at(F.split(at, "/"), -1))
    return rest if extension is None else F.concat(F.regexp_replace(rest, r"\.[^./]*$", ""), F.lit("." + extension))


def named(content: DataFrame, root: str, extension: str) -> DataFrame:
    return content.select(below(F.col("path"), root, extension).alias("path"), "content")


def tracks(rows: DataFrame) -> DataFrame:
    sound = F.transform("samples", lambda x: x / 32768.0)
    whole = rows.withColumn("x", sound).groupBy("file").agg(F.first("rate").alias("rate"), F.sort_array(F.collect_list(F.struct("channel", "x"))).alias("c"))
    return whole.select(parent(F.col("file")).alias("album"), F.element_at(F.split("file", "/"), -1).alias("track"), "rate", F.col("c.x").alias("channels"))


def long(rows: DataFrame) -> DataFrame:
    return rows.select(stem(F.col("file")).alias("stream"), "channel", F.posexplode("samples").alias("idx", "x")).groupBy("stream", "idx").agg((F.avg("x") / 32768).alias("x"))


def album_sidecars(spark: SparkSession, root: str, recursive: bool, skip_tracks: bool) -> DataFrame:
    """The sidecar of every album below a folder; the trim of one that is there is kept."""
    found = files.listed(spark, root, "wav").withColumn("path", plain(F.col("path")))
    shown = files.albums(found, "/" + root.removeprefix("file:").strip("/"), recursive).select("album")
    rows = tracks(channels(found))
    old = files.listed(spark, root, "json").where(F.col("path").endswith("/" + SIDECAR)).select(parent(plain(F.col("path"))).alias("album"), F.col("content").cast("string").alias("text"))
    out = loudness.sidecars(loudness.albums(loudness.measured(rows.join(shown, "album", "left_semi"))), old)
    return out.withColumn("tracks", F.filter("tracks", lambda t: F.lit(False))) if skip_tracks else out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["encode", "all", "decode", "resample", "loudness", "listen", "compare", "design"])
    p.add_argument("source")
    p.add_argument("target", nargs="?")
    p.add_argument("--frame-ms", type=int, default=100)
    p.add_argument("--folder", default="encoded")
    p.add_argument("--most-lag", type=int, default=2000)
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--skip-tracks", action="store_true")
    p.add_argument("-y", "--overwrite", action="store_true")
    a = p.parse_args(args)
    if a.command not in ("loudness", "all") and not a.target:
        p.error("a target is needed")
    if a.command == "all" and a.target:
        p.error("all takes no target")
    spark = SparkSession.builder.appName(f"cadenza {a.command}").getOrCreate()
    files.register(spark)

    def save(content: DataFrame, target: str, overwrite: bool = a.overwrite) -> None:
        content.write.format("signalfiles").mode("overwrite" if overwrite else "append").save(target)

    if a.command == "encode":
        save(named(codec.containers(channels(files.listed(spark, a.source)), a.frame_ms), a.source, "pkt"), a.target)
    elif a.command == "all":
        found = files.listed(spark, a.source, "wav", recursive=a.recursive, skip=a.folder)
        save(named(codec.containers(channels(found), a.frame_ms), a.source, "pkt"), f"{a.source.rstrip('/')}/{a.folder}")
    elif a.command == "decode":
        found = files.listed(spark, a.source)
        save(named(files.write_sound(codec.decode(files.read_container(found, "packets"), files.read_container(found, "header"))), a.source, "wav"), a.target)
    elif a.command == "resample":
        save(named(files.write_sound(codec.resample_24(channels(files.listed(spark, a.source, "wav")))), a.source, "wav"), a.target)
    elif a.command == "loudness":
        rows = album_sidecars(spark, a.source, a.recursive, a.skip_tracks)
        text = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "album"]))
        if a.dry_run:
            rows.select("album", text.alias("sidecar")).show(truncate=False)
        else:  # the measured rows, not the files, are what is read again while sidecars are replaced
            save(rows.select(below(F.concat("album", F.lit("/" + SIDECAR)), a.source).alias("path"), text.cast("binary").alias("content")), a.source, True)
    elif a.command == "listen":
        rows = channels(files.listed(spark, a.source))
        save(listening.listening_files(listening.compared(rows.withColumn("file", F.regexp_replace(below(F.col("file"), a.source), r"\.[^./]*$", "")))), a.target)
    elif a.command == "design":
        design.table(spark, a.source).write.mode("overwrite" if a.overwrite else "error").parquet(a.target)
        phases, rate, passband, stopband = design.TABLES[a.source]
        print(design.response(design.prototype(a.source), rate, passband, stopband))
    else:
        ref, dec = long(channels(files.listed(spark, a.source))), long(channels(files.listed(spark, a.target)))
        lag = quality.best_delay_coarse(ref, dec, a.most_lag)
        quality.residual_ratio(quality.paired(ref.join(lag.select("stream", "delay"), "stream"), dec, F.col("delay")), "stream").show(truncate=False)


if __name__ == "__main__":
    main()

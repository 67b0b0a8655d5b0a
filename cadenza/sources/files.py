"""Files as DataFrames: listing, reading, a data source of frame ranges, and sinks.

``listed`` and the readers on top go through Spark's own file source, so any
store that Spark reads will do.  The data sources ``signal`` (read) and
``signalfiles`` (write) open paths in workers and are for folders that all workers mount.
"""

from __future__ import annotations

import glob
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cadenza.functions.names import has_component, has_extension, parent
from cadenza.sources import container, sound


def listed(spark: SparkSession, root: str, extension: str | None = None, recursive: bool = True, skip: str | None = None) -> DataFrame:
    """(path, length, modificationTime, content) of files, by extension in any case, without those under a folder named ``skip``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extension:  # other files aren't even listed, so their bytes are never read
        reader = reader.option("pathGlobFilter", "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension))
    files = reader.load(root)
    if extension:
        files = files.where(has_extension(F.col("path"), extension))
    if skip:
        files = files.where(~has_component(F.col("path"), skip))
    return files


def without(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose path is not among those done."""
    return files.join(done.select("path").distinct(), "path", "left_anti")


def albums(files: DataFrame, root: str | None = None, recursive: bool = True) -> DataFrame:
    """(album, tracks): folders with at least one file, none of them hidden.

    Without ``recursive`` it is ``root`` alone if it has files, else the folders two
    levels below it (artist and album).
    """
    shown = files.where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".")))
    found = shown.groupBy(parent(F.col("path")).alias("album")).agg(F.count(F.lit(1)).alias("tracks"))
    if recursive:
        return found
    if root is None:
        raise ValueError("one level needs a root")
    own = found.where(F.col("album") == root.rstrip("/"))
    two = found.where(F.col("album").startswith(root.rstrip("/") + "/") & (F.size(F.split(F.substring("album", len(root.rstrip("/")) + 2, 1 << 20), "/")) == 2))
    return own if not own.isEmpty() else two


def read_sound(files: DataFrame, scale8: bool = False, floats: bool = False) -> DataFrame:
    """(file, channel, rate, bits, n, samples, ixml, error) of WAV and AIFF files; a bad file has one row with its error.

    Samples are 16-bit integers, or with ``floats`` doubles from -1 to 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("file", pa.string()), ("channel", pa.int32()), ("rate", pa.int32()), ("bits", pa.int32()), ("n", pa.int64()), ("samples", pa.list_(pa.float64() if floats else pa.int16())), ("ixml", pa.string()), ("error", pa.string())]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    s = sound.parse(content or b"")
                    rows = [(path, k, s.rate, s.bits, len(c), c, s.ixml, None) for k, c in enumerate(s.as_float() if floats else s.as_int16(scale8))]
                except sound.SoundError as e:
                    rows = [(path, None, None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return files.select("path", "content").mapInArrow(run, f"file string, channel int, rate int, bits int, n long, samples array<{'double' if floats else 'smallint'}>, ixml string, error string")


def write_sound(channels: DataFrame, form: str = "wav", bits: int = 16) -> DataFrame:
    """(path, content) of files from rows (file, channel, rate, samples[, ixml]); ``ixml`` is text that goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rate, ixml, parts in zip(b.column("rate").to_pylist(), b.column("ixml").to_pylist(), b.column("parts"), strict=True):
                found = parts.values.field("samples")
                s = sound.Sound(rate, bits, [found[k].values.to_numpy(zero_copy_only=False).astype(np.int64) << (bits - 16) for k in range(len(found))], ixml=ixml)
                out.append(sound.write_wav(s) if form == "wav" else sound.write_aiff(s))
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(out, pa.binary())], names=["path", "content"])

    extra = F.first("ixml") if "ixml" in channels.columns else F.lit(None).cast("string")
    whole = channels.groupBy("file").agg(F.first("rate").alias("rate"), extra.alias("ixml"), F.sort_array(F.collect_list(F.struct("channel", "samples"))).alias("parts"))
    return whole.mapInArrow(run, "path string, content binary")


HEADER_SCHEMA = "file string, channels int, filter_id int, pcm_sample_rate long, frame_ms int, pcm_total_samples long, seek_entry_count long, compressed_total_samples long, codec_id int, flags int, compressed_rate long, reserved0 int"
SEEK_SCHEMA = "file string, frame_idx int, tick long, file_offset long"
PACKET_SCHEMA = "file string, frame_idx int, channel int, pkt_seq int, comp_samples int, payload binary"
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
SCHEMAS = {"header": HEADER_SCHEMA, "seek": SEEK_SCHEMA, "packets": PACKET_SCHEMA}


def rows_of(path: str, content: bytes, part: str, low: int = 0, high: int | None = None) -> Iterator[tuple]:
    """Rows of a container: its header, seek table or packets, of the frames low to high - 1."""
    h = container.read_header(content)
    if part == "header":
        yield (path, *container.header_row(h))
    elif part == "seek":
        yield from ((path, k, *entry) for k, entry in enumerate(container.read_seek(content, h)) if low <= k and (high is None or k < high))
    else:
        yield from ((path, p.frame_idx, p.channel, p.pkt_seq, p.comp_samples, p.payload) for p in container.read_packets(content, h, low, high))


def read_container(files: DataFrame, part: str = "packets") -> DataFrame:
    """The header, seek table or packets of container files, through Spark's file source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = pa.schema([(name, ARROW[kind]) for name, kind in (f.split() for f in SCHEMAS[part].split(", "))])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(rows_of(path, content, part))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(columns.names, r, strict=True)) for r in rows], schema=columns)

    # A header needs its first bytes only.
    content = F.substring("content", 1, container.HEADER_SIZE) if part == "header" else F.col("content")
    return files.select("path", content.alias("content")).mapInArrow(run, SCHEMAS[part])


def write_container(packets: DataFrame, meta: DataFrame) -> DataFrame:
    """(path, content) from packets and (file, channels, filter_id, rate, frame_ms, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                own = [container.Packet(p["frame_idx"], p["channel"], p["pkt_seq"], p["comp_samples"], p["payload"]) for p in r["parts"]]
                out.append(container.assemble(r["channels"], r["filter_id"], r["rate"], r["frame_ms"], r["total"], own))
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(out, pa.binary())], names=["path", "content"])

    parts = packets.groupBy("file").agg(F.collect_list(F.struct("frame_idx", "channel", "pkt_seq", "comp_samples", "payload")).alias("parts"))
    return parts.join(meta, "file").mapInArrow(run, "path string, content binary")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.low, self.high = int(options.get("low", 0)), int(options["high"]) if "high" in options else None

    def partitions(self):
        root = self.options["path"]
        found = sorted(glob.glob(os.path.join(root, "**", self.options.get("pattern", "*")), recursive=True)) if os.path.isdir(root) else [root]
        return [_File(p) for p in found if os.path.isfile(p)]

    def read(self, partition):
        part = self.options.get("part", "packets")
        with open(partition.path, "rb") as f:
            if part == "packets":  # the header, the seek table, and the bytes of the wanted frames
                h, table, content, base = container.read_part(f, self.low, self.high)
                found = container.read_packets(content, h, self.low, self.high, table, base)
                yield from ((partition.path, p.frame_idx, p.channel, p.pkt_seq, p.comp_samples, p.payload) for p in found)
                return
            content = f.read(container.HEADER_SIZE)
            if part == "seek":
                content += f.read(container.SEEK_SIZE * container.read_header(content).seek_entry_count)
        yield from rows_of(partition.path, content, part, self.low, self.high)


class SignalSource(DataSource):
    """``spark.read.format("signal").option("part", "header" | "seek" | "packets").load(folder)``.

    The options ``low`` and ``high`` are a range of frames, the end exclusive; only
    its bytes are read, by the seek table.  Filters are not pushed down: what one
    query pushes into a Python source, others on the same DataFrame would get too.
    """

    @classmethod
    def name(cls) -> str:
        return "signal"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "packets")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Done(WriterCommitMessage):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


def relative(path: str) -> str:
    """A row's path below the target folder: without scheme and root, and never outside."""
    out = os.path.normpath(re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", path).lstrip("/"))
    if out.split(os.sep)[0] in ("..", ".", ""):
        raise ValueError(f"no file path: {path}")
    return out


class _Writer(DataSourceWriter):
    """Writes each row's content beside its place, under a name of its own, and moves it there when the whole job commits."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, iterator):
        done = []
        for row in iterator:
            target = os.path.join(self.options["path"], relative(row["path"]))
            if os.path.exists(target) and not self.overwrite:
                raise FileExistsError(target)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(row["content"])
            done.append((part, target))
        return _Done(done)

    def commit(self, messages):
        paths = [p for m in messages for p in (m.paths if m else [])]
        twice = [t for t, n in Counter(t for _, t in paths).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several rows for {twice[0]}")
        for part, target in paths:
            os.replace(part, target)

    def abort(self, messages):
        for m in messages:
            for part, _ in m.paths if m else []:
                if os.path.exists(part):
                    os.remove(part)


class FileSink(DataSource):
    """``df.write.format("signalfiles").mode("overwrite" | "append").save(folder)`` for rows (path, content).

    Folders in a path are kept below the target.  Two rows of one path fail
    the job, as does, without "overwrite", a file that is there.
    """

    @classmethod
    def name(cls) -> str:
        return "signalfiles"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make both data sources known."""
    spark.dataSource.register(SignalSource)
    spark.dataSource.register(FileSink)

"""Deltas, bit widths, runs of codes and silent runs of packets.

Deltas and widths are array expressions.  Runs are worked out packet by packet
in workers, in time that grows with the packet alone: a position's run follows
from the nearest positions before and after it that break the run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.bits import significant_bits, wrap


@dataclass(frozen=True)
class Coding:
    """Sizes of a variable-bit-length coding; ``least`` has, by code, the run that pays off."""

    bits: int
    code_bits: int
    head_bits: int
    least: tuple[int, ...]

    @property
    def top(self) -> int:
        """The code of the widest deltas; a delta of code c has c + 1 bits."""
        return self.bits - 1


#: Fixed values of the two formats; for codes 0 and 1 the silent samples they stand for.
VBR8 = Coding(8, 3, 16, (4, 16, 13, 15, 17, 19, 21))
VBR12 = Coding(12, 4, 24, (4, 16, 15, 17, 19, 21, 23, 25, 27, 29, 31, 33))


def deltas(packets: DataFrame, coding: Coding = VBR8, values: str = "q") -> DataFrame:
    """(..., i, next, delta, width, n): the deltas of each packet's values.

    The most negative delta is the end mark of a run, so it is written one
    higher and the next delta one lower (or one lower and one higher where its
    value is the top one, which has no higher); only such packets need a fold.
    """
    q = F.col(values)
    low = -(1 << (coding.bits - 1))
    later = F.slice(q, 2, 1 << 20)
    plain = F.zip_with(later, F.slice(q, 1, F.size(q) - 1), lambda b, a: wrap(b - a, coding.bits))

    def step(state: Column, at: Column) -> Column:
        d = wrap(at["d"] + state["carry"], coding.bits)
        carry = F.when(d != low, 0).when(at["next"] == ~low, 1).otherwise(-1)
        return F.struct(carry.alias("carry"), F.concat(state["out"], F.array(F.when(d != low, d).when(at["next"] == ~low, ~low).otherwise(low + 1))).alias("out"))

    start = F.struct(F.lit(0).alias("carry"), F.array().cast("array<int>").alias("out"))  # a packet has at most 256 samples
    folded = F.when(F.array_contains("d", low), F.aggregate(F.arrays_zip(F.col("d").alias("d"), later.alias("next")), start, step, lambda s: s["out"])).otherwise(F.col("d"))
    rows = packets.withColumn("d", plain).withColumn("d", folded).withColumn("pair", F.arrays_zip(F.col("d").alias("d"), later.alias("next")))
    kept = [c for c in packets.columns if c != values]
    out = rows.select(*kept, F.size("d").alias("n"), F.posexplode("pair").alias("i", "pair"))
    return out.select(*kept, "n", "i", F.col("pair.d").alias("delta"), F.col("pair.next").alias("next")).withColumn("width", significant_bits(F.col("delta"), coding.bits))


def breaks(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest break at or before, and at or after, every position."""
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(ends, at, -1))
    after = np.minimum.accumulate(np.where(ends, at, n)[::-1])[::-1]
    return before, after


def marks(width: np.ndarray, quiet: np.ndarray, coding: Coding) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, silent, covered) of a packet's deltas, in one pass over each width.

    ``code`` is that of the narrowest run that pays off.  ``silent`` is the
    code that starts at this delta (1 for 16 samples, 0 for 4) or -1;
    ``covered`` says that a silent code covers it.
    """
    n = len(width)
    code = np.full(n, coding.top)
    for c in range(coding.top, 2, -1):
        a, b = breaks(width > c, n)
        code[(width <= c) & (b - a - 1 > coding.least[c - 1])] = c - 1
    short, long = coding.least[:2]
    a, b = breaks(~quiet, n)
    size, place = b - a - 1, np.arange(n) - a - 1
    longs = np.where(b == n, size + -size % long, size - size % long)  # samples that long codes stand for
    in_long = quiet & (place < longs)
    rest = size - longs
    in_short = quiet & ~in_long & (place - longs < rest - rest % short)
    silent = np.where(in_long & (place % long == 0), 1, np.where(in_short & ((place - longs) % short == 0), 0, -1))
    return code, silent, in_long | in_short


def lists_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d): each packet's deltas in order, as structs of delta, width and next."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "delta", "width", "next"))).alias("d"))


def packet_arrays(b: pa.RecordBatch, k: int) -> dict[str, np.ndarray]:
    d = b.column("d")[k].values
    return {c: d.field(c).to_numpy(zero_copy_only=False) for c in ("i", "delta", "width", "next")}


def codes(rows: DataFrame, keys: list[str], coding: Coding = VBR8) -> DataFrame:
    """(keys, i, delta, width, code, silent, covered) of deltas; ``silent`` is null where no silent code starts.

    A packet's deltas are few (255 at most), so they are brought together once
    and worked out in one pass in a worker.
    """
    lists = lists_of(rows, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for k in range(b.num_rows):
                x = packet_arrays(b, k)
                found = (x["i"], x["delta"], x["width"], *marks(x["width"], x["next"] == 0, coding))
                for column, values in zip(out, found, strict=True):
                    column.append(values)
            sizes = [len(c) for c in out[0]]
            pick = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            i, delta, width, code, silent, covered = (np.concatenate(c) if c else np.empty(0, int) for c in out)
            cells = [pa.array(x.astype(np.int32)) for x in (i, delta, width, code)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pick) for c in keys), *cells, pa.array(silent.astype(np.int32), mask=silent < 0), pa.array(covered.astype(bool))], names=[*keys, "i", "delta", "width", "code", "silent", "covered"])

    kinds = ", ".join(f"{c} {lists.schema[c].dataType.simpleString()}" for c in keys)
    return lists.mapInArrow(run, f"{kinds}, i int, delta int, width int, code int, silent int, covered boolean")


def bit_costs(rows: DataFrame, keys: list[str], coding: Coding = VBR8) -> DataFrame:
    """(keys, silent_codes, delta_runs, deltas_coded, bits, bytes) of each packet's deltas as coded."""
    lists = lists_of(rows, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                x = packet_arrays(b, k)
                code, silent, covered = marks(x["width"], x["next"] == 0, coding)
                own = np.where(covered, -1, code)
                first, last = (own >= 0) & (own != np.append(-1, own[:-1])), (own >= 0) & (own != np.append(own[1:], -1))
                last[-1:] = False
                bits = (code + 1)[~covered].sum() + (code + 1)[last].sum() + coding.code_bits * (first.sum() + (silent >= 0).sum()) + coding.head_bits
                out.append(((silent >= 0).sum(), first.sum(), (~covered).sum(), bits, (bits + 7) // 8))
            cells = [pa.array([int(r[k]) for r in out], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), *cells], names=[*keys, "silent_codes", "delta_runs", "deltas_coded", "bits", "bytes"])

    kinds = ", ".join(f"{c} {lists.schema[c].dataType.simpleString()}" for c in keys)
    return lists.mapInArrow(run, f"{kinds}, silent_codes long, delta_runs long, deltas_coded long, bits long, bytes long")

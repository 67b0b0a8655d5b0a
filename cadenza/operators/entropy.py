"""Adaptive symbol counts and range coding with asymmetric numeral systems (rANS).

The coder is the published byte-wise one: the state stays in [2**23, 2**31),
the encoder writes a byte while the state is at least frequency * 2**19 (for
12-bit frequencies), so encoder and decoder bounds agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRECISION, LOW = 12, 1 << 23


def geometric_prior(symbols: int = 256, first: float = 62.0, ratio: float = 0.95) -> np.ndarray:
    """Counts that fall from ``first`` to 1 and add up to 4096; what is left over goes to the low symbols."""
    raw = np.maximum(first * ratio ** np.arange(symbols), 1.0)
    out = np.maximum((raw / raw.sum() * (1 << PRECISION)).astype(int), 1)
    while (off := (1 << PRECISION) - out.sum()) != 0:
        if off > 0:
            out[: min(off, symbols)] += 1
        else:
            high = np.nonzero(out > 1)[0][off:]
            out[high] -= 1
    return out


class AdaptiveTable:
    """Counts of symbols that go up as they are seen; ``frequencies`` are scaled to 4096 with none below 1."""

    def __init__(self, symbols: int = 256):
        self.counts = geometric_prior(symbols).astype(np.int64)

    def update(self, symbol: int, by: int = 1) -> None:
        self.counts[symbol] += by

    def frequencies(self) -> np.ndarray:
        out = np.maximum(self.counts * (1 << PRECISION) // self.counts.sum(), 1)
        while (off := (1 << PRECISION) - out.sum()) != 0:
            if off > 0:
                out[out.argmax()] += off
            else:
                top = out.argmax()
                out[top] -= min(-off, out[top] - 1)
        return out


def encode(symbols: np.ndarray, freq: np.ndarray) -> bytes:
    start = np.concatenate([[0], np.cumsum(freq)])
    state, out = LOW, bytearray()
    for s in reversed(symbols.tolist()):
        f = int(freq[s])
        while state >= ((LOW >> PRECISION) << 8) * f:
            out.append(state & 255)
            state >>= 8
        state = (state // f << PRECISION) + state % f + int(start[s])
    return state.to_bytes(4, "big") + bytes(reversed(out))


def decode(data: bytes, n: int, freq: np.ndarray) -> np.ndarray:
    start = np.concatenate([[0], np.cumsum(freq)])
    of = np.repeat(np.arange(len(freq)), freq)
    state, at, out = int.from_bytes(data[:4], "big"), 4, np.empty(n, np.int64)
    for i in range(n):
        slot = state & ((1 << PRECISION) - 1)
        s = out[i] = of[slot]
        state = int(freq[s]) * (state >> PRECISION) + slot - int(start[s])
        while state < LOW and at < len(data):
            state, at = state << 8 | data[at], at + 1
    return out


def encoded(rows: DataFrame, column: str = "symbols", size: int = 256) -> DataFrame:
    """Adds ``freq``, the adaptive table after all symbols of a row, and ``payload``, the row's symbols coded by it.

    A null array gets nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables: list[list[int] | None] = []
            payloads: list[bytes | None] = []
            for cell in b.column(column):
                if not cell.is_valid:
                    tables.append(None)
                    payloads.append(None)
                    continue
                symbols = cell.values.to_numpy(zero_copy_only=False).astype(np.int64)
                table = AdaptiveTable(size)
                table.counts += np.bincount(symbols, minlength=size)
                freq = table.frequencies()
                tables.append(freq.tolist())
                payloads.append(encode(symbols, freq))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tables, pa.list_(pa.int32())), pa.array(payloads, pa.binary())], names=[*b.schema.names, "freq", "payload"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, freq array<int>, payload binary")


def decoded(rows: DataFrame, count: str = "n") -> DataFrame:
    """Adds ``decoded``: the ``count`` symbols that ``payload`` holds by the table ``freq``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = zip(b.column("payload").to_pylist(), b.column(count).to_pylist(), b.column("freq").to_pylist(), strict=True)
            out = [None if p is None else decode(p, n, np.array(f, np.int64)).tolist() for p, n, f in cells]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, decoded array<int>")


def cumulative(rows: DataFrame, symbol: str, *keys: str) -> DataFrame:
    """(keys, symbol, n, before): counts of symbols and of all lower ones."""
    order = Window.partitionBy(*keys).orderBy(symbol).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def ideal_bits(n: Column, total: Column) -> Column:
    """Bits that an ideal coder needs for ``n`` symbols of this kind of ``total``."""
    return -n * F.log2(n / total)

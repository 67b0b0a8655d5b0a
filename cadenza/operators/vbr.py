"""The variable-bit-length byte streams of packets, in workers.

Bits are written from the least significant on.  A stream is the block scale,
the first value (one byte, or two for 12 bits), then codes: 0 and 1 stand for
4 and 16 silent samples, any other code c is followed by deltas of c + 1 bits
up to an end mark (or the packet's end).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.runs import VBR8, Coding, marks


def wrapped(x: np.ndarray, bits: int) -> np.ndarray:
    half = 1 << (bits - 1)
    return ((x + half) & ((1 << bits) - 1)) - half


def delta_values(q: np.ndarray, coding: Coding) -> np.ndarray:
    """Deltas without the end mark's value; the odd one out is made good by its successor.

    It goes one higher, but one lower where its value is the top one, so that
    a sample is never off by more than one.
    """
    d = wrapped(np.diff(q.astype(np.int64)), coding.bits)
    low = -(1 << (coding.bits - 1))
    if (d == low).any():
        carry = 0
        for i in range(len(d)):
            d[i] = wrapped(d[i] + carry, coding.bits)
            carry = 0 if d[i] != low else 1 if q[i + 1] == ~low else -1
            if carry:
                d[i] = ~low if carry > 0 else low + 1
    return d


def fields(q: np.ndarray, coding: Coding) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes in bits) of everything after the head."""
    d = delta_values(q, coding)
    n = len(d)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = np.clip(np.ceil(np.log2(np.abs(d) + 1)).astype(int) + 1, 3, coding.bits)
    code, silent, covered = marks(width, q[1:] == 0, coding)
    values: list[int] = []
    sizes: list[int] = []
    own = np.where(covered, -1, code)
    starts = np.nonzero((silent >= 0) | (~covered & (own != np.append(-1, own[:-1]))))[0]
    for i in starts.tolist():
        if covered[i]:
            values.append(int(silent[i]))
            sizes.append(coding.code_bits)
            continue
        c, end = int(code[i]), i + 1
        while end < n and own[end] == c:
            end += 1
        values += [c, *d[i:end].tolist()]
        sizes += [coding.code_bits, *[c + 1] * (end - i)]
        if end < n:
            values.append(1 << c)
            sizes.append(c + 1)
    return np.array(values, np.int64), np.array(sizes, np.int64)


def packed_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Each value's low bits, the least significant first, padded with zeros."""
    if not len(values):
        return b""
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.packbits((np.repeat(values, sizes) >> place & 1).astype(np.uint8), bitorder="little").tobytes()


def encode(q: np.ndarray, scale: int, coding: Coding = VBR8) -> bytes:
    """The payload of a packet's values; a packet has at least one."""
    if not len(q):
        raise ValueError("a packet has at least one sample")
    head = int(q[0]).to_bytes(coding.head_bits // 8 - 1, "little", signed=True)
    return bytes([scale]) + head + packed_bits(*fields(np.asarray(q, np.int64), coding))


def decode(payload: bytes, n: int, coding: Coding = VBR8) -> tuple[int, np.ndarray]:
    """(scale, values) of a payload of ``n`` samples."""
    head = coding.head_bits // 8
    if len(payload) < head or n < 1:
        raise ValueError("a payload holds a scale and a first value")
    now = int.from_bytes(payload[1:head], "little", signed=True)
    stream, left = int.from_bytes(payload[head:], "little"), 8 * (len(payload) - head)
    out = [now]

    def take(bits: int) -> int:
        nonlocal stream, left
        if bits > left:
            raise ValueError("the payload ends early")
        value, stream, left = stream & ((1 << bits) - 1), stream >> bits, left - bits
        return value

    while len(out) < n:
        code = take(coding.code_bits)
        if code < 2:
            out += [0] * coding.least[code]
            now = 0
        elif code <= coding.top:
            while len(out) < n and (x := take(code + 1)) != 1 << code:
                now = int(wrapped(np.int64(now + (x - (1 << (code + 1)) if x >> code else x)), coding.bits))
                out.append(now)
        else:
            raise ValueError(f"code {code} is reserved")
    return payload[0], np.array(out[:n])


def compressed(packets: DataFrame, coding: Coding = VBR8) -> DataFrame:
    """Adds ``comp_samples`` and ``payload`` to packets with scale ``s`` and values ``q``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, s = b.column("q"), b.column("s").to_pylist()
            payload = [encode(q[i].values.to_numpy(), s[i], coding) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, q.value_lengths(), pa.array(payload, pa.binary())], names=[*b.schema.names, "comp_samples", "payload"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packets.schema)
    return packets.mapInArrow(run, f"{schema}, comp_samples int, payload binary")


def decompressed(packets: DataFrame, coding: Coding = VBR8) -> DataFrame:
    """Adds scale ``s2`` and values ``q2`` read from ``payload`` of ``comp_samples``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode(p, n, coding) for p, n in zip(b.column("payload").to_pylist(), b.column("comp_samples").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s for s, _ in found], pa.int32()), pa.array([q.tolist() for _, q in found], pa.list_(pa.int32()))], names=[*b.schema.names, "s2", "q2"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packets.schema)
    return packets.mapInArrow(run, f"{schema}, s2 int, q2 array<int>")


def self_check(packets: DataFrame) -> DataFrame:
    """Adds how many values of ``q`` and ``q2`` differ, and by how much in all."""
    off = F.zip_with("q", "q2", lambda a, b: F.abs(a - b))
    return packets.withColumn("wrong", F.size(F.filter(off, lambda x: x != 0))).withColumn("error", F.aggregate(off, F.lit(0), lambda s, x: s + x))

"""What packs a packet of samples into bytes: the exchangeable last stage of the codec.

A compressor has two methods.  ``compress`` takes 16-bit samples, as whole
numbers, and ``decompress`` gives samples of the same units, cut towards zero.
Any object with both will do.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

from cadenza.operators import vbr
from cadenza.operators.runs import VBR8, Coding
from cadenza.operators.scaling import FINER


class Compressor(Protocol):
    def compress(self, x: np.ndarray) -> bytes: ...

    def decompress(self, payload: bytes, n: int) -> np.ndarray: ...


def scale_of(x: np.ndarray) -> int:
    return int(min(255, max(1, int(np.abs(x.astype(np.int64)).max(initial=0)) >> 7)))


def quantized(x: np.ndarray, bits: int) -> tuple[int, np.ndarray]:
    """The block's scale and its values of 8 or 12 bits."""
    s, most = scale_of(x), 127 if bits == 8 else 2047
    return s, np.clip(np.trunc(x / (s + 1) * (1.0 if bits == 8 else FINER)), -most, most).astype(np.int64)


def restored(q: np.ndarray, s: int, bits: int) -> np.ndarray:
    return np.trunc(q * (s + 1) / (1.0 if bits == 8 else FINER))


@dataclass(frozen=True)
class Vbr:
    """Scaled values as deltas of variable width."""

    coding: Coding = VBR8

    def compress(self, x: np.ndarray) -> bytes:
        s, q = quantized(x, self.coding.bits)
        return vbr.encode(q, s, self.coding)

    def decompress(self, payload: bytes, n: int) -> np.ndarray:
        s, q = vbr.decode(payload, n, self.coding)
        return restored(q, s, self.coding.bits)


@dataclass(frozen=True)
class Scaled:
    """The scale, then values of one byte, or two for 12 bits."""

    bits: int = 8

    def compress(self, x: np.ndarray) -> bytes:
        s, q = quantized(x, self.bits)
        return bytes([s]) + q.astype("i1" if self.bits == 8 else "<i2").tobytes()

    def decompress(self, payload: bytes, n: int) -> np.ndarray:
        kind = np.dtype("i1" if self.bits == 8 else "<i2")
        if len(payload) != 1 + n * kind.itemsize:
            raise ValueError(f"{len(payload)} bytes for {n} samples")
        return restored(np.frombuffer(payload[1:], kind).astype(np.int64), payload[0], self.bits)


@dataclass(frozen=True)
class Raw:
    """Samples as they are, two bytes each."""

    def compress(self, x: np.ndarray) -> bytes:
        return x.astype("<i2").tobytes()

    def decompress(self, payload: bytes, n: int) -> np.ndarray:
        if len(payload) != 2 * n:
            raise ValueError(f"{len(payload)} bytes for {n} samples")
        return np.frombuffer(payload, "<i2").astype(float)

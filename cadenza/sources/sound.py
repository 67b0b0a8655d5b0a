"""WAV and AIFF files as bytes: parsing and writing.

Both are chunked formats; chunks are padded to even sizes.  Samples are kept
as integers of the file's depth, or as floats.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

MOST_CHANNELS = 128


class SoundError(ValueError):
    """A file that is not a sound file that this module reads."""


@dataclass
class Sound:
    rate: int
    bits: int
    channels: list[np.ndarray] = field(default_factory=list)
    floating: bool = False
    ixml: str | None = None

    @property
    def seconds(self) -> float:
        return len(self.channels[0]) / self.rate if self.channels else 0.0

    def as_int16(self, scale8: bool = False) -> list[np.ndarray]:
        """Samples of 16 bits: higher depths shift, floats scale; 8 bits stay as they are unless ``scale8``."""
        out = []
        for c in self.channels:
            if self.floating:
                c = (np.clip(c, -1, 1) * 32767).astype(np.int64)
            elif self.bits > 16:
                c = c.astype(np.int64) >> (self.bits - 16)
            elif self.bits == 8 and scale8:
                c = c.astype(np.int64) << 8
            out.append(c.astype(np.int16))
        return out

    def as_float(self) -> list[np.ndarray]:
        full = 1.0 if self.floating else float(1 << (self.bits - 1))
        return [c / full for c in self.channels]


def kind(content: bytes) -> str | None:
    """wav, aiff or None, by the first bytes."""
    return {b"RIFF": "wav", b"FORM": "aiff"}.get(content[:4]) if len(content) >= 12 else None


def chunks(content: bytes, order: str) -> dict[bytes, bytes]:
    """The first chunk of each kind; one that claims more than there is is cut."""
    out: dict[bytes, bytes] = {}
    at = 12
    while at + 8 <= len(content):
        name, (size,) = content[at : at + 4], struct.unpack(order + "I", content[at + 4 : at + 8])
        out.setdefault(name, content[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def from_bytes(raw: bytes, bits: int, order: str, floating: bool, unsigned8: bool) -> np.ndarray:
    if floating:
        return np.frombuffer(raw, f"{order}f{bits // 8}").astype(np.float64)
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        low, mid, high = (b[:, k] for k in ((0, 1, 2) if order == "<" else (2, 1, 0)))
        return (low | mid << 8 | high << 16) - ((high >> 7) << 24)
    if bits == 8:
        return np.frombuffer(raw, np.uint8).astype(np.int32) - 128 if unsigned8 else np.frombuffer(raw, np.int8).astype(np.int32)
    return np.frombuffer(raw, f"{order}i{bits // 8}").astype(np.int32)


def to_bytes(x: np.ndarray, bits: int, order: str, floating: bool, unsigned8: bool) -> bytes:
    if floating:
        return x.astype(f"{order}f{bits // 8}").tobytes()
    x = np.clip(x, -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype(np.int64)
    if bits == 24:
        b = (x & 0xFFFFFF)[:, None] >> (np.array([0, 8, 16]) if order == "<" else np.array([16, 8, 0]))
        return (b & 0xFF).astype(np.uint8).tobytes()
    if bits == 8:
        return ((x + 128) if unsigned8 else (x & 0xFF)).astype(np.uint8).tobytes()
    return x.astype(f"{order}i{bits // 8}").tobytes()


def check(rate: int, bits: int, channels: int) -> None:
    if not 1 <= channels <= MOST_CHANNELS:
        raise SoundError(f"{channels} channels")
    if bits not in (8, 16, 24, 32):
        raise SoundError(f"{bits} bits")
    if rate <= 0:
        raise SoundError(f"{rate} Hz")


def split(samples: np.ndarray, channels: int) -> list[np.ndarray]:
    whole = len(samples) // channels * channels
    return list(samples[:whole].reshape(-1, channels).T.copy())


def parse_wav(content: bytes) -> Sound:
    if kind(content) != "wav" or content[8:12] != b"WAVE":
        raise SoundError("not a WAV file")
    found = chunks(content, "<")
    if b"fmt " not in found or b"data" not in found or len(found[b"fmt "]) < 16:
        raise SoundError("no format or no data")
    form, channels, rate, byte_rate, block, bits = struct.unpack("<HHIIHH", found[b"fmt "][:16])
    if form == 0xFFFE and len(found[b"fmt "]) >= 26:  # extensible: the true format follows
        form = struct.unpack("<H", found[b"fmt "][24:26])[0]
    if form not in (1, 3):
        raise SoundError(f"format {form}")
    check(rate, bits, channels)
    if byte_rate != rate * channels * bits // 8 or block != channels * bits // 8:
        raise SoundError("rates that don't agree")
    if form == 3 and bits != 32:
        raise SoundError("floats of other than 32 bits")
    data = found[b"data"]
    samples = from_bytes(data[: len(data) // block * block], bits, "<", form == 3, True)
    return Sound(rate, bits, split(samples, channels), form == 3, found[b"iXML"].decode(errors="replace") if b"iXML" in found else None)


def chunk(name: bytes, body: bytes, order: str) -> bytes:
    return name + struct.pack(order + "I", len(body)) + body + b"\0" * (len(body) % 2)


def write_wav(sound: Sound) -> bytes:
    n = len(sound.channels)
    check(sound.rate, sound.bits, n)
    step = n * sound.bits // 8
    fmt = struct.pack("<HHIIHH", 3 if sound.floating else 1, n, sound.rate, sound.rate * step, step, sound.bits) + (b"\0\0" if sound.floating else b"")
    body = chunk(b"fmt ", fmt, "<") + chunk(b"data", to_bytes(np.stack(sound.channels, 1).ravel(), sound.bits, "<", sound.floating, True), "<")
    if sound.ixml is not None:
        body += chunk(b"iXML", sound.ixml.encode(), "<")
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def extended(value: int) -> bytes:
    """A whole number as an 80-bit extended float."""
    top = value.bit_length() - 1
    return struct.pack(">HQ", 16383 + top, value << (63 - top)) if value else b"\0" * 10


def from_extended(raw: bytes) -> int:
    power, digits = struct.unpack(">HQ", raw)
    return digits >> shift if 0 <= (shift := 63 - ((power & 0x7FFF) - 16383)) < 64 else 0


def parse_aiff(content: bytes) -> Sound:
    if kind(content) != "aiff" or content[8:12] not in (b"AIFF", b"AIFC"):
        raise SoundError("not an AIFF file")
    found = chunks(content, ">")
    if b"COMM" not in found or b"SSND" not in found or len(found[b"COMM"]) < 18 or len(found[b"SSND"]) < 8:
        raise SoundError("no format or no data")
    channels, n, bits = struct.unpack(">hIh", found[b"COMM"][:8])
    rate = from_extended(found[b"COMM"][8:18])
    check(rate, bits, channels)
    floating = content[8:12] == b"AIFC" and bits == 32 and found[b"COMM"][18:22] in (b"fl32", b"FL32")
    (offset,) = struct.unpack(">I", found[b"SSND"][:4])
    raw = found[b"SSND"][8 + offset :][: n * channels * bits // 8]
    samples = from_bytes(raw[: len(raw) // (bits // 8) * (bits // 8)], bits, ">", floating, False)
    return Sound(rate, bits, split(samples, channels), floating, found[b"iXML"].decode(errors="replace") if b"iXML" in found else None)


def write_aiff(sound: Sound) -> bytes:
    n = len(sound.channels)
    check(sound.rate, sound.bits, n)
    comm = struct.pack(">hIh", n, len(sound.channels[0]), sound.bits) + extended(sound.rate)
    if sound.floating:
        comm += b"fl32" + b"\0\0"
    data = b"\0" * 8 + to_bytes(np.stack(sound.channels, 1).ravel(), sound.bits, ">", sound.floating, False)
    body = chunk(b"COMM", comm, ">") + chunk(b"SSND", data, ">")
    if sound.ixml is not None:
        body += chunk(b"iXML", sound.ixml.encode(), ">")
    return b"FORM" + struct.pack(">I", 4 + len(body)) + (b"AIFC" if sound.floating else b"AIFF") + body


def parse(content: bytes) -> Sound:
    """A sound file of either kind."""
    found = kind(content)
    if found is None:
        raise SoundError("neither WAV nor AIFF")
    return parse_wav(content) if found == "wav" else parse_aiff(content)

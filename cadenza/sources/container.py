"""The seekable packet container as bytes: a header, a seek table and packets by frame and channel."""

from __future__ import annotations

import struct
from dataclasses import astuple, dataclass

#: Fixed values of the file format: the header's layout and first bytes, and the only codec.
MAGIC = b"ANOG"
HEADER = "<4sHHBBBBIIHHQIQ20x"
SEEK = "<QQ"
PACKET = "<HBH"
VERSION, CODEC, COMPRESSED_RATE = 1, 1, 12_000
#: Fixed values of the older header without packets: its first bytes and layout.
PLAIN_MAGIC, PLAIN = b"VBIF", "<4sBBH"

HEADER_SIZE, SEEK_SIZE, PACKET_SIZE = (struct.calcsize(x) for x in (HEADER, SEEK, PACKET))


class ContainerError(ValueError):
    """Bytes that are not a container, or contradict themselves."""


@dataclass(frozen=True)
class Header:
    channels: int
    filter_id: int
    pcm_sample_rate: int
    frame_ms: int
    pcm_total_samples: int
    seek_entry_count: int
    compressed_total_samples: int
    codec_id: int = CODEC
    flags: int = 0
    compressed_rate: int = COMPRESSED_RATE
    reserved0: int = 0


@dataclass(frozen=True)
class Packet:
    frame_idx: int
    channel: int
    pkt_seq: int
    comp_samples: int
    payload: bytes


def write_header(h: Header) -> bytes:
    return struct.pack(HEADER, MAGIC, VERSION, HEADER_SIZE, h.channels, h.codec_id, h.filter_id, h.flags, h.pcm_sample_rate, h.compressed_rate, h.frame_ms, h.reserved0, h.pcm_total_samples, h.seek_entry_count, h.compressed_total_samples)


def read_header(content: bytes) -> Header:
    if len(content) < HEADER_SIZE:
        raise ContainerError("shorter than a header")
    magic, version, size, channels, codec, filter_id, flags, rate, packed_rate, ms, reserved, total, count, packed = struct.unpack_from(HEADER, content)
    if (magic, version, size) != (MAGIC, VERSION, HEADER_SIZE):
        raise ContainerError("not this container, or another version of it")
    if codec != CODEC or not channels:
        raise ContainerError(f"codec {codec}, {channels} channels")
    return Header(channels, filter_id, rate, ms, total, count, packed, codec, flags, packed_rate, reserved)


def read_seek(content: bytes, h: Header, at: int = HEADER_SIZE) -> list[tuple[int, int]]:
    if len(content) < at + SEEK_SIZE * h.seek_entry_count:
        raise ContainerError("the seek table ends early")
    return [struct.unpack_from(SEEK, content, at + SEEK_SIZE * k) for k in range(h.seek_entry_count)]


def read_part(f, low: int = 0, high: int | None = None) -> tuple[Header, list[tuple[int, int]], bytes, int]:
    """The header, the seek table, and the bytes of the frames low to high - 1 with where they begin, of an open file."""
    h = read_header(f.read(HEADER_SIZE))
    head = f.read(SEEK_SIZE * h.seek_entry_count)
    table = read_seek(head, h, 0)
    begin = table[low][1] if low < len(table) else HEADER_SIZE + len(head)
    f.seek(begin)
    if low >= len(table) or high is not None and high <= low:
        return h, table, b"", begin
    return h, table, f.read() if high is None or high >= len(table) else f.read(table[high][1] - begin), begin


def read_packets(content: bytes, h: Header, low: int = 0, high: int | None = None, table: list[tuple[int, int]] | None = None, base: int = 0) -> list[Packet]:
    """Packets of the frames low to high - 1, found by the seek table; checks that each channel has its frame's samples, in order.

    With a ``table``, the content is the part of the file that begins at ``base``.
    """
    table = read_seek(content, h) if table is None else table
    out = []
    for frame in range(low, len(table) if high is None else min(high, len(table))):
        tick, at = table[frame][0], table[frame][1] - base
        if at < 0:
            raise ContainerError("a frame that begins before the packets")
        length = (table[frame + 1][0] if frame + 1 < len(table) else h.compressed_total_samples) - tick
        for channel in range(h.channels):
            n = seq = 0
            while n < length:
                if at + PACKET_SIZE > len(content):
                    raise ContainerError("the packets end early")
                size, own, samples = struct.unpack_from(PACKET, content, at)
                at += PACKET_SIZE
                if own != channel or not 0 < samples <= length - n or at + size > len(content):
                    raise ContainerError(f"a packet of channel {own} with {samples} samples in frame {frame}, channel {channel}")
                out.append(Packet(frame, channel, seq, samples, content[at : at + size]))
                at, n, seq = at + size, n + samples, seq + 1
    return out


def assemble(channels: int, filter_id: int, rate: int, frame_ms: int, total: int, packets: list[Packet]) -> bytes:
    """The whole file, in one pass: offsets follow from sizes."""
    if not 1 <= channels <= 255:
        raise ContainerError(f"{channels} channels")
    ordered = sorted(packets, key=lambda p: (p.frame_idx, p.channel, p.pkt_seq))
    frames = 1 + max((p.frame_idx for p in ordered), default=-1)
    ticks, offsets = [0] * frames, [0] * frames
    for p in ordered:
        ticks[p.frame_idx] += p.comp_samples if p.channel == 0 else 0
        offsets[p.frame_idx] += PACKET_SIZE + len(p.payload)
    tick, offset, table = 0, HEADER_SIZE + SEEK_SIZE * frames, b""
    for n, size in zip(ticks, offsets, strict=True):
        table += struct.pack(SEEK, tick, offset)
        tick, offset = tick + n, offset + size
    head = Header(channels, filter_id, rate, frame_ms, total, frames, tick)
    body = b"".join(struct.pack(PACKET, len(p.payload), p.channel, p.comp_samples) + p.payload for p in ordered)
    return write_header(head) + table + body


def plain_header(bits16: bool, rate: int, frame_length: int) -> bytes:
    """The older header; what follows it has no packet lengths, so it is written only."""
    return struct.pack(PLAIN, PLAIN_MAGIC, int(bits16), rate // 300, frame_length)


def header_row(h: Header) -> tuple:
    return astuple(h)

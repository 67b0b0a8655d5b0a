"""Secret scans through nested encodings: a worklist of layers, decoded to a fixpoint.

The first layer of a document is its text.  Every layer is scanned by the base
patterns; then whatever it has of percent escapes, Unicode escapes and
character references, base64 runs and compressed data in any of these is decoded
into further layers, each with a map from its characters to code points of the
document.  A layer that was seen before over the same place is not taken up
again, which ends cycles, and the worklist is done when no new layer appears.
Escapes are decoded by the line, base64 by the run.  Compressed data unfolds as a
stream, looked into by overlapping pieces, and the worklist goes depth first, so
a worker holds a piece for each level, whatever the data unfold to.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words without which ASSIGN has no match.
HINTS = ("passw", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[a-zA-Z]{2,10};")
RUN = re.compile(r"(?:[A-Za-z0-9+/]{60,}\r?\n)+[A-Za-z0-9+/]+={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of nothing but base64, of which those of one width are joined.
LINES = re.compile(r"(?m)^[A-Za-z0-9+/]{4,}(?:\r?\n[A-Za-z0-9+/]+={0,2})+(?=\r?$)")
#: Printable stretches of bytes that aren't text, plain and in UTF-16; no base pattern is shorter than 12.
STRETCHES = ((re.compile(rb"[\t-\r\x20-\x7e]{12,}"), 0, 1), (re.compile(rb"(?:[\t-\r\x20-\x7e]\0){12,}"), 0, 2), (re.compile(rb"(?:\0[\t-\r\x20-\x7e]){12,}"), 1, 2))
#: Bytes of a run of hex digits, and of base64, for a quick look before the patterns.
HEX_BYTES = bytes(ord("x") if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
RUN_BYTES = bytes(ord("x") if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/-_") else 0x20 for c in range(256))

#: How compressed data begin (gzip, zlib, bzip2, xz, Zstandard), as characters, and with percent escapes.
MAGIC = re.compile("\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\\(\xb5/\xfd|x[\x01\x5e\x9c\xda]")
MAGIC_PERCENT = re.compile(r"%1[fF]%8[bB]%08|(?:BZh|%42%5[aA]%68)[1-9%]|%[fF][dD](?:7|%37)|(?:\(|%28)%[bB]5(?:/|%2[fF])%[fF][dD]|(?:x|%78)%(?:9[cC]|[dD][aA]|01|5[eE])")
NARROW, UNBROKEN = re.compile("[\x00-\xff]*"), re.compile(r"[^\s\"'<>]*")

#: Bytes of unfolded data that are looked at at a time, and that the next such piece sees again.
PIECE, OVERLAP = 16 << 20, 1 << 20

codecs.register_error("cadenza_latin", lambda e: (e.object[e.start : e.end].decode("latin-1"), e.end))

Span = tuple[int, int, int]


def base_spans(text: str, raw: bytes) -> list[Span]:
    """(kind, start, end) of the base patterns; raw is the text in UTF-8."""
    out: list[Span] = []
    folded = raw.lower()
    if any(x.encode() in folded for x in HINTS):
        # Folding A-Z alone keeps every code point in its place.
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(folded.decode()) if len(m[1]) >= 6]
    if b"AKIA" in raw:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(HEX_BYTES):
        out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A decoded text; its character i stands for the code points starts[i]:ends[i] of the document."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    def place(self, a: int, b: int) -> tuple[int, int]:
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def key(self) -> tuple[bytes, int, int]:
        return (hashlib.sha256(self.text.encode()).digest(), *self.place(0, len(self.text)))


def rewritten(layer: Layer, lo: int, hi: int, pattern: re.Pattern, decode) -> Layer | None:
    """The part lo:hi of a layer with every match of the pattern decoded; None if nothing changed."""
    out: list[str] = []
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    at, changed = lo, False
    for m in pattern.finditer(layer.text, lo, hi):
        new = decode(m[0])
        if new is None or new == m[0]:
            continue
        changed = True
        s, e = layer.place(m.start(), m.end())
        out += [layer.text[at : m.start()], new]
        starts += [layer.starts[at : m.start()], np.full(len(new), s)]
        ends += [layer.ends[at : m.start()], np.full(len(new), e)]
        at = m.end()
    if not changed:
        return None
    text = "".join([*out, layer.text[at:hi]])
    return Layer(text, np.concatenate([*starts, layer.starts[at:hi]]), np.concatenate([*ends, layer.ends[at:hi]])) if text else None


def percent(run: str) -> str:
    """UTF-8, and what isn't byte by byte."""
    return unquote_to_bytes(run).decode("utf-8", "cadenza_latin")


def escape(token: str) -> str | None:
    if token[0] == "&":
        return html.unescape(token)
    code = int(token[3:-1] if token[2] == "{" else token[2:], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def is_text(raw: bytes) -> str | None:
    """raw as text, if it is UTF-8 and holds no control characters but white space."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return None if re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else text


def decoder(head: bytes) -> Callable | None:
    """What makes decompressors for data that begin like this."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] & 15 == 8 and int.from_bytes(head[:2], "big") % 31 == 0):
        return lambda: zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return lambda: zstandard.ZstdDecompressor().decompressobj()
    return None


def unfolding(chunks: Iterator[bytes], fresh: Callable, most: int = 1 << 18) -> Iterator[bytes]:
    """What all members of compressed data hold, in small parts; ends where they end or break."""
    one = fresh()
    bounded = hasattr(one, "needs_input") or type(one).__module__ == "zlib"  # takes a bound on what it gives
    step = 1 << 12 if bounded else 1 << 8
    for chunk in chunks:
        for at in range(0, len(chunk), step):
            rest = chunk[at : at + step]
            while rest or (bounded and not getattr(one, "needs_input", True)):
                try:
                    out = one.decompress(rest, most) if bounded else one.decompress(rest)
                except Exception as e:  # zstandard's error has no common base with the others
                    if isinstance(e, (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)) or type(e).__name__ == "ZstdError":
                        return
                    raise
                if out:
                    yield out
                if one.eof:
                    rest, one = one.unused_data, fresh()
                else:  # zlib hands back what it did not get to; others keep it
                    rest = one.unconsumed_tail if bounded and not hasattr(one, "needs_input") else b""


def gathered(chunks: Iterator[bytes], size: int) -> tuple[bytes, Iterator[bytes]]:
    """The first ``size`` bytes or some more, and the chunks after them."""
    held, n = [], 0
    for c in chunks:
        held.append(c)
        n += len(c)
        if n >= size:
            break
    return b"".join(held), chunks


def pieces_of(raw: bytes, piece: int, overlap: int) -> Iterator[bytes]:
    """What compressed data hold once all their levels are unfolded, by overlapping pieces; nothing if they aren't compressed data."""
    head, rest, seen = raw, iter(()), set()
    while fresh := decoder(head):
        digest = hashlib.sha256(head).digest()
        inner, more = gathered(unfolding(chain([head], rest), fresh), piece)
        if not inner or digest in seen:  # not compressed after all, or data that unfold to themselves
            break
        seen.add(digest)
        head, rest = inner, more
    if not seen:
        return
    while True:
        yield head
        new, rest = gathered(rest, piece - overlap)
        if not new:
            return
        head = head[-overlap:] + new


def views(raw: bytes) -> Iterator[str]:
    """Bytes as text, whole if they are, else their printable stretches; a piece may begin or end inside a character."""
    inner = raw.lstrip(bytes(range(0x80, 0xC0))) if raw[:1] >= b"\x80" else raw
    for cut in range(4):
        if text := is_text(inner[: len(inner) - cut]):
            yield text
            return
    yield from (text for text, _ in stretches(raw))


def stretches(raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Printable parts of bytes that aren't text, and the byte of each character."""
    for pattern, first, step in STRETCHES:
        for m in pattern.finditer(raw):
            text = m[0][first::step].decode("ascii")
            yield text, m.start() + first + step * np.arange(len(text))


def unbase(part: bytes) -> bytes:
    part = part[: len(part) - (len(part) % 4 == 1)]
    return base64.urlsafe_b64decode(part.replace(b"+", b"-").replace(b"/", b"_") + b"=" * (-len(part) % 4))


def flat_layer(text: str, place: tuple[int, int]) -> Layer:
    """A layer all of whose characters stand for one place; the map takes no memory."""
    return Layer(text, *(np.broadcast_to(np.int64(x), len(text)) for x in place))


def decoded_run(layer: Layer, start: int, found: str, piece: int, overlap: int) -> Iterator[Layer]:
    """The layers inside a base64 run that starts there."""
    chars = np.frombuffer(found.encode("ascii"), np.uint8)
    at = start + np.nonzero((chars != 10) & (chars != 13) & (chars != 61))[0]
    body = bytes(chars[at - start])
    place = layer.place(start, start + len(found))
    # A path or a word may stand before: its length is any, so compressed data may begin at each mark.
    marks = {p for m in re.finditer(rb"[/_-]", body) for p in (m.start(), m.end())} - set(range(4))
    for skip in [*range(4), *sorted(marks)]:
        part = body[skip:]
        if len(part) - (len(part) % 4 == 1) < 16:
            break
        folds = decoder(unbase(part[:8])) is not None
        if skip > 3 and not folds:
            continue
        raw, any_ = unbase(part), False
        if folds:
            for unfolded in pieces_of(raw, piece, overlap):
                any_ = True
                yield from (flat_layer(text, place) for text in views(unfolded))
        if any_ or skip > 3:
            continue
        own = at[skip:]
        if text := is_text(raw):
            first = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) if not text.isascii() else np.arange(len(text) + 1)
            lo, hi = first[:-1], first[1:] - 1
            yield Layer(text, layer.starts[own[lo * 4 // 3]], layer.ends[own[np.minimum(hi * 4 // 3 + 1, len(own) - 1)]])
            return
        for text, b in stretches(raw):
            yield Layer(text, layer.starts[own[b * 4 // 3]], layer.ends[own[np.minimum(b * 4 // 3 + 1, len(own) - 1)]])


def bare_data(layer: Layer, piece: int, overlap: int) -> Iterator[Layer]:
    """What compressed data hold that stand in a layer as characters, or as percent escapes among them."""
    for pattern, run, raw in ((MAGIC, NARROW, lambda t: t.encode("latin-1")), (MAGIC_PERCENT, UNBROKEN, lambda t: unquote_to_bytes(t))):
        for m in pattern.finditer(layer.text):
            found = run.match(layer.text, m.start())
            place = layer.place(found.start(), found.end())
            for unfolded in pieces_of(raw(found[0]), piece, overlap):
                yield from (flat_layer(text, place) for text in views(unfolded))


def wrapped(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of lines of one width, and a last one that is no wider, which the runs don't join."""
    for m in LINES.finditer(text):
        at, start, width = m.start(), m.start(), 0
        held: list[str] = []
        for line in m[0].splitlines(keepends=True):
            size = len(line.rstrip("\r\n"))
            if held and size != width:
                if size < width:
                    held.append(line)
                if len(held) > 1:
                    yield start, "".join(held).rstrip("\r\n")
                held = []
            if not held:
                start, width = at, size
            held.append(line)
            at += len(line)
        if len(held) > 1:
            yield start, "".join(held).rstrip("\r\n")


def lines_with(text: str, pattern: re.Pattern, found: re.Match | None) -> Iterator[tuple[int, int]]:
    """The lines, as start and end, that have a match."""
    while found:
        lo = text.rfind("\n", 0, found.start()) + 1
        hi = text.find("\n", found.end())
        hi = len(text) if hi < 0 else hi
        yield lo, hi
        found = pattern.search(text, hi)


def inside(layer: Layer, piece: int, overlap: int) -> Iterator[Layer]:
    """The layers that a layer holds, one at a time."""
    for mark, pattern, decode in (("%", PERCENT, percent), ("\\&", ESCAPE, escape)):
        if any(x in layer.text for x in mark):
            for lo, hi in lines_with(layer.text, pattern, pattern.search(layer.text)):
                if child := rewritten(layer, lo, hi, pattern, decode):
                    yield child
    yield from bare_data(layer, piece, overlap)
    for start, found in chain(((m.start(), m[0]) for m in RUN.finditer(layer.text)), wrapped(layer.text)):
        yield from decoded_run(layer, start, found, piece, overlap)


def scan(text: str | None, piece: int = PIECE, overlap: int = OVERLAP) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans, of one text; each sorted by start, then kind, then end."""
    text = text or ""
    raw = text.encode()
    base = base_spans(text, raw)
    spans = set(base)
    work: list[Iterator[Layer]] = []
    if "%" in text or "\\" in text or "&" in text or b"x" * 16 in raw.translate(RUN_BYTES) or LINES.search(text) or MAGIC.search(text):
        work.append(inside(Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1)), piece, overlap))
    seen: set[tuple[bytes, int, int]] = set()
    while work:
        child = next(work[-1], None)
        if child is None:
            work.pop()
        elif (key := child.key()) not in seen:
            seen.add(key)
            spans |= {(kind, *child.place(a, b)) for kind, a, b in base_spans(child.text, child.text.encode())}
            work.append(inside(child, piece, overlap))
    order = lambda s: (s[1], s[0], s[2])
    return sorted(base, key=order), sorted(spans, key=order)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = PIECE, overlap_bytes: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: its id, ``base`` and ``spans``, arrays of (kind, start, end).

    Kinds are assign, access and hex.  Places are code points of the text, the
    end exclusive; ``base`` holds what the text itself shows, ``spans`` adds what
    its layers hide.  Compressed data are looked into whole, whatever they unfold
    to, by pieces of ``piece_bytes``, each of which sees the last ``overlap_bytes``
    of the one before; only an encoded run inside them that is longer than the
    overlap may be cut by a piece's end, and is then decoded in two parts.

    A null text counts as empty and has no spans.  Null ids and repeated rows
    are kept.  An empty table gives an empty result.  Only the named columns
    are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    listed = "array<struct<kind: string, start: long, end: long>>"
    as_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(b.column(1)[i].as_py(), piece_bytes, overlap_bytes) for i in range(b.num_rows)]
            cells = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in f[j]] for f in found], as_type) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cells], names=["id", "base", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, base {listed}, spans {listed}").withColumnRenamed("id", id_col)

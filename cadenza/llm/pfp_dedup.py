"""Exact substring deduplication by prefix-free parsing, distributed.

A rolling hash puts triggers into the text: the trigger of a window of ``width``
bytes is the position of its least K-byte hash, so it depends on the window's
content alone and equal windows have equal triggers.  The windows that share a
trigger are consecutive; the stretch they cover is a *phrase*.  Neighbouring
phrases overlap by ``width - 1`` bytes, so every window lies in exactly one
phrase.  That bounded overlap makes dictionary order settle every comparison
of ``width`` bytes, and the parse contributes the order of occurrences.

1. A scan parses the texts.  Within a block of documents equal phrases are
   brought together at once and only the first goes on under its trigger.
2. The parse is put in suffix order, as deep as it counts: a phrase holds each of its
   windows whole, so its suffixes are told apart by their first phrase, and
   sorting by trigger, phrase and occurrence is enough.  All but the first
   occurrence of a phrase are covered whole.  A first occurrence needs a closer
   look only if another phrase has its trigger.
3. Those phrases are the dictionary.  Its suffix array is built from the bytes
   themselves, by prefix doubling to ``width`` bytes, whole triggers at a time.  Within
   equal suffixes the parse's order of occurrences takes over, which makes it
   the corpus order of all windows: all but the first of equals are covered.
4. The covered stretches meet their documents.

Phrases are equal if their triggers and their BLAKE2b digests, salted by a random
number that the driver draws for each call, are; windows are compared byte by byte.

Sorting is Spark's and may spill; a worker holds a batch, or the phrases of
triggers up to GROUP.  A trigger with more phrases has its windows sorted as
rows of 128-bit salted digests.  One that a sample of documents shows in many
different phrases is cut into windows before the first shuffle already, so that
they spread by their own digests; the sample decides the route only, not the result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stash

#: Bytes of a trigger.
K = 24
#: Bytes that one call of the parser handles, and that one block gathers.
CHUNK, BLOCK = 1 << 18, 8 << 20
#: Phrases of one trigger that a worker may hold.
GROUP = 20_000
#: Documents in the sample for crowded triggers, and the share of them that makes a trigger crowded.
SAMPLE, CROWDED = 4000, 0.01

MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: What a byte stands for in the rolling hash of triggers (odd numbers from a fixed seed), and its base.
LETTERS = np.random.default_rng(1).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0xD6E8FEB86659FD95


def digests(raw: bytes, at: np.ndarray, size: np.ndarray, salt: bytes) -> np.ndarray:
    """Two longs for each stretch of bytes: its salted 128-bit digest."""
    h = hashlib.blake2b
    joined = b"".join([h(raw[s:e], digest_size=16, salt=salt).digest() for s, e in zip(at.tolist(), (at + size).tolist(), strict=True)])
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def suffix_ranks(buf: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The rank in lexicographic order of the ``width`` (8 or more) bytes from each place; equal ones share a rank.

    Prefix doubling: ranks of 8 bytes make those of 16, and so on; the last step
    overlaps.
    """
    eight = np.lib.stride_tricks.sliding_window_view(np.append(buf, np.zeros(7, np.uint8)), 8)
    rank, wide = np.unique(np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64), return_inverse=True)[1].astype(np.uint64), 8
    while 2 * wide <= width:
        later = np.append(rank[wide:], np.zeros(min(wide, len(rank)), np.uint64))
        rank, wide = np.unique(rank << np.uint64(32) | later, return_inverse=True)[1].astype(np.uint64), 2 * wide
    return np.unique(rank[at] << np.uint64(32) | rank[at + width - wide], return_inverse=True)[1]


class Parser:
    def __init__(self, width: int, crowded: np.ndarray, salt: bytes):
        self.width, self.crowded, self.salt = width, crowded, salt

    def windows(self, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())

    def __call__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(segment, start in raw, size, trigger, phrase) of the phrases of segments of the bytes."""
        w, long = self.width, ends - starts >= self.width
        segment, starts, counts = np.nonzero(long)[0], starts[long], (ends - starts)[long] - self.width + 1
        if not len(segment):
            return (np.empty(0, np.int64),) * 5
        b = [np.uint64(pow(BASE, 1 << k, 1 << 64)) for k in range(4)]
        h = LETTERS[np.frombuffer(raw, np.uint8)]
        for step in range(3):  # 2, 4, 8 bytes
            half = 1 << step
            h = h[:-half] * b[step] + h[half:]
        mixed = (h[:-16] * b[3] + h[8:-8]) * b[3] + h[16:]
        mixed *= MIX
        mixed ^= mixed >> np.uint64(31)
        mixed *= MIX2
        low = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(mixed), dtype=np.uint64)
        reach, wide = w - K + 1, 1
        while 2 * wide <= reach:
            low, wide = np.minimum(low[:-wide], low[wide:]), 2 * wide
        if reach > wide:
            low = np.minimum(low[: -(reach - wide)], low[reach - wide :])
        p = self.windows(starts, counts)
        of = np.repeat(segment, counts)
        at = (low[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.ones(len(p), bool)
        first[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
        i = np.nonzero(first)[0]
        a, many, trigger = p[i], np.diff(np.append(i, len(p))), mixed[at[i]].view(np.int64)
        size, seg = many + w - 1, of[i]
        hot = np.isin(trigger, self.crowded)
        cold = ~hot
        whole = digests(raw, a[cold], size[cold], self.salt)[:, 0]
        if not hot.any():
            return seg, a, size, trigger, whole
        single, n = self.windows(a[hot], many[hot]), int(many[hot].sum())
        each = digests(raw, single, np.full(n, w), self.salt)
        parts = (seg, np.repeat(seg[hot], many[hot])), (a, single), (size, np.full(n, w)), (trigger, each[:, 0])
        return *(np.concatenate([x[cold], y]) for x, y in parts), np.concatenate([whole, each[:, 1]])

    def texts(self, raws: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, start, size, trigger, phrase) for documents by number, some chunks at a time."""
        held: list[bytes] = []
        whose: list[int] = []
        bases: list[int] = []
        n = 0

        def flush() -> tuple[np.ndarray, ...]:
            sizes = np.array([len(x) for x in held], np.int64)
            ends = np.cumsum(sizes)
            seg, a, size, trigger, phrase = self(b"".join(held), ends - sizes, ends)
            return np.array(whose, np.int64)[seg], a - (ends - sizes)[seg] + np.array(bases, np.int64)[seg], size, trigger, phrase

        for number, raw in raws:
            if len(raw) < self.width:
                continue
            for base in range(0, len(raw) - self.width + 1, CHUNK):
                part = raw[base : base + CHUNK + self.width - 1]
                held.append(part)
                whose.append(number)
                bases.append(base)
                n += len(part)
                if n >= CHUNK:
                    yield flush()
                    held, whose, bases, n = [], [], [], 0
        if held:
            yield flush()


def in_order(ids: pa.Array, uids: np.ndarray) -> np.ndarray:
    """The place of each document by id and uid, nulls first; equal ones share a place."""
    t = pa.table({"id": ids, "uid": uids})
    order = pc.sort_indices(t, sort_keys=[("id", "ascending"), ("uid", "ascending")], null_placement="at_start").to_numpy()
    s = t.take(pa.array(order))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        a, b = s["id"].combine_chunks()[1:], s["id"].combine_chunks()[:-1]
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
        u = uids[order]
        new[1:] = ~(same & (u[1:] == u[:-1]))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def crowded_triggers(docs: DataFrame, width: int) -> np.ndarray:
    """Triggers that stand in different phrases in many documents of a sample of about SAMPLE documents."""
    share = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("id", "uid"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Parser(width, np.empty(0, np.int64), b"")
        for b in batches:
            for _, _, _, trigger, phrase in parse.texts((i, (b.column("text")[i].as_py() or "").encode()) for i in range(b.num_rows)):
                yield pa.RecordBatch.from_arrays([pa.array(trigger), pa.array(phrase)], names=["t", "p"])

    found = sample.mapInArrow(run, "t long, p long").distinct().groupBy("t").count()
    return np.array([r["t"] for r in found.where(F.col("count") > max(20, SAMPLE * CROWDED)).collect()], np.int64)


def dictionary(rows: DataFrame, kind: str) -> DataFrame:
    """Spans (id, uid, at, size, closer, trigger) from rows (trigger, phrase, id, uid, place).

    A place holds at, whether the row is known to be covered, and size.  Rows
    that are all but first of their phrase are covered; first ones whose
    trigger has other phrases are marked ``closer``; unique ones are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.RecordBatch | None = None  # the first row of the phrase so far
        told = False  # whether it has been put out

        def spans(b: pa.RecordBatch, pick: np.ndarray, closer: bool) -> pa.RecordBatch:
            x = b.take(pa.array(pick))
            place = x.column("place").to_numpy()
            return pa.RecordBatch.from_arrays([x.column("id"), x.column("uid"), pa.array(place >> 9), pa.array((place & 255).astype(np.int32)), pa.array(np.full(len(pick), closer)), x.column("trigger")], names=["id", "uid", "at", "size", "closer", "trigger"])

        for b in batches:
            known = (b.column("place").to_numpy() >> 8) & 1 == 1
            if known.any():
                yield spans(b, np.nonzero(known)[0], False)
                b = b.take(pa.array(np.nonzero(~known)[0]))
            if not b.num_rows:
                continue
            if carried is not None:
                b = pa.concat_batches([carried, b])
            trigger, phrase, uid, place = (b.column(c).to_numpy() for c in ("trigger", "phrase", "uid", "place"))
            new = np.ones(b.num_rows, bool)
            new[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
            heads = np.nonzero(new)[0]
            head = heads[np.cumsum(new) - 1]
            ids, theirs = b.column("id"), b.column("id").take(pa.array(head))
            same = pc.fill_null(pc.equal(ids, theirs), False).to_numpy(zero_copy_only=False) | pc.and_(ids.is_null(), theirs.is_null()).to_numpy(zero_copy_only=False)
            again = same & (uid == uid[head]) & (place == place[head])  # the head, or a repeated row
            if len(gone := np.nonzero(~again)[0]):
                yield spans(b, gone, False)
            twin = np.zeros(len(heads), bool)
            alike = trigger[heads[1:]] == trigger[heads[:-1]]
            twin[1:] |= alike
            twin[:-1] |= alike
            fresh = twin.copy()
            fresh[0] &= not (carried is not None and told)
            if fresh.any():
                yield spans(b, heads[fresh], True)
            told = bool(twin[-1]) or (len(heads) == 1 and carried is not None and told)
            carried = b.slice(heads[-1], 1)

    # What is known to be covered goes anywhere, so that a common phrase does not crowd a task.
    route = F.when(F.col("place").bitwiseAND(F.lit(256)) != 0, F.xxhash64("id", "place")).otherwise(F.col("trigger"))
    dealt = rows.repartition(route).sortWithinPartitions("trigger", "phrase", "id", "uid", "place")
    return dealt.mapInArrow(run, f"id {kind}, uid int, at long, size int, closer boolean, trigger long")


def covered(docs: DataFrame, width: int, group: int = GROUP) -> DataFrame:
    """(id, uid, at, size) of stretches whose windows all start earlier too; docs: id, uid, text."""
    kind = docs.schema["id"].dataType.simpleString()
    crowded = docs.sparkSession.sparkContext.broadcast(crowded_triggers(docs, width))
    salt = os.urandom(16)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(width, crowded.value, salt)

        def block(ids: list[pa.Array], uids: list[pa.Array], found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            if not found:
                return
            id_, uid = pa.concat_arrays(ids), pa.concat_arrays(uids)
            doc, at, size, trigger, phrase = (np.concatenate(x) for x in zip(*found, strict=True))
            by = in_order(id_, uid.to_numpy())[doc]
            order = np.lexsort((at, by, phrase, trigger))
            doc, at, size, trigger, phrase, by = (x[order] for x in (doc, at, size, trigger, phrase, by))
            new = np.ones(len(order), bool)
            new[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
            head = np.nonzero(new)[0][np.cumsum(new) - 1]
            more = (by != by[head]) | (at != at[head])
            place = (at << 9) | (more.astype(np.int64) << 8) | size
            for lo in range(0, len(order), 1 << 16):
                s = slice(lo, lo + (1 << 16))
                pick = pa.array(doc[s])
                yield pa.RecordBatch.from_arrays([pa.array(trigger[s]), pa.array(phrase[s]), id_.take(pick), uid.take(pick), pa.array(place[s])], names=["trigger", "phrase", "id", "uid", "place"])

        ids, uids, found, n, so_far = [], [], [], 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                raws = [(x or "").encode() for x in part.column("text").to_pylist()]
                found += parser.texts(zip(range(so_far, so_far + len(raws)), raws, strict=True))
                ids.append(part.column("id"))
                uids.append(part.column("uid"))
                so_far += len(raws)
                n += sum(map(len, raws))
                if n >= BLOCK:
                    yield from block(ids, uids, found)
                    ids, uids, found, n, so_far = [], [], [], 0, 0
        yield from block(ids, uids, found)

    keyed = f"trigger long, phrase long, id {kind}, uid int, place long"
    spans = stash(dictionary(docs.mapInArrow(parse, keyed), kind), "spans")
    look = spans.where("closer").select("id", "uid", "at", "size", "trigger")
    big = stash(look.groupBy("trigger").count().where(F.col("count") > group).select("trigger"), "big")

    def meet(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("id", "uid").agg(F.collect_set(F.struct("at", "size", "trigger")).alias("look"))
        return docs.join(wanted, docs["id"].eqNullSafe(wanted["id"]) & (docs["uid"] == wanted["uid"])).select(docs["id"], docs["uid"], "text", "look")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                whose, out = [], ([], [], [])
                for i in range(part.num_rows):
                    raw = part.column("text")[i].as_py().encode()
                    for s in part.column("look")[i].as_py():
                        whose.append(i)
                        for column, x in zip(out, (s["trigger"], s["at"], raw[s["at"] : s["at"] + s["size"]]), strict=True):
                            column.append(x)
                pick = pa.array(whose, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), part.column("id").take(pick), part.column("uid").take(pick), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["trigger", "id", "uid", "at", "text"])

    taken = f"trigger long, id {kind}, uid int, at long, text binary"
    small = meet(look.join(big, "trigger", "left_anti")).mapInArrow(take, taken)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Covered spans of whole groups of a trigger; some groups are sorted together."""

        def spans_of(t: pa.RecordBatch) -> pa.RecordBatch:
            size = pc.binary_length(t.column("text")).to_numpy().astype(np.int64)
            buf = np.frombuffer(b"".join(t.column("text").to_pylist()), np.uint8)
            counts = size - width + 1
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            p = np.repeat(np.cumsum(size) - size, counts) + within
            rank = suffix_ranks(buf, p, width)
            phrase = np.repeat(np.arange(len(size)), counts)
            at = t.column("at").to_numpy()[phrase] + within
            by = in_order(t.column("id"), t.column("uid").to_numpy())[phrase]
            order = np.lexsort((at, by, rank))  # the corpus order: by suffix, then by occurrence
            new = np.ones(len(order), bool)
            new[1:] = rank[order][1:] != rank[order][:-1]
            head = order[np.nonzero(new)[0][np.cumsum(new) - 1]]
            gone = np.zeros(len(p), bool)
            gone[order] = (by[order] != by[head]) | (at[order] != at[head])
            edge = np.ones(len(p), bool)
            edge[1:] = (gone[1:] != gone[:-1]) | (phrase[1:] != phrase[:-1])
            run = np.nonzero(edge)[0]
            long = np.diff(np.append(run, len(p)))
            run, long = run[gone[run]], long[gone[run]]
            pick = pa.array(phrase[run])
            return pa.RecordBatch.from_arrays([t.column("id").take(pick), t.column("uid").take(pick), pa.array(at[run]), pa.array((long + width - 1).astype(np.int32))], names=["id", "uid", "at", "size"])

        held = None
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                held = part if held is None else pa.concat_batches([held, part])
                trigger = held.column("trigger").to_numpy()
                last = int(np.searchsorted(trigger, trigger[-1]))
                if last >= 4096:
                    yield spans_of(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield spans_of(held)

    span = f"id {kind}, uid int, at long, size int"
    out = spans.where("not closer").select("id", "uid", "at", "size").unionByName(small.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(suffixes, span))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                t = b.slice(lo, 1024)
                size = pc.binary_length(t.column("text")).to_numpy().astype(np.int64)
                counts = size - width + 1
                within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                p = np.repeat(np.cumsum(size) - size, counts) + within
                whose = np.repeat(np.arange(len(size)), counts)
                each = digests(b"".join(t.column("text").to_pylist()), p, np.full(len(p), width), salt)
                yield pa.RecordBatch.from_arrays([pa.array(each[:, 0]), pa.array(each[:, 1]), t.column("id").take(pa.array(whose)), t.column("uid").take(pa.array(whose)), pa.array(((t.column("at").to_numpy()[whose] + within) << 9) | width)], names=["trigger", "phrase", "id", "uid", "place"])

    if not big.isEmpty():
        crowd = meet(look.join(big, "trigger", "left_semi")).mapInArrow(take, taken).mapInArrow(windows, keyed)
        out = out.unionByName(dictionary(crowd, kind).where("not closer").select("id", "uid", "at", "size"))
    return out


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """Remove every byte of a ``width``-byte string that also starts earlier.

    Texts are UTF-8 bytes, matches stay within documents, and earlier means a
    smaller id, or the same document and an earlier start.  Returns one row
    per row of ``docs``: its id, ``n_bytes``, ``n_removed``, ``spans`` (the
    maximal removed stretches as start and end) and ``kept`` (binary, the
    remaining bytes).

    A null text counts as empty.  A null id is smaller than all others.  Rows
    with the same id and different texts are ordered by a hash of the text;
    rows that repeat id and text are one document and get the same result.  An
    empty table gives an empty result.  Only the named columns are read.
    ``width`` must be from 32 to 139 (a phrase's size is kept in one byte).
    """
    if not 32 <= width <= 139:
        raise ValueError("width must be from 32 to 139")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(text), F.lit(1 << 31)).cast("int").alias("uid"), text.alias("text"))
    gone = covered(base, width).groupBy("id", "uid").agg(F.collect_list(F.struct("at", "size")).alias("gone"))
    met = base.join(gone, base["id"].eqNullSafe(gone["id"]) & (base["uid"] == gone["uid"]), "left").select(base["id"], "text", F.col("gone.at").alias("at"), F.col("gone.size").alias("size"))
    listed = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out: tuple[list, ...] = ([], [], [], [])
                for i in range(part.num_rows):
                    raw = part.column("text")[i].as_py().encode()
                    spans: list[tuple[int, int]] = []
                    if part.column("at")[i].is_valid:
                        edge = np.zeros(len(raw) + 2, np.int64)
                        at = part.column("at")[i].values.to_numpy()
                        np.add.at(edge, at + 1, 1)
                        np.add.at(edge, at + part.column("size")[i].values.to_numpy() + 1, -1)
                        turn = np.nonzero(np.diff(np.cumsum(edge) > 0))[0].reshape(-1, 2)
                        spans = [(int(s), int(e)) for s, e in turn]
                    keep = zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True)
                    for column, x in zip(out, (len(raw), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], b"".join(raw[s:e] for s, e in keep)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], listed), pa.array(out[3], pa.binary())], names=["id", "n_bytes", "n_removed", "spans", "kept"])

    return met.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary").withColumnRenamed("id", id_col)

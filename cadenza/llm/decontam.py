"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by documents: one row holds the postings (term hash,
count, sorted positions) of a bounded run of whole documents, and is stored in
the shared folder.  It knows nothing of a benchmark, so one index serves any
number of searches.  A search lays the benchmark's windows against each row:
windows with a term that the shard lacks drop out, the positions of a window's
rarest term (rarest in this shard) become candidate starts, and the lists of
its other terms, adjusted by their offsets, are intersected from rare to common
until only exact phrases, or with ``slop`` proximity matches, are left.
A benchmark is taken in slices of a bounded number of windows, so what is
broadcast does not grow with it.  The postings stay as they are: a slice writes
its hits alone, and only shards with hits of later slices are shuffled, without
their postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import shared, stash

#: Words that a row of the index gathers before it is closed; a longer document has a row of its own.
SHARD_WORDS = 1 << 20
#: Windows in one broadcast slice of the benchmark: at most 200,000 x 10 hashes of 8 bytes.
SLICE_WINDOWS = 200_000
#: Candidate starts that are intersected at a time.
CANDIDATES = 1 << 21

#: Bytes that are part of a word once A-Z are folded; all others part words.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(WORD_BYTES).split()


def build_index(docs: DataFrame, *, id_col: str, text_col: str, gap: int) -> DataFrame:
    """The index as rows (shard, ids, starts, n_words, terms, counts, positions); documents lie ``gap`` positions apart."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"shard string, ids array<{kind}>, starts binary, n_words binary, terms binary, counts binary, positions binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        starts: list[int] = []
        sizes: list[int] = []
        term_ids: dict[bytes, int] = {}
        stream: list[np.ndarray] = []
        end = shards = 0

        def row(id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal shards
            shards += 1
            name = pa.array([f"{TaskContext.get().partitionId()}-{shards}"])
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, term_ids), np.uint64, len(term_ids))
            by_hash = np.argsort(hashes)
            place = np.empty(len(by_hash), np.int32)
            place[by_hash] = np.arange(len(by_hash), dtype=np.int32)
            terms = place[np.concatenate(stream)] if stream else np.empty(0, np.int32)
            at = np.repeat(np.array(starts, np.int64) - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) + np.arange(len(terms))
            order = np.argsort(terms, kind="stable")
            cells = [np.array(starts, np.uint32), np.array(sizes, np.uint32), hashes[by_hash], np.bincount(terms, minlength=len(term_ids)).astype(np.uint32), at[order].astype(np.uint32)]
            flat = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(id_type))
            return pa.RecordBatch.from_arrays([name, listed, *[pa.array([x.tobytes()], pa.binary()) for x in cells]], names=["shard", "ids", "starts", "n_words", "terms", "counts", "positions"])

        for b in batches:
            for i in range(b.num_rows):
                words = words_of(b.column(1)[i].as_py())
                ids.append(b.column(0).slice(i, 1))
                starts.append(end)
                sizes.append(len(words))
                stream.append(np.fromiter((term_ids.setdefault(w, len(term_ids)) for w in words), np.int32, len(words)))
                end += len(words) + gap
                if end >= SHARD_WORDS:
                    yield row(b.schema.field(0).type)
                    ids, starts, sizes, term_ids, stream, end = [], [], [], {}, [], 0
        if ids:
            yield row(ids[0].type)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Windows:
    """Windows of one length: term hashes by offset, and the item of each."""

    def __init__(self, hashes: np.ndarray, items: list[str]):
        self.terms, flat = np.unique(hashes, return_inverse=True)
        self.at, self.items = flat.reshape(hashes.shape).astype(np.int32), pa.array(items, pa.string())


def slices(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> Iterator[list[Windows]]:
    """The benchmark's windows in slices; the driver holds one slice at a time."""
    held: dict[int, tuple[list[list[int]], list[str]]] = {}
    n = 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        h = [xxhash.xxh64_intdigest(w) for w in words_of(text)]
        size = min(width, len(h))
        for k in range(len(h) - size + 1 if h else 0):
            rows, items = held.setdefault(size, ([], []))
            rows.append(h[k : k + size])
            items.append(item or "")
            n += 1
            if n >= SLICE_WINDOWS:
                yield [Windows(np.array(r, np.uint64), i) for r, i in held.values()]
                held, n = {}, 0
    yield [Windows(np.array(r, np.uint64), i) for r, i in held.values()]


def intersect(w: Windows, terms: np.ndarray, counts: np.ndarray, keys: np.ndarray, begins: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all matches in one row of the index; keys: term's place << 32 | position, ascending."""
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(terms, w.terms), len(terms) - 1)
    there = terms[place] == w.terms
    n = np.where(there, counts[place], 0).astype(np.int64)[w.at]
    alive = np.nonzero((n > 0).all(axis=1))[0]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(n[alive], axis=1, kind="stable")
    first = n[alive, order[:, 0]] if len(alive) else np.empty(0, np.int64)
    cut = np.searchsorted(np.cumsum(first), np.arange(CANDIDATES, first.sum() + CANDIDATES, CANDIDATES), "left") + 1
    lo = 0
    for hi in np.minimum(cut, len(alive)).tolist():
        if hi <= lo:
            continue
        some, by, many = alive[lo:hi], order[lo:hi], first[lo:hi]
        lo = hi
        row = np.repeat(np.arange(len(some)), many)
        anchor = place[w.at[some, by[:, 0]]]
        inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = (keys[begins[anchor][row] + inner] & 0xFFFFFFFF).astype(np.int64) - by[row, 0]
        keep = start >= 0
        row, start = row[keep], start[keep]
        for k in range(1, by.shape[1]):
            offset = by[row, k]
            want = (place[w.at[some[row], offset]].astype(np.int64) << 32) | (start + offset)
            at = np.searchsorted(keys, want - slop)
            ok = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= want + slop)
            row, start = row[ok], start[ok]
        found.append((some[row], start))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


HITS = "hit_start array<int>, hit_size array<int>, hit_item array<string>"


def search(index: DataFrame, windows: list[Windows], slop: int = 0) -> DataFrame:
    """(shard, ids, starts, n_words, hit_start, hit_size, hit_item): what each row of the index has of these windows."""
    spread = shared(index.sparkSession, windows)
    kept = ["shard", "ids", "starts", "n_words"]
    schema = ", ".join(f"{c} {index.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = spread()
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                cell = lambda name, kind: np.frombuffer(r.column(name)[0].as_py(), kind)  # noqa: B023, E731
                terms, counts = cell("terms", np.uint64), cell("counts", np.uint32)
                keys = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) | cell("positions", np.uint32)
                begins = np.cumsum(counts, dtype=np.int64) - counts
                start, size, item = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [pa.array([], pa.string())]
                for w in held:
                    which, at = intersect(w, terms, counts, keys, begins, slop)
                    start.append(at.astype(np.int32))
                    size.append(np.full(len(at), w.at.shape[1], np.int32))
                    item.append(w.items.take(pa.array(which)))
                cells = [pa.array(np.concatenate(start)), pa.array(np.concatenate(size)), pa.concat_arrays(item)]
                one = pa.array([0, len(cells[0])], pa.int32())
                yield pa.RecordBatch.from_arrays([*(r.column(c) for c in kept), *(pa.ListArray.from_arrays(one, c) for c in cells)], names=[*kept, "hit_start", "hit_size", "hit_item"])

    return index.mapInArrow(run, f"{schema}, {HITS}")


def by_document(searched: DataFrame) -> DataFrame:
    """(id, n_words, n_hit, items) of every document of a searched index; items are sorted and distinct."""
    kind = searched.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                starts, sizes = (np.frombuffer(b.column(c)[i].as_py(), np.uint32).astype(np.int64) for c in ("starts", "n_words"))
                at, size, item = (b.column(c)[i].values for c in ("hit_start", "hit_size", "hit_item"))
                at, size = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (at, size))
                end = int(starts[-1] + sizes[-1])
                edge = np.zeros(end + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, np.minimum(at + size, end), -1)
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:end] > 0)])
                items: list[list[str]] = [[] for _ in starts]
                found = item.dictionary_encode()
                pairs = np.unique(np.searchsorted(starts + sizes, at, "right") << 32 | found.indices.to_numpy(zero_copy_only=False).astype(np.int64))
                for d, x in zip((pairs >> 32).tolist(), found.dictionary.take(pa.array(pairs & 0xFFFFFFFF)).to_pylist(), strict=True):
                    items[d].append(x)
                ids = b.column(0).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(hit[starts + sizes] - hit[starts]), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["id", "n_words", "n_hit", "items"])

    return searched.select("ids", "starts", "n_words", "hit_start", "hit_size", "hit_item").mapInArrow(run, f"id {kind}, n_words long, n_hit long, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, slop: int = 0) -> DataFrame:
    """What each document has of the benchmark's windows of ``width`` words.

    Returns one row per row of ``docs``: its id, ``n_words``, ``n_hit`` (words
    inside any occurrence of a window) and ``items`` (sorted ids, as strings,
    of the items with an occurring window).  An item of fewer words, but not
    none, is one window.  With ``slop`` over 0 each word of a window may lie up to
    that many places from its own, and the window's span counts as hit.

    Null texts have no words; null ids are kept, a null item id counts as the
    id ''.  Repeated rows and items are matched like others; an item counts
    once for a document.  Empty tables give no hits, or no rows.  Only the
    named columns are read.
    """
    index = stash(build_index(docs, id_col=id_col, text_col=text_col, gap=width + slop), "postings")
    parts = slices(benchmark, item_col, item_text_col, width)
    out = search(index, next(parts), slop)
    fields = ["hit_start", "hit_size", "hit_item"]
    later = [stash(search(index, part, slop).where(F.size("hit_start") > 0).select("shard", *fields), "hits") for part in parts]
    if later:
        found = reduce(DataFrame.unionByName, later).groupBy("shard").agg(F.collect_list(F.struct(*fields)).alias("more"))
        joined = [F.when(F.col("more").isNull(), F.col(c)).otherwise(F.concat(F.col(c), F.flatten(F.col(f"more.{c}")))).alias(c) for c in fields]
        out = out.join(found, "shard", "left").select("ids", "starts", "n_words", *joined)
    return by_document(out).withColumnRenamed("id", id_col)

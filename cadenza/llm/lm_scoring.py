"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions, and each decision (a prefix of bits) has
a context tree over the bytes before it.  A node estimates its decision by
Krichevsky and Trofimov's rule and is weighted against its children,

    Pw = 1/2 Pe + 1/2 product of the children's Pw,

so that all depths are mixed by how well they code the training corpus.

1. Texts are dealt into blocks of some megabytes, which are written.  Each block
   lists its distinct (depth + 1)-grams with their counts in training documents,
   in cells by bucket of context.
2. The cells' sums are the leaves of the tree, and every context of the corpus is
   a node.  A bucket has all contexts that end in the same three bytes, and works
   out its part of the tree; of shorter contexts a table has one row for each
   decision, grouped up and joined down depth by depth.  No process holds all.
3. Buckets of cells meet the predictions of their contexts and send the log
   probability of each gram back to its block, which scores its texts with them.
   A bucket that many blocks ask is dealt to several tasks, each with its predictions.
4. Each block's distinct words go to buckets of word hashes with their counts in
   training documents.  A bucket adds up its words over the corpus and sends the sums
   back to the blocks, which work out the unigram base scores.  No document
   travels with its words, so a word that all documents hold is one number a block.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stash
from cadenza.llm.pu_quality import held_out_fold

#: Context bytes.
DEPTH = 5
#: Stands before a text's first byte and ends every text; never a byte of UTF-8.
EDGE = 0xFF
#: Bytes of text that are counted or scored at a time, and that one block gathers.
CHUNK, BLOCK = 1 << 20, 8 << 20
#: Bytes of text for each bucket of words, and of contexts.
BUCKET_BYTES = 16 << 20
#: Bytes of cells of one bucket that one task answers, about.
ASKED_BYTES = 64 << 20
#: Contexts are dealt to buckets by their last bytes, as many as TOP, and those by the rest by this prime.
TOP, SPREAD = 3, 1_000_003
#: The word that ends a document; no word holds a line end.
END = b"\n"


def framed(raws: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with edges as one buffer; the places of symbols; how many each text has."""
    edge = bytes([EDGE])
    buf = np.frombuffer(b"".join(x for r in raws for x in (edge * depth, r, edge)), np.uint8)
    sizes = np.array([len(r) + 1 for r in raws], np.int64)
    ends = np.cumsum(sizes + depth)
    return buf, np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum()), sizes


def in_chunks(texts: Iterator[bytes], size: int) -> Iterator[list[bytes]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, n, len(u)).astype(np.int64)


def grams_of(raws: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with its context as one number, oldest byte on top; how many symbols each text has."""
    buf, at, sizes = framed(raws, depth)
    key = buf[: len(buf) - depth].astype(np.int64)
    for k in range(depth - 1, -1, -1):  # over the whole buffer in order, which is faster than to pick each byte
        key <<= 8
        key |= buf[depth - k : len(buf) - k]
    return key[at - depth], sizes


class Places:
    """Where distinct longs stand in an array: a directory of their hashes, as many searches of a sorted array wait for memory."""

    #: Odd, so no two longs share a product, and its top bits tell longs apart that differ anywhere.
    FACTOR = np.uint64(0x9E3779B97F4A7C15)
    #: Steps from a hash's first entry, after which the few that are left are searched for.
    STEPS = 8

    def __init__(self, keys: np.ndarray):
        hashes = keys.view(np.uint64) * self.FACTOR
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        bits = len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << bits), out=self.first[1:])

    def of(self, asked: np.ndarray) -> np.ndarray:
        """The place of each; all must be there."""
        hashes = asked.view(np.uint64) * self.FACTOR
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.hashes[at] != hashes)
        for _ in range(self.STEPS):
            if not len(left):
                break
            at[left] += 1
            left = left[self.hashes[at[left]] != hashes[left]]
        at[left] = np.searchsorted(self.hashes, hashes[left])
        return self.order[at]


def packed(x: np.ndarray) -> bytes:
    """Ascending longs: their steps, byte by byte, compressed."""
    return zlib.compress(np.diff(x, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.int64).ravel())


def blocked(docs: DataFrame, kind: str) -> DataFrame:
    """(block, pos, id, held, text): the rows with the block that each is dealt to and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done, pos, n = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            names, places = [], []
            for size in pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist():
                names.append(f"{own}-{done}")
                places.append(pos)
                pos, n = pos + 1, n + size + 1
                if n >= BLOCK:
                    done, pos, n = done + 1, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int32()), *(b.column(c) for c in ("id", "held", "text"))], names=["block", "pos", "id", "held", "text"])

    return docs.mapInArrow(run, f"block string, pos int, id {kind}, held boolean, text string")


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[int], list[bool], list[bytes]]]:
    """Block, places, held-out marks and folded texts of rows that follow each other; a block may come in parts."""
    now: tuple[str, list[int], list[bool], list[bytes]] | None = None
    for b in batches:
        block, pos, held, text = (b.column(c) for c in ("block", "pos", "held", "text"))
        for i in range(b.num_rows):
            if now is None or now[0] != block[i].as_py():
                if now:
                    yield now
                now = (block[i].as_py(), [], [], [])
            now[1].append(pos[i].as_py())
            now[2].append(held[i].as_py())
            now[3].append((text[i].as_py() or "").encode().lower())
    if now:
        yield now


def with_packed_texts(blocks: DataFrame, kind: str) -> DataFrame:
    """(block, pos, id, held, texts): the first row of each run of up to a chunk has the run's folded texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, text = b.column("block").to_pylist(), b.column("text")
            cells: list[bytes | None] = [None] * b.num_rows
            start, size, raws = 0, 0, []
            for i in range(b.num_rows):
                raws.append((text[i].as_py() or "").encode().lower())
                size += len(raws[-1])
                if size >= CHUNK or i + 1 == b.num_rows or block[i + 1] != block[i]:
                    cells[start] = zlib.compress(pickle.dumps(raws), 1)
                    start, size, raws = i + 1, 0, []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("block", "pos", "id", "held")), pa.array(cells, pa.binary())], names=["block", "pos", "id", "held", "texts"])

    return blocks.mapInArrow(run, f"block string, pos int, id {kind}, held boolean, texts binary")


def gram_cells(blocks: DataFrame, depth: int, buckets: int) -> DataFrame:
    """(bucket, block, grams, learned): a block's distinct grams by bucket of context, and their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, held, raws in block_runs(batches):
            parts: list[tuple[np.ndarray, np.ndarray]] = []
            for out in (False, True):
                for some in in_chunks((r for r, h in zip(raws, held, strict=True) if h == out), CHUNK):
                    u, n = np.unique(grams_of(some, depth)[0], return_counts=True)
                    parts.append((u, np.zeros_like(n) if out else n))
            keys, n = merged(parts)
            home = (keys >> 8 & ((1 << 8 * min(TOP, depth)) - 1)) % SPREAD % buckets
            order = np.argsort(home, kind="stable")
            found, edges = np.unique(home[order], return_index=True)
            cells = [[f(x) for x in np.split(c[order], edges[1:])] for c, f in ((keys, packed), (n, np.ndarray.tobytes))]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array([block] * len(found)), *(pa.array(c, pa.binary()) for c in cells)], names=["bucket", "block", "grams", "learned"])

    return blocks.mapInArrow(run, "bucket int, block string, grams binary, learned binary")


def gram_counts(cells: DataFrame) -> DataFrame:
    """(gram, n): every gram of the corpus, and how often training texts have it (0 for grams of held-out texts alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            keys, n = merged(parts)
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], names=["gram", "n"])

        for b in batches:
            for grams, learned in zip(b.column("grams"), b.column("learned"), strict=True):
                parts.append((unpacked(grams.as_py()), np.frombuffer(learned.as_py(), np.int64)))
                size += len(parts[-1][0])
                if size > 1 << 21:  # bounded memory
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > 1 << 20:
                        yield from rows()
                        parts, size = [], 0
        if parts:
            yield from rows()

    return cells.select("grams", "learned").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 6; x > 0."""
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    z = x + 6
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - np.log(low)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of Krichevsky and Trofimov's probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)


class Tree:
    """The weighted context tree of a small corpus in one process, which ``gram_scores`` is tested against.

    The child of a node by byte (0: none), log10 of each symbol's probability.
    """

    def __init__(self, depth: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, deepest: int):
        nodes, of = np.unique((depth.astype(np.int64) << 48) | context, return_inverse=True)
        size = len(nodes)
        level, ctx = nodes >> 48, nodes & ((1 << 48) - 1)
        parent = np.zeros(size, np.int64)
        self.child = np.zeros((size, 256), np.int32)
        starts = np.searchsorted(level, np.arange(deepest + 2))
        for d in range(1, deepest + 1):
            own = slice(starts[d], starts[d + 1])
            up = starts[d - 1] + np.searchsorted(ctx[starts[d - 1] : starts[d]], ctx[own] & ((1 << 8 * (d - 1)) - 1))
            parent[own] = up
            self.child[up, ctx[own] >> 8 * (d - 1)] = np.arange(own.start, own.stop)
        inner = np.zeros(size, bool)
        inner[parent[1:]] = True
        self.depth = deepest
        self.logp = np.zeros((size, 256), np.float32)
        order = np.argsort(symbol, kind="stable")
        of, symbol, n = of[order], symbol[order].astype(np.int64), n[order].astype(np.float64)
        for bit in range(8):
            # A level has 2**bit decisions; up to eight are worked out together, from their symbols alone.
            for lo in range(0, 1 << bit, 8):
                some = min(8, (1 << bit) - lo)
                first, last = np.searchsorted(symbol, (lo << (8 - bit), (lo + some) << (8 - bit)))
                column = (symbol[first:last] >> (7 - bit)) - 2 * lo
                halves = np.bincount(of[first:last] * 2 * some + column, n[first:last], size * 2 * some).reshape(size, -1)
                others = halves.copy()
                np.subtract.at(others, parent[1:], halves[1:])
                np.maximum(others, 0, out=others)
                one = self._ones(halves, others, parent, inner, starts)
                p = np.stack([1 - one, one], axis=2).reshape(size, -1)
                share = 256 >> bit
                self.logp[:, lo * share : (lo + some) * share] += np.repeat(np.log10(p), share // 2, axis=1).astype(np.float32)

    def _ones(self, halves: np.ndarray, others: np.ndarray, parent: np.ndarray, inner: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The probability of a one at every node, for each decision (column pair)."""
        a, b, ra, rb = halves[:, 0::2], halves[:, 1::2], others[:, 0::2], others[:, 1::2]
        pe = log_kt(a, b)
        below = np.where(inner[:, None], log_kt(ra, rb), 0.0)
        half = math.log(0.5)
        pw = pe.copy()
        for d in range(self.depth, -1, -1):
            own = np.arange(starts[d], starts[d + 1])
            mixed = np.logaddexp(half + pe[own], half + below[own])
            pw[own] = np.where(inner[own, None], mixed, pe[own])
            if d:
                np.add.at(below, parent[own], pw[own])
        stop = np.where(inner[:, None], np.exp(np.minimum(half + pe - pw, 0)), 1.0)
        kt = (b + 0.5) / (a + b + 1)
        so_far, left = np.zeros_like(kt), np.ones_like(kt)
        for d in range(1, self.depth + 1):
            own = np.arange(starts[d], starts[d + 1])
            up = parent[own]
            so_far[own] = so_far[up] + left[up] * stop[up] * kt[up]
            left[own] = left[up] * (1 - stop[up])
        return so_far + left * (stop * kt + (1 - stop) * (rb + 0.5) / (ra + rb + 1))

    def tables(self) -> tuple[int, np.ndarray, np.ndarray]:
        return self.depth, self.child, self.logp

    def scores(self, raws: list[bytes]) -> np.ndarray:
        return walked(self.tables(), raws)


def walked(tables: tuple[int, np.ndarray, np.ndarray], raws: list[bytes]) -> np.ndarray:
    """log10 of the probability of each text, its end included, under a tree's tables."""
    buf, at, sizes = framed(raws, tables[0])
    child, logp = tables[1].ravel(), tables[2].ravel()
    node = np.zeros(len(at), np.int32)
    alive = np.arange(len(at))
    where = at
    now = node
    for k in range(1, tables[0] + 1):
        step = child[(now << 8) | buf[where - k]]
        on = step > 0
        alive, where, now = alive[on], where[on], step[on].astype(np.int32)
        node[alive] = now
    each = logp[(node << 8) | buf[at]].astype(np.float64)
    return np.add.reduceat(each, np.cumsum(sizes) - sizes)


def subtree(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[tuple[np.ndarray, ...]]:
    """(k, zeros, ones, log Pw, share of its own estimate) of all decisions, by depth from the longest contexts to ``top``.

    ``k`` is the context's bytes, then a byte of a one and the bits decided
    before.  A decision that training has nowhere has even odds at its node and
    below, so grams of n = 0 change no other.
    """
    s = grams & 255
    ones = np.concatenate([n * (s >> (7 - bit) & 1) for bit in range(8)])
    k, at = np.unique(np.concatenate([(grams & ~255) | (1 << bit) | s >> (8 - bit) for bit in range(8)]), return_inverse=True)
    a, b = np.bincount(at, np.tile(n, 8) - ones, len(k)), np.bincount(at, ones, len(k))
    half, below, out = math.log(0.5), 0.0, []
    for d in range(depth, top - 1, -1):
        pe = np.where(a + b > 0, log_kt(a, b), 0.0)
        pw = np.logaddexp(half + pe, half + below) if out else pe
        out.append((k, a, b, pw, np.exp(np.minimum(half + pe - pw, 0)) if out else np.ones(len(k))))
        k, at = np.unique(k & ((1 << 8 * d) - 1), return_inverse=True)
        a, b, below = (np.bincount(at, x, len(k)) for x in (a, b, pw))
    return out


def log_gamma_of(x: Column) -> Column:
    """``log_gamma`` as an expression."""
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    z = x + 6
    r = 1 / (z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - F.log(low)


def from_above(rows: DataFrame, top: int) -> DataFrame:
    """(k, so_far, left): what shorter contexts say for a one, and the share they leave, at each decision of depth ``top``.

    ``rows`` has (k, a, b, pw) of that depth.
    """
    a, b = F.col("a"), F.col("b")
    pe = F.when(a + b == 0, 0.0).otherwise(log_gamma_of(a + 0.5) + log_gamma_of(b + 0.5) - log_gamma_of(a + b + 1) - math.log(math.pi))
    x, y = math.log(0.5) + F.col("pe"), math.log(0.5) + F.col("below")
    up = lambda d: F.col("k").bitwiseAND(F.lit((1 << 8 * d) - 1))
    levels = [rows]
    for d in range(top, 0, -1):
        now = levels[-1].groupBy(up(d).alias("k")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("below")).withColumn("pe", pe)
        now = now.withColumn("pw", F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))).withColumn("stop", F.exp(F.least(x - F.col("pw"), F.lit(0.0))))
        levels.append(stash(now.select("k", "a", "b", "pw", "stop"), f"level{d - 1}"))
    kt = (b + 0.5) / (a + b + 1)
    above = levels.pop().withColumns({"so_far": F.lit(0.0), "left": F.lit(1.0)})
    for d, level in enumerate(reversed(levels), 1):
        own = F.col("left") * F.col("stop")
        above = above.select(F.col("k").alias("up"), (F.col("so_far") + own * kt).alias("so_far"), (F.col("left") - own).alias("left"))
        above = level.withColumn("up", up(d)).join(above, "up")
    return above.select("k", "so_far", "left")


def gram_scores(cells: DataFrame, depth: int, buckets: int) -> DataFrame:
    """(block, grams, scores): log10 of the probability of each gram's symbol after its context."""
    top = min(TOP, depth)
    bucket = lambda context: (context.bitwiseAND(F.lit((1 << 8 * top) - 1)) % SPREAD % buckets).cast("int").alias("bucket")
    counts = stash(gram_counts(cells).select(bucket(F.shiftright("gram", 8)), "gram", "n"), "grams")

    def tops(t: pa.Table) -> pa.Table:
        k, a, b, pw, _ = subtree(t["gram"].to_numpy(), t["n"].to_numpy(), depth, top)[-1]
        return pa.table({"k": k, "a": a, "b": b, "pw": pw})

    rows = stash(counts.groupBy("bucket").applyInArrow(tops, "k long, a double, b double, pw double"), "tops")
    model = counts.unionByName(from_above(rows, top).select(bucket(F.shiftright("k", 8)), "k", "so_far", "left"), allowMissingColumns=True)

    def run(model: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:  # a part that no block was dealt to
            return pa.table({"block": pa.array([], pa.string()), "grams": pa.array([], pa.binary()), "scores": pa.array([], pa.binary())})
        learned, above = model.filter(pc.is_valid(model["gram"])), model.filter(pc.is_valid(model["k"])).sort_by("k")
        levels = subtree(learned["gram"].to_numpy(), learned["n"].to_numpy(), depth, top)
        one, left = above["so_far"].to_numpy(), above["left"].to_numpy()
        before = above["k"].to_numpy()
        for d, (k, a, b, _, stop) in zip(range(top, depth + 1), reversed(levels), strict=True):
            at = np.searchsorted(before, k & ((1 << 8 * d) - 1)) if d > top else np.arange(len(k))
            one, left, before = one[at] + left[at] * stop * (b + 0.5) / (a + b + 1), left[at] * (1 - stop), k
        grams = [unpacked(g.as_py()) for g in asked["grams"]]
        known = np.unique(np.concatenate(grams))
        symbol, logs = known & 255, np.zeros(len(known))
        for bit in range(8):
            p = one[np.searchsorted(before, (known & ~255) | (1 << bit) | symbol >> (8 - bit))]
            logs += np.log10(np.where(symbol >> (7 - bit) & 1, p, 1 - p))
        logs = logs.astype(np.float32)
        return pa.table({"block": asked["block"], "grams": asked["grams"], "scores": pa.array([logs[np.searchsorted(known, g)].tobytes() for g in grams], pa.binary())})

    parts = cells.groupBy("bucket").agg((1 + F.floor(F.sum(F.octet_length("grams")) / ASKED_BYTES)).cast("int").alias("parts"))
    asked = cells.select("bucket", "block", "grams").join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts").cast("long"))).drop("parts")
    model = model.join(parts, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
    return model.groupBy("bucket", "part").cogroup(asked.groupBy("bucket", "part")).applyInArrow(run, "block string, grams binary, scores binary")


def words_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all distinct words, ascending; the place of each word of the texts among them; how many each text has."""
    terms: dict[bytes, int] = {}
    stream = []
    for raw in raws:
        words = raw.split()
        words.append(END)
        stream.append(np.fromiter((terms.setdefault(w, len(terms)) for w in words), np.int64, len(words)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))
    by = np.argsort(hashes)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return hashes[by], place[np.concatenate(stream)], np.array([len(x) for x in stream], np.int64)


def word_cells(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, terms, counts): each block's distinct words by bucket, and how often its training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, held, raws in block_runs(batches):
            hashes, words, sizes = words_of(raws)
            count = np.bincount(words, np.repeat(~np.array(held, bool), sizes), len(hashes)).astype(np.uint32)
            found, edges = np.unique(((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), return_index=True)
            cells = [[x.tobytes() for x in np.split(c, edges[1:])] for c in (hashes, count)]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array([block] * len(found)), *(pa.array(c, pa.binary()) for c in cells)], names=["bucket", "block", "terms", "counts"])

    return blocks.mapInArrow(run, "bucket int, block string, terms binary, counts binary")


def word_totals(cells: DataFrame) -> DataFrame:
    """(block, terms, totals, tokens, types): the corpus counts of a block's words; a bucket's sums stand in one of its rows."""

    def run(t: pa.Table) -> pa.Table:
        terms, counts = ([np.frombuffer(c.as_py(), d) for c in t[name]] for name, d in (("terms", np.uint64), ("counts", np.uint32)))
        known, at = np.unique(np.concatenate(terms), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(known)).astype(np.int64)
        each = np.split(total[at], np.cumsum([len(x) for x in terms])[:-1])
        sums = ([x] + [0] * (t.num_rows - 1) for x in (int(total.sum()), int((total > 0).sum())))
        return pa.table({"block": t["block"], "terms": t["terms"], "totals": pa.array([x.tobytes() for x in each], pa.binary()), **{n: pa.array(x, pa.int64()) for n, x in zip(("tokens", "types"), sums, strict=True)}})

    return cells.groupBy("bucket").applyInArrow(run, "block string, terms binary, totals binary, tokens long, types long")


def score_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, folds: int = 7, fold: int = 2) -> DataFrame:
    """Scores of whole texts under the tree, and under add-one word counts, of the training fold.

    Rows whose crc32 of the id as text leaves ``fold`` by ``folds`` are held
    out; all others are learned from (a null id too).  A-Z are folded.  Returns one
    row per row of ``docs``: its id, ``held_out``, ``n_tokens`` (words and one
    end), ``n_known``, ``train_tokens``, ``base_score`` (log10 by words) and
    ``score`` (log10 by the tree, the end of the text included; divide by
    ``-log10(2)`` and by the bytes for bits per byte).

    The tree has every context of up to ``depth`` bytes (at most 5).

    A null text counts as empty: an end alone.  Repeated rows are learned from
    each.  With no training row every symbol has even odds.  An empty table
    gives an empty result.  Only the named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out_fold(F.col(id_col), folds, fold).alias("held"))
    blocks = stash(blocked(base, kind), "blocks")
    buckets = 1 + (blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES
    cells = stash(gram_cells(blocks, depth, buckets), "cells")
    scored = gram_scores(cells, depth, buckets)
    found = stash(word_totals(word_cells(blocks, buckets)), "word_totals")
    tokens, types = found.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    scale = math.log10(tokens + types + 1)

    def run(home: pa.Table, parts: pa.Table) -> pa.Table:
        home = home.sort_by("pos")
        n = home.num_rows
        counted = parts.filter(pc.is_valid(parts["terms"]))
        terms, totals = (np.concatenate([np.frombuffer(r.as_py(), d) for r in counted[c]]) for c, d in (("terms", np.uint64), ("totals", np.int64)))
        order = np.argsort(terms)
        terms, totals = terms[order], totals[order]
        asked = parts.filter(pc.is_valid(parts["grams"]))
        grams = np.concatenate([unpacked(r.as_py()) for r in asked["grams"]])
        each = np.concatenate([np.frombuffer(r.as_py(), np.float32) for r in asked["scores"]]).astype(np.float64)
        places = Places(grams)
        out: tuple[list[np.ndarray], ...] = ([], [], [], [])
        for raws in in_chunks((r for t in home["texts"].drop_null() for r in pickle.loads(zlib.decompress(t.as_py()))), CHUNK):
            key, sizes = grams_of(raws, depth)
            out[0].append(np.add.reduceat(each[places.of(key)], np.cumsum(sizes) - sizes))
            own, words, sizes = words_of(raws)
            c = totals[np.searchsorted(terms, own)]
            first = np.cumsum(sizes) - sizes
            for column, x in zip(out[1:], (sizes, np.add.reduceat((c > 0)[words].astype(np.int64), first), np.add.reduceat(np.log10(c + 1)[words], first)), strict=True):
                column.append(x)
        score, every, known, logs = (np.concatenate(x) for x in out)
        return pa.table({"id": home["id"], "held_out": home["held"], "n_tokens": every, "n_known": known, "train_tokens": np.full(n, tokens), "base_score": logs - every * scale, "score": score})

    parts = found.drop("tokens", "types").unionByName(scored, allowMissingColumns=True)
    out = with_packed_texts(blocks, kind).groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)

"""SimHash near-duplicate groups by pigeonhole blocks.

1. Every whole text gets a 64-bit fingerprint (one scan, Arrow batches).
2. Equal fingerprints become one node, so copies are never paired.
3. A fingerprint is split into ``b`` blocks.  Two that differ in at most ``k``
   bits agree on ``b - k`` whole blocks, so each node is put into one bucket for
   every choice of ``b - k`` blocks; ``b`` follows from the number of nodes, so
   that buckets stay small at any size, and no pair is lost.
4. Within a bucket of bounded size the Hamming distances are verified and only
   a spanning forest of the links is emitted.  Members of a larger bucket go
   to finer blocks, whose buckets cannot exceed ``2 ** free bits`` nodes.
5. Connected components are found by distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stash
from cadenza.llm.components import connected_components

#: The largest bucket that one call verifies pair by pair; beyond it finer blocks take over.
BUCKET = 4096
#: Blocks of the finer split: 4 bits each, so 3 free blocks leave at most 2**12 nodes in a bucket.
FINE_BLOCKS = 16


def fingerprints_of(texts: list[str | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text as uint64."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        if len(words) < shingle:
            pieces, n = iter([b" ".join(words)]), 1
        else:
            pieces, n = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)), len(words) - shingle + 1
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):  # bounded memory for very long texts
            ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42, by_text: bool = False) -> DataFrame:
    """(id, fp[, text_hash]) for every row; fp is the fingerprint as a signed long."""
    text = F.col(f"`{text_col}`")
    kept = docs.select(text.alias("text"), F.col(f"`{id_col}`").alias("id"), *([F.xxhash64(text).alias("text_hash")] if by_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column(0).to_pylist(), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp)], names=[*b.schema.names[1:], "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, " + ("text_hash long, " if by_text else "") + "fp long")


def choices(blocks: int, differing: int) -> list[int]:
    """The bit masks of every choice of ``blocks - differing`` blocks of 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - differing)]


def blocks_for(nodes: int, differing: int) -> int:
    """The fewest blocks whose bucket keys have more bits than the number of nodes needs."""
    need = max(16, nodes.bit_length() + 2)
    return next((b for b in range(differing + 2, FINE_BLOCKS) if 64 * (b - differing) // b >= need), FINE_BLOCKS)


def forest(fps: np.ndarray, differing: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs at most ``differing`` bits apart, a row against all others at a time."""
    n = len(fps)
    label = np.arange(n)
    a: list[int] = []
    b: list[int] = []
    for at in range(0, n, 512):
        near = np.bitwise_count(fps[at : at + 512, None] ^ fps[None, :]) <= differing
        for i, row in enumerate(near, at):
            new = np.nonzero(row & (label != label[i]))[0]
            for j in new[np.unique(label[new], return_index=True)[1]].tolist():  # one link to each tree, so n - 1 in all at most
                lo, hi = sorted((label[i], label[j]))
                label[label == hi] = lo
                a.append(i)
                b.append(j)
    return fps[a], fps[b]


def links(nodes: DataFrame, differing: int, masks: list[int], bucket: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Forest links (a, b) found in the buckets of these masks; the nodes of buckets above ``bucket``."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])).alias("c")).select("fp", "c.m", "c.k")
    sized = keyed.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = None
    if bucket is not None:
        crowded = keyed.join(sized.where(F.col("n") > bucket), ["m", "k"], "left_semi").select("fp").distinct()
        sized = sized.where(F.col("n") <= bucket)

    def run(table: pa.Table) -> pa.Table:
        a, b = forest(table.column("fp").to_numpy().view(np.uint64), differing)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    # Pairs of nodes need no worker of their own: Catalyst compares them.
    couples = keyed.join(sized.where("n = 2"), ["m", "k"], "left_semi").groupBy("m", "k").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    couples = couples.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= differing).select("a", "b")
    many = keyed.join(sized.where("n > 2"), ["m", "k"], "left_semi").groupBy("m", "k").applyInArrow(run, "a long, b long")
    return couples.unionByName(many).distinct(), crowded


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", differing: int = 3, shingle: int = 3, seed: int = 42, by_text: bool = False) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id of the group that links of at most
    ``differing`` bits reach.  A text without words (null, empty, white space)
    has fingerprint zero and is linked like any other.  Null ids are never the
    smallest, unless a group has no other.  Repeated rows come back repeated.
    An empty table gives an empty result.  Other columns are not read.  With
    ``by_text`` there is also ``text_hash``, xxhash64 of the text, which tells
    apart rows that share an id.
    """
    fps = stash(with_fingerprints(docs, id_col, text_col, shingle, seed, by_text), "fingerprints")
    nodes = stash(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    masks = choices(blocks_for(nodes.count(), differing), differing)
    found, crowded = links(nodes.select("fp"), differing, masks, BUCKET)
    found = stash(found, "links")
    crowded = stash(crowded, "crowded")
    if not crowded.isEmpty():
        found = found.unionByName(links(crowded, differing, choices(FINE_BLOCKS, differing), None)[0])
    roots = connected_components(found)
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *(["text_hash"] if by_text else []))

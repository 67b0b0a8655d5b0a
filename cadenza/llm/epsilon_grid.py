"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least t are at most eps = sqrt(2 - 2t) apart.

1. Equal vectors of a label become one row with a count.
2. The leading principal directions are fitted on a bounded sample; projecting
   on them never lengthens a distance, so they serve to prune.
3. Rows are sorted by label and by grid cell (side eps) of their projections,
   cell by cell in lexicographic order, and cut into sequence intervals of
   bounded size with their bounding boxes.
4. The join is recursive.  Stretches of ``BRANCH`` range partitions, stretches of
   those, and so on have boxes too; from the whole sequence of a label down, each
   pair of stretches whose boxes are at most eps apart is replaced by the pairs
   of their parts, as rows of a table.  What is provably distant is skipped high up.
5. The pairs of intervals that are left are compared by tile, a pair of range
   partitions: a tile gets each of its intervals once.  Within a pair of intervals
   the recursion goes on by halves, and the rest is compared in double precision.
6. A tile reports link counts by vector and a spanning forest of its links,
   never the pairs, and components follow by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stash
from cadenza.llm.components import connected_components

#: Vectors of an interval, at most; intervals of up to LEAF are compared outright.
INTERVAL, LEAF = 512, 64
#: Intervals of a range partition, about, and parts that a stretch is made of (a power of 2).
PARTITION, BRANCH = 16, 8
#: Principal directions that are projected on, and of these the ones in the grid order.
DIRECTIONS, ORDERED = 16, 6
#: Vectors that the directions are fitted on.
SAMPLE = 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / top
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def directions(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Leading principal directions by the vectors' dimension."""
    out: dict[int, np.ndarray] = {}
    for dim in {len(v) for v in sample}:
        x = unit(np.array([v for v in sample if len(v) == dim]))
        _, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))
        out[dim] = vectors[:, ::-1][:, :DIRECTIONS]
    return out


def projected(x: np.ndarray, found: dict[int, np.ndarray]) -> np.ndarray:
    """Rows of DIRECTIONS numbers; a dimension that the sample lacks uses its first axes."""
    dim = x.shape[1]
    p = x @ found.get(dim, np.eye(dim)[:, :DIRECTIONS])
    return np.pad(p, ((0, 0), (0, DIRECTIONS - p.shape[1])))


def apart(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """Squared distances between boxes (last axis: directions)."""
    gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
    return (gap * gap).sum(axis=-1)


class Pair:
    """The recursive join of two intervals (or of one with itself)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, cosine: float, same: bool):
        self.x, self.y, self.px, self.py, self.cosine, self.same = x, y, px, py, cosine, same
        self.reach = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
        self.rows: list[np.ndarray] = []
        self.cols: list[np.ndarray] = []

    def join(self, a: int, b: int, c: int, d: int) -> None:
        """Rows a:b of x against rows c:d of y."""
        if self.same and c < a:
            return  # the mirror image is visited
        p, q = self.px[a:b], self.py[c:d]
        if apart(p.min(axis=0), p.max(axis=0), q.min(axis=0), q.max(axis=0)) > self.reach:
            return
        if b - a <= LEAF and d - c <= LEAF:
            cos = self.x[a:b] @ self.y[c:d].T
            near = cos >= self.cosine
            for i, j in zip(*np.nonzero(np.abs(cos - self.cosine) < 1e-9), strict=True):  # products differ in the last bits by the order of sums
                near[i, j] = float(np.dot(self.x[a + i], self.y[c + j])) >= self.cosine
            i, j = np.nonzero(near)
            if self.same and a == c:
                i, j = i[i < j], j[i < j]
            self.rows.append(i + a)
            self.cols.append(j + c)
            return
        for s, e in self.halves(a, b):
            for s2, e2 in self.halves(c, d):
                self.join(s, e, s2, e2)

    @staticmethod
    def halves(s: int, e: int) -> list[tuple[int, int]]:
        """Two parts of whole leaves, or the stretch itself if it is a leaf."""
        if e - s <= LEAF:
            return [(s, e)]
        middle = s + max(LEAF, (e - s) // 2 // LEAF * LEAF)
        return [(s, middle), (middle, e)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        self.join(0, len(self.x), 0, len(self.y))
        return (np.concatenate(self.rows), np.concatenate(self.cols)) if self.rows else (np.empty(0, int), np.empty(0, int))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of nodes 0 to n - 1."""
    root = list(range(n))
    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        ri, rj = i, j
        while root[ri] != ri:
            root[ri] = ri = root[root[ri]]
        while root[rj] != rj:
            root[rj] = rj = root[root[rj]]
        if ri != rj:
            root[max(ri, rj)] = min(ri, rj)
            out.append((i, j))
    return out


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``.

    Vectors of equal, non-null labels link if their cosine, in double precision,
    is at least ``cosine``.  ``n_links`` counts the other rows linked directly, copies
    included; ``component_id`` is the smallest id that links reach, itself
    included; ``kept`` says that it is the row's own id.

    A vector that is null, empty or zero, or holds null or non-finite
    components, links with nothing, as does one with a null label, or with a
    dimension that no other has.  A null id is never the smallest, unless a group has no other,
    and is kept only then.  Repeated rows link like others.  An empty table
    gives an empty result.  Only the named columns are read.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine)) or 1e-6
    values = F.col(vector_col).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = F.coalesce(F.col(label_col).isNotNull() & finite & F.exists(values, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), values.alias("v"), able.alias("able")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("v")))  # two hashes that fail apart
    classes = stash(rows.where("able").groupBy("label", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.min("id").alias("least")), "classes")

    sample = [np.array(r["v"]) for r in classes.orderBy("h1", "h2").limit(SAMPLE).select("v").collect()]
    axes = spark.sparkContext.broadcast(directions(sample))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            sizes = v.value_lengths().to_numpy()
            flat = v.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            cells = np.zeros((len(sizes), ORDERED), np.int64)
            first = np.zeros(len(sizes))
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                p = projected(unit(flat[(ends[at] - dim)[:, None] + np.arange(dim)]), axes.value)
                cells[at], first[at] = np.floor(p[:, :ORDERED] / eps), p[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), *[pa.array(cells[:, k]) for k in range(ORDERED)], pa.array(first)], names=[*b.schema.names, "dim", *order, "first"])

    order = [f"c{k}" for k in range(ORDERED)]
    kind, label = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    schema = f"label {label}, h1 long, h2 long, n long, v array<double>, least {kind}"
    cells = classes.mapInArrow(keyed, f"{schema}, dim int, {', '.join(f'{c} long' for c in order)}, first double")
    parts = 1 + classes.count() // (PARTITION * INTERVAL)
    # Within a crowded cell the first direction itself goes on splitting.
    sorted_ = cells.repartitionByRange(parts, "label", "dim", *order, "first", "h1").sortWithinPartitions("label", "dim", *order, "first", "h1", "h2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names = ["interval", "label", "dim", "x", "n", "lo", "hi", "h1", "h2", "least"]

        def interval(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += INTERVAL
            dim = t["dim"][0].as_py()
            raw = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            p = projected(unit(raw), axes.value)
            box = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (p.min(axis=0), p.max(axis=0))]
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[c].combine_chunks()) for c in ("h1", "h2", "least")]
            return pa.RecordBatch.from_arrays([pa.array([number - INTERVAL]), t["label"].combine_chunks()[:1], pa.array([dim], pa.int32()), pa.array([raw.tobytes()]), pa.array([t["n"].to_numpy().astype(np.int64).tobytes()]), *box, *lists], names=names)

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            label, dim = t["label"].to_pylist(), t["dim"].to_numpy()
            edges = [0, *(np.nonzero([label[i] != label[i - 1] or dim[i] != dim[i - 1] for i in range(1, len(label))])[0] + 1).tolist(), len(label)]
            for s, e in zip(edges, edges[1:], strict=False):
                while e - s >= INTERVAL or (e < len(label) and s < e):
                    yield interval(t.slice(s, min(INTERVAL, e - s)))
                    s = min(s + INTERVAL, e)
                held = t.slice(s, e - s)
        if held is not None and held.num_rows:
            yield interval(held)

    listed = f"h1 array<long>, h2 array<long>, least array<{kind}>"
    intervals = stash(sorted_.mapInArrow(cut, f"interval long, label {label}, dim int, x binary, n binary, lo array<double>, hi array<double>, {listed}"), "intervals")

    reach = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12

    def boxes(of: DataFrame, node: Column) -> DataFrame:
        """The boxes of nodes that rows with boxes belong to."""
        edge = lambda f, c: F.array(*[f(F.col(c)[k]) for k in range(DIRECTIONS)]).alias(c)
        return of.groupBy("label", "dim", node.alias("node")).agg(edge(F.min, "lo"), edge(F.max, "hi"))

    def near(pairs: DataFrame, nodes: DataFrame, parent: Column) -> DataFrame:
        """(label, dim, up, p, q): the pairs of parts of pairs (label, dim, p, q) that are not provably distant."""
        side = lambda k, up: nodes.select("label", "dim", parent.alias(up), F.col("node").alias(k), F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(f"hi_{k}"))
        both = pairs.select("label", "dim", F.col("p").alias("up_p"), F.col("q").alias("up_q")).join(side("p", "up_p"), ["label", "dim", "up_p"]).join(side("q", "up_q"), ["label", "dim", "up_q"])
        gap = F.transform(F.arrays_zip("lo_p", "hi_p", "lo_q", "hi_q"), lambda x: F.greatest(F.lit(0.0), x["lo_p"] - x["hi_q"], x["lo_q"] - x["hi_p"]))
        return both.where((F.col("p") <= F.col("q")) & (F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= reach)).select("label", "dim", "up_p", "up_q", "p", "q")

    levels = [stash(boxes(intervals, F.shiftright("interval", 32)), "boxes")]
    bits = BRANCH.bit_length() - 1
    while levels[-1].agg(F.max("node")).first()[0]:
        levels.append(stash(boxes(levels[-1], F.shiftright("node", bits)), "boxes"))
    pairs = levels.pop().select("label", "dim", F.col("node").alias("p"), F.col("node").alias("q"))
    for nodes in reversed(levels):
        pairs = stash(near(pairs, nodes, F.shiftright("node", bits)), "pairs")
    met = near(pairs, intervals.withColumnRenamed("interval", "node"), F.shiftright("node", 32))
    tile = ["label", "dim", "up_p", "up_q"]
    ends = F.explode(F.array(F.struct(F.col("p").alias("interval"), F.col("q").alias("other")), F.struct(F.col("q").alias("interval"), F.lit(None).cast("long").alias("other"))))
    needs = met.select(*tile, ends.alias("e")).groupBy(*tile, "e.interval").agg(F.collect_list("e.other").alias("others"))
    dealt = needs.join(intervals.select("interval", "x", "n"), "interval")

    def compare(t: pa.Table) -> pa.Table:
        """Link counts by node, and a spanning forest, of the pairs of intervals of a tile."""
        dim = t["dim"][0].as_py()
        order = np.argsort(t["interval"].to_numpy())
        starts, blocks, weights = [], [], []
        for k in order.tolist():
            x = unit(np.frombuffer(t["x"][k].as_py(), np.float64).reshape(-1, dim))
            starts.append(t["interval"][k].as_py())
            blocks.append((x, projected(x, axes.value)))
            weights.append(np.frombuffer(t["n"][k].as_py(), np.int64))
        at = {i: k for k, i in enumerate(starts)}
        first = np.cumsum([0, *(len(w) for w in weights)])
        weight, counts = np.concatenate(weights), np.zeros(first[-1], np.int64)
        links: list[tuple[int, int]] = []
        for k in order.tolist():
            for j in t["others"][k].as_py():
                i = t["interval"][k].as_py()
                (x, px), (y, py) = blocks[at[i]], blocks[at[j]]
                a, c = Pair(x, y, px, py, cosine, i == j).links()
                a, c = a + first[at[i]], c + first[at[j]]
                counts += np.bincount(a, weight[c], len(counts)).astype(np.int64) + np.bincount(c, weight[a], len(counts)).astype(np.int64)
                links += forest(len(counts), a, c)
        nodes = np.concatenate([i + np.arange(len(w)) for i, w in zip(starts, weights, strict=True)])
        some = np.nonzero(counts)[0]
        tree = np.array(forest(len(counts), *np.array(links, np.int64).reshape(-1, 2).T), np.int64).reshape(-1, 2)
        return pa.table({
            "a": np.concatenate([nodes[some], nodes[tree[:, 0]]]),
            "n": pa.array([*counts[some].tolist(), *[None] * len(tree)], pa.int64()),
            "b": pa.array([*[None] * len(some), *nodes[tree[:, 1]].tolist()], pa.int64()),
        })

    found = stash(dealt.groupBy(*tile).applyInArrow(compare, "a long, n long, b long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    members = intervals.select("interval", "label", F.posexplode(F.arrays_zip("h1", "h2", "least")).alias("pos", "m"))
    nodes = members.select((F.col("interval") + F.col("pos")).alias("node"), "label", "m.h1", "m.h2", "m.least")
    nodes = nodes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component")), "root").select("label", "h1", "h2", "others", "component")
    named = named.join(classes.select("label", "h1", "h2", "n"), ["label", "h1", "h2"]).withColumn("able", F.lit(True))
    out = rows.drop("v").join(named, ["label", "h1", "h2", "able"], "left")
    component = F.when(F.col("able"), F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("able"), F.col("n") - 1 + F.coalesce("others", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )

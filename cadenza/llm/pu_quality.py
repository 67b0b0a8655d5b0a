"""Quality classifier by non-negative positive-unlabelled learning.

Trusted positives are documents whose labels all say 1; the unlabelled side is
web text at large, whatever its labels.  The share of positives in it, the
class prior, is estimated by comparing how many of either side a first
classifier puts above each threshold (the best ratio over thresholds).  The
model then minimises the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with the logistic loss, so its sigmoid estimates the probability of quality.
Both sides are bounded samples by hash of the id (``sample`` rows each);
features are taken from whole texts and every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import shared

#: Rows of either side that the model is fitted on, at most.
SAMPLE = 6000
#: Bins of hashed byte 4-grams.
BINS = 1024

#: The class of each byte: lower, upper, digit, blank, line end, full stop, comma, other stops,
#: exclamation, quotes and brackets, bar, markup, symbols, hyphen, UTF-8 lead, UTF-8 continuation.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", ";:?", "!", "'\"()[]{}", "|", "<>/\\=&", "*#$%@^~+_`", "-"]


def byte_classes() -> np.ndarray:
    out = np.full(256, 12, np.uint8)
    out[0x80:0xC0], out[0xC0:] = 15, 14
    for k, chars in enumerate(CLASSES):
        out[[ord(c) for c in chars]] = k
    return out


def features(texts: list[str | None]) -> np.ndarray:
    """A row of float32 per text: class pairs, hashed 4-grams and a few sizes."""
    kinds = byte_classes()
    out = np.zeros((len(texts), 256 + BINS + 8), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = (text or "").encode()
        if not raw:
            row[-1] = 1
            continue
        x = np.frombuffer(raw, np.uint8)
        k = kinds[x]
        pairs = np.bincount(k[:-1] * np.uint16(16) + k[1:] if len(k) > 1 else np.empty(0, np.int64), minlength=256)
        row[:256] = np.sqrt(pairs / len(raw))
        if len(raw) > 3:
            low = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
            grams = low[:-3] | low[1:-2] << np.uint32(8) | low[2:-1] << np.uint32(16) | low[3:] << np.uint32(24)
            bins = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(22), minlength=BINS)
            row[256 : 256 + BINS] = np.sqrt(bins / bins.sum())
        words, lines = raw.split(), raw.split(b"\n")
        n = max(1, len(words))
        row[-8:] = (np.log1p(len(raw)) / 10, np.log1p(len(raw) / n) / 3, len(set(words)) / n, np.log1p(len(raw) / len(lines)) / 10, len(set(lines)) / len(lines), sum(w.isupper() for w in words) / n, sum(w.isalpha() for w in words) / n, 0)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, *, steps: int = 600, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, by Adam on batches of both sides."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(pos.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p, u = (x[rng.integers(0, len(x), min(len(x), 512))] for x in (pos, unl))
        gp, gu = p @ w + b, u @ w + b
        # logistic loss: l(g, +) = log(1 + exp(-g)), l(g, -) = log(1 + exp(g))
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        plus = -prior * sigmoid(-gp) / len(gp)
        minus_u, minus_p = sigmoid(gu) / len(gu), -prior * sigmoid(gp) / len(gp)
        if rest >= 0:
            dp, du = plus + minus_p, minus_u
        else:  # the negative part has gone below zero: step back on it alone
            dp, du = -minus_p, -minus_u
        grad = np.append(dp @ p + du @ u + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The least upper confidence bound on the share of positives among the unlabelled, over thresholds.

    ``pos`` and ``unl`` are scores of rows that the scoring model hasn't seen.
    """
    cuts = np.unique(np.concatenate([pos, unl]))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, "left") / len(x)
    slack = lambda n: np.sqrt(np.log(40.0) / (2 * n))
    p, u = above(pos), above(unl)
    bound = (u + slack(len(unl)) + slack(len(pos))) / np.maximum(p, 1e-9)
    best = int(np.argmin(np.where(p > 0.05, bound, np.inf)))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None = None, seed: int = 7) -> Model:
    n = len(pos) + len(unl)
    mean = (pos.sum(axis=0, dtype=np.float64) + unl.sum(axis=0, dtype=np.float64)) / n
    square = np.einsum("ij,ij->j", pos, pos, dtype=np.float64) + np.einsum("ij,ij->j", unl, unl, dtype=np.float64)
    scale = (np.sqrt(np.maximum(square / n - mean * mean, 0)) + 0.01) * np.sqrt(pos.shape[1]) / 8
    for x in (pos, unl):  # in place: the samples are the largest thing the driver holds
        x -= mean.astype(np.float32)
        x /= scale.astype(np.float32)
    if prior is None:
        rng = np.random.default_rng(seed)
        p, u = (rng.permutation(len(x)) for x in (pos, unl))
        hp, hu = len(p) // 2, len(u) // 2
        w, b = fit_nnpu(pos[p[:hp]], unl[u[:hu]], 0.5, seed=seed)
        prior = estimate_prior(pos[p[hp:]] @ w + b, unl[u[hu:]] @ w + b)
    w, b = fit_nnpu(pos, unl, prior, seed=seed)
    return Model(mean.astype(np.float32), scale.astype(np.float32), w, b, prior)


def held_out_fold(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def samples(docs: DataFrame, labels: DataFrame, *, id_col: str, label_col: str, sample: int) -> DataFrame:
    """(id, _p): at most ``sample`` ids of positives (true), and as many of all rows (false), by least hash outside the held-out fold."""
    open_ = ~held_out_fold(F.col(id_col))
    by_hash = F.xxhash64(F.col(id_col).cast("string"))
    ids = docs.where(open_ & F.col(id_col).isNotNull()).select(id_col)
    # Ids and labels meet in one aggregate: a join of them sorts both sides, in pages of tens of MB for each task.
    said = labels.where(open_ & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).alias("_q"), F.lit(False).alias("_d"))
    met = ids.select(id_col, F.lit(None).cast(said.schema["_q"].dataType).alias("_q"), F.lit(True).alias("_d")).unionByName(said)
    good = met.groupBy(id_col).agg(F.min("_q").alias("_q"), F.max("_d").alias("_d")).where("_q = 1 and _d").select(id_col)
    pos = good.orderBy(by_hash, id_col).limit(sample).withColumn("_p", F.lit(True))
    unl = ids.distinct().orderBy(by_hash, id_col).limit(sample).withColumn("_p", F.lit(False))
    return pos.unionByName(unl)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample: int) -> Model | None:
    """The model fitted on rows outside the held-out fold; None if there are no positives or no texts to learn from."""
    chosen = samples(docs, labels, id_col=id_col, label_col=label_col, sample=sample)  # at most 2 * sample rows, so a broadcast of known size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = features(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())], names=["p", "x"])

    texts = docs.select(F.col(id_col), F.col(text_col).alias("_t")).join(F.broadcast(chosen), id_col).select("_t", "_p")
    got = texts.mapInArrow(run, "p boolean, x binary").toArrow()
    if not got.num_rows:
        return None
    x = np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.float16) for c in got["x"].chunks]).reshape(got.num_rows, -1)
    p = got["p"].to_numpy()
    if not p.any() or p.all():
        return None
    del got
    # The rows come in no set order; the fit must not depend on it.
    order = np.lexsort(x[:, :: max(1, x.shape[1] // 16)].T)
    p = p.astype(bool)
    return fit(x[order[p[order]]].astype(np.float32), x[order[~p[order]]].astype(np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = 0.7, columns: list[str] | None = None) -> DataFrame:
    """All columns of ``docs``, or ``columns`` of them, with ``_held_out``, ``_score`` (0 to 1) and ``_predicted``.

    ``labels`` holds ids and ``label_col`` of 0 and 1; only rows whose id is not
    in the held-out fold are learned from, and of the labels only who is
    positive.  A document with several labels is positive if all say 1; null
    labels say nothing.  Ids, labels and other columns are never features.

    A null text counts as empty and is scored.  A null id is scored and never
    learned from.  Repeated rows get equal scores.  Without any positive label
    every score is 0.5.  An empty table gives an empty result.  Extra columns
    are kept, whatever their names; ones called ``_held_out``, ``_score`` or
    ``_predicted`` give way to the result's.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    spread = shared(docs.sparkSession, model)
    names = [c for c in docs.columns if c not in ("_held_out", "_score", "_predicted") and (columns is None or c in columns)]
    width = len(names) + 1
    # A text that isn't asked for goes to Python behind the rest, and not back.
    sent = docs.select(*[F.col(f"`{c}`") for c in names], held_out_fold(F.col(f"`{id_col}`")).alias("_held_out"), *([] if text_col in names else [F.col(f"`{text_col}`")]))
    place = sent.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                score = sigmoid(m.logits(features(part.column(place).to_pylist()))) if m else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(score.astype(np.float64)), pa.array((score >= threshold).astype(np.int32))], names=[*part.schema.names[:width], "_score", "_predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[:width])
    return sent.mapInArrow(run, f"{schema}, _score double, _predicted int")

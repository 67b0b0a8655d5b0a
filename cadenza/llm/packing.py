"""Best-fit packing by a configuration linear program over the length histogram.

1. One scan tokenizes the documents, cuts the longer ones into pieces and
   keeps (id, piece, start, length, crc) of each.
2. The histogram of lengths (at most ``capacity`` rows) goes to the driver.
3. The configuration program, "how often is each pattern of lengths used", is
   solved there by multiplicative weights: a length's price falls as it is
   covered, and an unbounded-knapsack dynamic program finds the dearest
   pattern, which is used a little more.  The fractional use is rounded down
   to whole copies, and what is left is packed by best fit.
4. Every piece gets its rank among the pieces of its length, by salted counts,
   and the rank alone names its sequence and offset.  The allocation that is
   broadcast has a row per pattern and length, whatever the input.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import stash

#: Rows of one length that are ranked together, about.
RANKED = 512
#: Distinct words whose ids a worker remembers.
WORDS = 400_000
#: Steps of multiplicative weights; each prices one pattern.
PRICED = 400


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable Latin-1, else one from U+0100 on."""
    own = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xFF and c != 0xAD]
    rest = iter(range(0x100, 0x200))
    return [chr(c if c in own else next(rest)) for c in range(256)]


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    A tokenizer that composes (NFC), folds white space and case, splits by a
    pattern that drops white space, and then runs byte-level BPE, is run word by
    word with a memory of words: none of its steps crosses ASCII white space.
    Words of ASCII and Latin letters, which are composed already, go straight
    to its BPE model; other words go through all of it.  Any other tokenizer
    gets whole texts.
    """

    PLAIN = re.compile(r"[!-~\u00c0-\u012f\u0131-\u017f]+")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path) as f:
            made = json.load(f)
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and made["normalizer"]["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} and [x["type"] for x in splits] == ["Split", "ByteLevel"] and (splits[0]["behavior"], splits[0]["invert"], splits[1]["add_prefix_space"], splits[1]["use_regex"], made["model"]["type"]) == ("Removed", True, False, False, "BPE")
        if self.by_word:
            self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall
            self.bpe = self.tokenizer.model.tokenize
            self.letters = byte_letters()
            self.by_word = self.split("abc.") == ["abc", "."] and self.split("xyz,") == ["xyz", ","]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: bytes) -> bytes:
        """Ids of a word of a-z alone, which the pattern does not split."""
        part = word.decode()
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = b"".join(t.id.to_bytes(4, "little") for t in self.bpe(part))
        return ids

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self._letters(word)
        if word[-1:] in b".," and word[:-1].isalpha():
            return self._letters(word[:-1]) + self._word_by_pattern(word[-1:])
        return self._word_by_pattern(word)

    def _word_by_pattern(self, word: bytes) -> bytes:
        text = word.decode()
        if not self.PLAIN.fullmatch(text):
            return self._whole(text)
        out = []
        for part in self.split(text.lower()):
            ids = self.parts.get(part)
            if ids is None:
                shown = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
                ids = self.parts[part] = b"".join(t.id.to_bytes(4, "little") for t in self.bpe(shown))
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        words = text.encode().lower().split()  # folding A-Z first changes nothing: the tokenizer folds all
        known = self.words
        if len(known) > WORDS or len(self.parts) > WORDS:
            known.clear()
            self.parts.clear()
        for w in set(words).difference(known):
            known[w] = self._word(w)
        return b"".join(map(known.__getitem__, words))


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32, place[, ids]) of every document's pieces; ``place`` tells apart rows that repeat."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place = Encoder(tokenizer), TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for i in range(part.num_rows):
                    ids = encode(part.column(1)[i].as_py() or "") + end
                    for k, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[begin : begin + 4 * capacity]
                        for column, x in zip(out, (i, k, begin // 4, len(own) // 4, zlib.crc32(own), own), strict=True):
                            column.append(x)
                place += len(out[0])
                cells = [part.column(0).take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:5]], pa.array(np.arange(place - len(out[0]), place))]
                yield pa.RecordBatch.from_arrays([*cells, *([pa.array(out[5], pa.binary())] if keep_ids else [])], names=["id", "piece", "start", "length", "ids_crc32", "place", *(["ids"] if keep_ids else [])])

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, place long" + (", ids binary" if keep_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def dearest(lengths: np.ndarray, prices: np.ndarray, room: int) -> np.ndarray:
    """Counts by length of the pattern of most price that fits the room: unbounded knapsack.

    ``lengths`` ascend.  Ties go to the longer length.
    """
    best = np.zeros(room + 1)
    last = np.full(room + 1, -1)
    upto = np.searchsorted(lengths, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c], last[c] = best[c - 1], -1
        if k := upto[c]:
            total = best[c - lengths[:k]] + prices[:k]
            j = k - 1 - int(total[::-1].argmax())
            if total[j] > best[c]:
                best[c], last[c] = total[j], j
    out = np.zeros(len(lengths), np.int64)
    c = room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= int(lengths[last[c]])
    return out


def weigh(lengths: np.ndarray, counts: np.ndarray, capacity: int, steps: int, rate: float = 0.2) -> tuple[list[tuple[np.ndarray, float]], np.ndarray, float]:
    """Multiplicative weights on the configuration program: patterns with fractional use, covers, a lower bound.

    A length's weight falls with the share of its pieces that is covered; its
    price is its weight over its count.  Total price over the dearest
    pattern's is a dual solution, so it bounds the sequences from below.
    """
    log_weight = np.log(lengths / capacity * counts)
    cover = np.zeros(len(lengths))
    used: dict[bytes, list] = {}
    bound = 0.0
    for _ in range(steps):
        weight = np.exp(log_weight - log_weight.max())
        pattern = dearest(lengths, weight / counts, capacity)
        bound = max(bound, weight.sum() / float(pattern @ (weight / counts)))
        step = float((counts[pattern > 0] / pattern[pattern > 0]).min())
        used.setdefault(pattern.tobytes(), [pattern, 0.0])[1] += step
        cover += step * pattern / counts
        log_weight -= rate * step * pattern / counts
    return [(p, x) for p, x in used.values()], cover, bound


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int, fractional: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Whole copies of the patterns, most used first, while pieces last; best fit for what is left.

    Best fit takes the longest length left, then the longest that still goes
    in, and uses such a pattern as often as its pieces allow.
    """
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    left = counts.astype(np.int64).copy()

    def fix(pattern: np.ndarray, most: int | None) -> None:
        some = np.nonzero(pattern)[0]
        copies = int((left[some] // pattern[some]).min())
        copies = copies if most is None else min(copies, most)
        if copies:
            left[some] -= copies * pattern[some]
            out.append((lengths[some], pattern[some], copies))

    for pattern, x in sorted(fractional, key=lambda p: -p[1]):
        fix(pattern, int(x))
    while (left > 0).any():
        pattern, room = np.zeros(len(lengths), np.int64), capacity
        there = np.nonzero(left)[0]
        while room > 0 and (k := int(np.searchsorted(lengths[there], room, "right"))):
            at = there[k - 1]
            pattern[at] = min(left[at], room // int(lengths[at]))
            room -= int(pattern[at] * lengths[at])
            there = there[: k - 1]
        fix(pattern, None)
    return out


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, steps: int = PRICED) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Patterns (lengths, count of each, copies) that use every piece exactly once.

    ``lengths`` ascend and are distinct, ``counts`` are positive.  The fractional
    solution is rounded at a few scales (from none of it, which is best fit
    alone, to full cover), and the fewest sequences win.
    """
    if not len(lengths):
        return []
    fractional, cover, bound = weigh(lengths, counts, capacity, steps)
    best: list[tuple[np.ndarray, np.ndarray, int]] = []
    least = None
    for scale in (1 / np.median(cover[cover > 0]), 1 / cover[cover > 0].min(), 0.5 / np.median(cover[cover > 0]), 0.0):
        found = rounded(lengths, counts, capacity, [(p, x * scale) for p, x in fractional])
        n = sum(copies for _, _, copies in found)
        if least is None or n < least:
            best, least = found, n
        if least <= np.ceil(bound - 1e-6):
            break
    return best


def allocation(patterns: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, count in a sequence, offset) by length and rank."""
    rows, taken, sequence = [], {}, 0
    for lengths, counts, copies in patterns:
        offset = 0
        for size, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            rows.append((size, taken.get(size, 0), sequence, n, offset))
            taken[size] = taken.get(size, 0) + n * copies
            offset += size * n
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack the token ids of all documents into few sequences of at most ``capacity``.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor can
    read.  A document is its ids and ``end_id``; only one longer than the capacity is cut.  Returns a
    row per piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``, and with ``keep_ids`` the ids as little-endian
    uint32 bytes.

    A null or empty text has the end id alone.  Null ids and repeated rows are
    packed like others.  An empty table gives an empty result.  Only the named
    columns are read.
    """
    rows = stash(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, keep_ids=keep_ids), "pieces")
    bars = sorted((r["length"], r["count"]) for r in rows.groupBy("length").count().collect())  # at most `capacity` rows
    lengths, counts = (np.array([b[k] for b in bars], np.int64) for k in (0, 1))
    plan = allocation(solve(lengths, counts, capacity))
    spread = rows.sparkSession.sparkContext.broadcast(plan)

    salts = rows.sparkSession.createDataFrame([(n, 1 + c // RANKED) for n, c in bars], "length long, salts long")
    salted = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("place"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("place")) - 1)
    ranked = ranked.join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base", "place")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = spread.value
        keys = (plan[:, 0] << 44) | plan[:, 1]
        for b in batches:
            size, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            _, first, sequence, n, offset = plan[np.searchsorted(keys, (size << 44) | rank, "right") - 1].T
            k = rank - first
            kept = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence + k // n), pa.array(offset + k % n * size)], names=[*kept, "sequence_id", "offset"])

    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)

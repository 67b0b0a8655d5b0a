"""Line deduplication by DataFrame functions alone.

Normalised lines are exploded and hashed; the hashes that many documents hold
are counted; each document then loses the positions so found and is put
together again from the rest.  Only hashes, ids and positions are shuffled for
the count.

A line that very many rows hold is not brought together in one task: at most
``HOT`` lines can hold more than one ``HOT``-th of all rows each, so these, a
table of bounded size, are broadcast to the places, and only the others are
joined by their hash.  The texts move once, unsplit and unsorted, to meet their
dropped positions, which are small and make the hash table of that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import fold_case, stash

SPACE = " \t\n\x0b\x0c\r"
#: Lines that are broadcast, at most: those with more than a HOT-th of all places, and more than COLD of them.
HOT, COLD = 50_000, 1024


def line_keys(text: Column) -> Column:
    """The key of every line: ASCII white space off both ends, A-Z folded."""
    return F.transform(F.split(fold_case(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents share, but for the largest id's.

    Returns the columns of ``docs`` with ``text_col`` replaced by the remaining
    lines joined by a newline, and ``_n_lines`` (before) and ``_n_dropped``.

    A null text counts as empty, so as one empty line, and comes back empty.  A
    document is an id: rows with the same id count once towards ``min_docs``, a
    null id is an id of its own below all others, and rows that repeat an id
    and text get the same result.  An empty table gives an empty result.  Extra
    columns are kept, whatever their names; ones called ``_n_lines`` or
    ``_n_dropped`` give way to the result's.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    base = row.select("row", F.struct(F.col(f"row.`{id_col}`").alias("id")).alias("id"), F.xxhash64(text).alias("uid"))
    keyed = base.select("id", "uid", F.posexplode(line_keys(text)).alias("pos", "key")).where(F.length("key") >= min_chars)
    # 96 bits of hash stand for the line from here on.
    places = stash(keyed.select("id", "uid", "pos", F.xxhash64("key").alias("h1"), F.crc32(F.col("key").cast("binary")).alias("h2")), "line_places")

    held = places.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n"))
    frequent = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs)
    frequent = stash(frequent.select("h1", "h2", "n", "keeper"), "frequent_lines")
    many = max(COLD, places.count() // HOT)
    hot = frequent.where(F.col("n") > many).drop("n")
    met = places.join(F.broadcast(hot), ["h1", "h2"], "left")
    cold = met.where("keeper IS NULL").drop("keeper").join(frequent.where(F.col("n") <= many).drop("n"), ["h1", "h2"])
    gone = met.where("keeper IS NOT NULL").unionByName(cold).where(F.col("id") < F.col("keeper"))
    dropped = gone.groupBy("id", "uid").agg(F.collect_set("pos").alias("drop"))

    joined = base.join(dropped.hint("shuffle_hash"), ["id", "uid"], "left")
    lines = F.split(text, "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop")), lambda i: F.get(lines, i))
    kept = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("_n_lines", "_n_dropped")],
        F.size(lines).cast("long").alias("_n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("_n_dropped"),
    )

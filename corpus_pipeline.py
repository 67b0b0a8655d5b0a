"""The corpus pipeline: quality, lines, near duplicates, benchmark, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets as
its documents: rows that it drops are gone, texts that it changes are changed.
``run`` writes what a stage returns to the shared folder as Parquet and rereads
it, so no stage is worked out twice.  The last one returns the packed pieces.

All stages take nulls in any column, texts of any length, rows that repeat,
empty tables, and extra columns of any name, which they keep (``_held_out``,
``_score``, ``_predicted``, ``_n_lines`` and ``_n_dropped`` with values of the stage).
A document is a row; rows that share an id and have different texts are judged
each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import stash, table
from cadenza.llm.decontam import decontaminate
from cadenza.llm.line_dedup import dedup_lines
from cadenza.llm.packing import pack_documents
from cadenza.llm.pu_quality import score_quality
from cadenza.llm.queries import tokenizer_path
from cadenza.llm.simhash import simhash_groups


def row_key(id_: Column, text_hash: Column) -> Column:
    return F.struct(id_.alias("id"), text_hash.alias("text_hash"))


def rows_of(docs: DataFrame) -> DataFrame:
    """(key, row): the columns of documents as one, beside what tells a row apart."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where("_predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates; rows that repeat it stay with it."""
    groups = simhash_groups(docs, by_text=True).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.select(row_key(F.col("doc_id"), F.col("text_hash")).alias("key")).distinct()
    return rows_of(docs).join(kept, "key", "left_semi").select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows = rows_of(docs)
    found = decontaminate(rows.select("key", "row.text"), table(spark, sf_dir, "benchmark"), id_col="key")
    return rows.join(found.where("n_hit > 0").select("key").distinct(), "key", "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all that is left."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", packing),
]

#: Neither the classifier, the fingerprints nor the packing is expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

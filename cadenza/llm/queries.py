"""One query per operator over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import LOWER, UPPER, table
from cadenza.llm.decontam import decontaminate
from cadenza.llm.epsilon_grid import near_vectors
from cadenza.llm.host_text import extract_text
from cadenza.llm.line_dedup import dedup_lines
from cadenza.llm.lm_scoring import score_language
from cadenza.llm.packing import pack_documents
from cadenza.llm.pfp_dedup import dedup_substrings
from cadenza.llm.pu_quality import score_quality
from cadenza.llm.secret_scan import scan_secrets
from cadenza.llm.simhash import simhash_groups


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])
    return out.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every document."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of a document."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return score_language(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.size("items").cast("long").alias("n_items")
    return out.select("doc_id", "n_words", "n_hit", items, F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality": op2_quality,
    "op3_html_text": op3_html_text,
    "op4_secret_scan": op4_secret_scan,
    "op5_near_vectors": op5_near_vectors,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_language_scores": op8_language_scores,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
}

#: DuckDB SQL for dedup_lines with its default parameters, over documents.
LINES_SQL = f"""
lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, unnest(arr) AS line, generate_subscripts(arr, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS arr FROM {{docs}}))
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, f.key IS NOT NULL AND l.doc_id <> f.keeper AS gone FROM lines l LEFT JOIN frequent f ON l.key = f.key
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)"""

VECTORS_SQL = """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.98
), reach(i, j) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.i, l.j FROM reach r JOIN links l ON l.i = r.j
), least AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i),
counts AS (SELECT i, count(*) AS n FROM links GROUP BY i)
SELECT e.vec_id, coalesce(c.n, 0)::bigint AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.i = e.vec_id LEFT JOIN counts c ON c.i = e.vec_id
"""

#: Words of whole texts by position, from 1, and all windows of the benchmark's items.
WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{U}', '{L}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')".format(U=UPPER, L=LOWER)
DECONTAM_SQL = f"""
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM docs, sizes WHERE len(w) >= size)
), hits AS (SELECT p.doc_id, p.k, p.size, i.item_id FROM places p JOIN windows i ON p.size = i.size AND p.phrase = i.phrase),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM hits) GROUP BY doc_id)
"""

ORACLE: dict[str, str] = {
    "op5_near_vectors": VECTORS_SQL,
    "op9_line_dedup": "WITH" + LINES_SQL.format(docs="documents") + "SELECT doc_id, n_lines::bigint AS n_lines, n_dropped::bigint AS n_dropped, sha256(text) AS kept_sha256 FROM kept",
    "op10_decontamination": "WITH"
    + DECONTAM_SQL
    + """SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
}

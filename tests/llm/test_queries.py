"""Registered queries: SQL oracles, whole tables, and the pipeline stage by stage."""

from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from cadenza.llm import queries  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    cur = views(sf_dir).execute(queries.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(map(tuple, cur.fetchall()))


def test_ten_queries_and_the_pipeline_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_pipeline(spark, sf_dir):
    from cadenza.llm import decontam, line_dedup, pu_quality, simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "benchmark", "packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    a = stages["quality"](spark, docs, sf_dir).cache()
    scored = pu_quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(a) == ids(scored.where("_predicted = 1")) and a.columns == docs.columns
    assert 0.5 * docs.count() < a.count() < docs.count()

    b = stages["lines"](spark, a, sf_dir).cache()
    assert b.columns == docs.columns and ids(b) == ids(a)
    assert Counter((r.doc_id, r.text) for r in b.collect()) == Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(a).collect())
    assert all(r.n_chars == len(r.text) for r in b.collect())

    c = stages["near_duplicates"](spark, b, sf_dir).cache()
    assert ids(c) == sorted({r.component_id for r in simhash.simhash_groups(b).collect()}) and c.columns == docs.columns

    d = stages["benchmark"](spark, c, sf_dir).cache()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ids(d) == ids(decontam.decontaminate(c, bench).where("n_hit = 0")) and d.columns == docs.columns

    e = stages["packing"](spark, d, sf_dir)
    assert sorted({r.doc_id for r in e.select("doc_id").collect()}) == ids(d)
    for x in (a, b, c, d):
        x.unpersist()


AWKWARD = "doc_id long, text string, lang string, n_chars long, _t string, _n_lines string, `key` int, row int, _score double, id string"


def awkward_documents(spark):
    line = "a line that stands in more than five documents of this table"
    rows = [(None, None), (None, "null id"), (1, ""), (2, None), (3, "same text here"), (4, "same text here"), (4, "same text here")]
    rows += [(10 + k, f"{line}\nown words {k} {'abcdefgh'[k % 8] * (k + 3)} stand {k * 7919} here") for k in range(8)]
    rows += [(30, "other text under one id, quite unlike"), (30, "the benchmark holds these ten words in just this order now"), (31, "long " * 100_000)]
    return spark.createDataFrame([(i, t, None, None, "x", "y", 1, 2, 3.0, "z") for i, t in rows], AWKWARD)


def test_stages_with_awkward_tables(spark, tmp_path):
    docs = awkward_documents(spark)
    spark.createDataFrame([(k, 1, 0) for k in range(3, 40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "benchmark holds these ten words in just this order now"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    for name in ("quality", "lines", "near_duplicates", "benchmark"):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.where("_t <> 'x' or id <> 'z'").count() == 0
        empty = stages[name](spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.collect() == []
    kept = rows(stages["benchmark"](spark, docs, str(tmp_path)))
    assert rows(docs) - kept == Counter({(30, "the benchmark holds these ten words in just this order now"): 1})
    kept = rows(stages["near_duplicates"](spark, docs, str(tmp_path)))
    assert kept[(3, "same text here")] == 1 and kept[(4, "same text here")] == 0
    assert sum(n for (i, _), n in kept.items() if i == 30) == 2
    lines = stages["lines"](spark, docs, str(tmp_path)).collect()
    assert sum("more than five" in (r.text or "") for r in lines) == 1 and {r.text for r in lines if r.doc_id in (1, 2)} == {""}
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) >= docs.count()


def test_run_works_each_stage_out_once(spark, sf_dir):
    """Only the last stage is left in the plan: what it reads was written before."""
    out = corpus_pipeline.run(spark, sf_dir)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and "_predicted" not in plan
    assert out.count() > 0

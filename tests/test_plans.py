"""Registered queries of the library against their SQL."""

import math
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from cadenza.plans import oracles  # noqa: E402
from cadenza.plans.queries import QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = oracles.oracle()


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in names) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["vbr_roundtrip8", "vbr_roundtrip12", "payload_bits8", "payload_bits12"])
def test_oracle_where_deltas_meet_the_end_mark(spark, name):
    big = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{big}/events.parquet'")
    got = QUERIES[name](spark, big)
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(cur.fetchall())
    if "trip" in name:
        assert sum(r["error"] for r in got.collect()) > 0


def test_sweep(spark, sf_dir):
    assert 9_500 < QUERIES["sweep_3db"](spark, sf_dir).first().hertz < 9_800


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 10 and out.columns == ["label", "packets", "bytes", "ratio", "snr_db"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['cadenza.llm'] = None; sys.modules['corpus_pipeline'] = None\ntry:\n import __spark_entry__ as e\nexcept ModuleNotFoundError as x:\n print('name', x.name); raise\nprint(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
    assert int(done.stdout.split()[-1]) == len(QUERIES)

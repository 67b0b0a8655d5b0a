"""The command line on small folders."""

import json

import numpy as np
import pytest

from cadenza import cli
from cadenza.sources import sound


@pytest.fixture
def music(tmp_path):
    t = np.arange(9600) / 48_000
    for k, name in enumerate(("A/One/01 a.wav", "A/One/02 b.wav", "B/Two/01 a.wav")):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        tone = (np.sin(2 * np.pi * (440 + 110 * k) * t) * 9000).astype(int)
        path.write_bytes(sound.write_wav(sound.Sound(48_000, 16, [tone, tone // 2])))
    return tmp_path


def tree(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_there_and_back_with_folders(spark, music):
    cli.main(["encode", str(music / "in"), str(music / "packed")])
    assert tree(music / "packed") == ["A/One/01 a.pkt", "A/One/02 b.pkt", "B/Two/01 a.pkt"]
    cli.main(["decode", str(music / "packed"), str(music / "back")])
    assert tree(music / "back") == tree(music / "in")
    back = sound.parse((music / "back/B/Two/01 a.wav").read_bytes())
    assert (back.rate, len(back.channels), len(back.channels[0])) == (48_000, 2, 9600)


def test_all_leaves_its_own_folder_out(spark, music):
    (music / "in" / "top.wav").write_bytes((music / "in/A/One/01 a.wav").read_bytes())
    cli.main(["all", str(music / "in")])
    assert tree(music / "in" / "encoded") == ["top.pkt"]
    (music / "in" / "encoded" / "odd.wav").write_bytes(b"not a sound")
    cli.main(["all", str(music / "in"), "-r", "-y"])
    assert [p for p in tree(music / "in" / "encoded") if p.endswith(".pkt")] == ["A/One/01 a.pkt", "A/One/02 b.pkt", "B/Two/01 a.pkt", "top.pkt"]


def test_sidecars(spark, music, capsys):
    cli.main(["loudness", str(music / "in"), "--dry-run"])
    assert not list(music.rglob("loudness.json")) and "integrated_lufs" in capsys.readouterr().out
    (music / "in/B/Two/loudness.json").write_text('{"trim_db": 2.5}')
    cli.main(["loudness", str(music / "in")])
    one, two = (json.loads((music / "in" / a / "loudness.json").read_text()) for a in ("A/One", "B/Two"))
    assert [t["file"] for t in one["tracks"]] == ["01 a.wav", "02 b.wav"] and (one["trim_db"], two["trim_db"]) == (0.0, 2.5)
    cli.main(["loudness", str(music / "in"), "-r", "--skip-tracks"])
    assert json.loads((music / "in/B/Two/loudness.json").read_text())["tracks"] == []


def test_design_table(spark, tmp_path, capsys):
    cli.main(["design", "2x", str(tmp_path / "2x")])
    rows = spark.read.parquet(str(tmp_path / "2x")).collect()
    assert len(rows) == 128 and abs(sum(r.h for r in rows) - 1) < 1e-9 and "stop_db" in capsys.readouterr().out

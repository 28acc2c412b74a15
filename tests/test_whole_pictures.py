"""Rasters of whole texts: every row of the table, whatever its id, length and letters, and every byte of its text."""

from assetlake.operators import raster
from assetlake.plans import dataflows

from .test_odd_inputs import against_sql

TEXTS = ["", None, "a", "And " * 40, "\u0219\u021b \u00e9", "x" * 64, "\U0001f600" * 100, "ab" * 32 + "c"]


def test_every_text_is_a_raster(spark, tmp_path, monkeypatch):
    names = iter(("maps", "root", "out"))
    monkeypatch.setattr(dataflows, "scratch", lambda _: str(tmp_path / next(names)))
    got, want = against_sql(spark, "raster_project_build", tmp_path, [(k, "s", "en", TEXTS[k % 8]) for k in range(64)])
    assert got == want and len(got) == 64 and {r[1] for r in got} == {"UNCHANGED", "MODIFIED", "FAIL"}
    for k in range(64):
        text = (TEXTS[k % 8] or "").encode()
        assert (tmp_path / f"maps/{k}.cmap").read_bytes()[8:-64].rstrip() == text.rstrip()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0.cmap", "30.cmap", "60.cmap"]


def test_regions_of_rasters(spark):
    rows = spark.createDataFrame([("a", 2, 2, b"\x05\xff\x00\x05"), ("b", 1, 1, b"\x07"), ("c", None, None, None)], "path string, width long, height long, pixels binary")
    assert {r.path: r.region_ids for r in raster.with_regions(rows).collect()} == {"a": [0, 5, 255], "b": [7], "c": None}

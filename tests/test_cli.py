import struct

from assetlake import cli
from assetlake.sources import media

from .test_stack import build


def test_commands(spark, tmp_path, capsys):
    packs, ws, base = tmp_path / "packs", tmp_path / "ws", str(tmp_path / "base")
    packs.mkdir()
    build(packs / "a.gpk", None)
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("inspect", packs) == 0 and run("read-index", packs) == 0 and run("verify", packs) == 0
    assert run("unpack-all", packs, ws) == 0 and run("scan-assets", packs, ws) == 0 and run("summarize-assets", packs, ws) == 0
    assert run("asset-baseline", packs, ws, base) == 0 and run("asset-validate", packs, ws, base) == 0
    (ws / "a/SOUND/NOISE.BIN").write_bytes(b"edited noise")
    assert run("asset-validate", packs, ws, base) == 1 and run("asset-validate", packs, ws, base, "--allow-unknown") == 0
    assert run("repack-all", packs, ws, tmp_path / "out") == 2 and run("repack-all", packs, ws, tmp_path / "out", "--allow-unknown") == 0 and run("compare", packs, tmp_path / "out") == 0
    assert "false" in capsys.readouterr().out
    assert run("mod-build", packs, ws, tmp_path / "m.zip", "mymod", "1.0", "--allow-unknown") == 0 and run("mod-inspect", tmp_path / "m.zip") == 0
    assert run("mod-apply", packs, ws, tmp_path / "m.zip") == 2
    assert run("scan-assets", packs, ws, "--output", tmp_path / "rows") == 0 and spark.read.json(str(tmp_path / "rows")).count() == 3


def test_raster_commands(spark, tmp_path):
    maps = tmp_path / "maps"
    maps.mkdir()
    data = struct.pack("<II", 4, 2) + bytes([0, 1, 1, 0, 0, 2, 2, 0])
    (maps / "a.cmap").write_bytes(data)
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("verify-cmap", maps) == 0 and run("cmap-to-png", maps, tmp_path / "png") == 0 and run("cmap-to-color", maps, tmp_path / "color") == 0
    assert media.png_rgba((tmp_path / "color/a.png").read_bytes())[:2] == (4, 2)
    assert run("png-to-cmap", tmp_path / "png", tmp_path / "back") == 0
    assert (tmp_path / "back/a.cmap").read_bytes() == data
    assert run("color-to-cmap", tmp_path / "color", tmp_path / "back2") == 0 and (tmp_path / "back2/a.cmap").read_bytes() == data
    assert run("cmap-to-png", maps, tmp_path / "png") == 0  # the same again
    (tmp_path / "png/a.png").write_bytes(b"other")
    assert run("cmap-to-png", maps, tmp_path / "png") == 1  # never overwritten

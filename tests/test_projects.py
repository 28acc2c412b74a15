"""Container and raster projects, whole cycles."""

import struct

import pytest

from assetlake.plans.containers import ContainerProject
from assetlake.plans.rasters import RasterProject
from assetlake.sources import media

from .test_container import TREE, build


def test_container_project(spark, tmp_path):
    ref, root = tmp_path / "ref", tmp_path / "project"
    (ref / "sub").mkdir(parents=True)
    image = media.png_bytes(3, 2, bytes(6))
    tree = [(TREE[0][0], TREE[0][1], TREE[0][2], [*TREE[0][3], ("p: q", None, image, [])]), TREE[1]]
    build(ref / "sub/one.bin", tree)
    (ref / "readme.txt").write_bytes(b"loose")
    p = ContainerProject(spark, str(ref), str(root))
    assert tuple(p.build().first()) == (1, 1, 6, 0)
    assert (root / "sub/one.bin/tree/Folder/音").read_bytes() == b"OggSDEMO" and (root / "LOOSE/readme.txt").exists()
    assert p.validate().count() == 0 and p.problems().count() == 0
    with pytest.raises(FileExistsError):
        p.build()
    edit = root / "sub/one.bin/tree/Folder/p%3A q"
    edit.write_bytes(media.png_bytes(4, 2, bytes(8)))
    (root / "sub/one.bin/tree/Folder/extra").write_bytes(b"x")
    assert {(r.path, r.problem, r.severity) for r in p.validate().collect()} == {("Folder/p: q", "dimensions changed", "error"), ("sub/one.bin/tree/Folder/extra", "file is not in the project", "warning")}
    with pytest.raises(ValueError, match="dimensions changed"):
        p.repack(str(tmp_path / "out"))
    done = {r.container: (r.objects, r.changed, r.error) for r in p.repack(str(tmp_path / "out"), allow_png_dimension_change=True).collect()}
    assert done == {"sub/one.bin": (6, 1, None), "readme.txt": (0, 0, None)} and (tmp_path / "out/readme.txt").read_bytes() == b"loose"
    again = ContainerProject(spark, str(tmp_path / "out"), str(tmp_path / "again"))
    again.build()
    assert (tmp_path / "again/sub/one.bin/tree/Folder/p%3A q").read_bytes() == edit.read_bytes()
    edit.unlink()
    build(ref / "sub/one.bin", TREE)  # another reference
    problems = {r.problem for r in p.validate().where("severity = 'error'").collect()}
    assert any(x.startswith("reference: ") for x in problems)


def test_raster_project(spark, tmp_path):
    maps, pics, root = tmp_path / "maps", tmp_path / "pics", tmp_path / "project"
    (maps / "a").mkdir(parents=True)
    (pics / "a").mkdir(parents=True)
    put = lambda name, w, h, data: (maps / name).write_bytes(struct.pack("<II", w, h) + data)
    put("a/TITLE_WIDE.CMAP", 4, 2, bytes([0, 1, 1, 0, 0, 2, 2, 0]))
    put("a/plain.cmap", 2, 2, bytes([5, 6, 5, 6]))
    put("a/bad.cmap", 9, 9, b"short")
    (pics / "a/TITLE.PNG").write_bytes(media.png_bytes(2, 2, bytes([0, 80, 160, 240])))
    p = RasterProject(spark, str(maps), str(root))
    rows = {r.path: r for r in p.export(str(pics)).collect()}
    assert rows["a/TITLE_WIDE.CMAP"].region_ids == [0, 1, 2] and rows["a/TITLE_WIDE.CMAP"].picture == "a/TITLE.PNG" and rows["a/TITLE_WIDE.CMAP"].overlay_error is None
    assert rows["a/plain.cmap"].picture is None and "length" in rows["a/bad.cmap"].error
    w, h, pixels = media.png_rgba((root / "overlay/a/TITLE_WIDE.png").read_bytes())
    assert (w, h) == (4, 2) and pixels[0].tolist() == [0, 0, 0, 255] and pixels[1].tolist() != [0, 0, 0, 255]
    assert {r.path: r.status for r in p.build(str(tmp_path / "none")).collect()} == {"a/TITLE_WIDE.CMAP": "UNCHANGED", "a/plain.cmap": "UNCHANGED"}
    (root / "edit/a/TITLE_WIDE.png").write_bytes(media.png_bytes(4, 2, bytes([1, 1, 1, 0, 0, 2, 2, 2])))
    (root / "edit/a/plain.png").write_bytes(media.png_bytes(2, 2, bytes([5, 6, 7, 6])))
    got = {r.path: (r.status, r.error) for r in p.build(str(tmp_path / "out")).collect()}
    assert got == {"a/TITLE_WIDE.CMAP": ("MODIFIED", None), "a/plain.cmap": ("FAIL", "new region IDs: 7")}
    assert (tmp_path / "out/a/TITLE_WIDE.cmap").read_bytes() == struct.pack("<II", 4, 2) + bytes([1, 1, 1, 0, 0, 2, 2, 2])
    (root / "edit/a/plain.png").unlink()
    assert {r.path: r.error for r in p.build(str(tmp_path / "next")).collect()}["a/plain.cmap"] == "the picture is missing"

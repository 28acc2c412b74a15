"""Packages of which files are deflated by tasks, and what a package cycle reads of a workspace."""

import hashlib
import json
import os
import zipfile

import pytest

from assetlake.plans.session import CatalogSession
from assetlake.sources import packages as p

FILES = {"a.txt": b"some words " * 50, "empty.txt": b"", "b.png": bytes(range(256)), "c/long.txt": b"line\n" * 3000}


def rows(spark, folder):
    out = []
    for path, data in FILES.items():
        at = folder / "x" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
        out.append(("x", path, f"files/x/{path}", len(data), "0" * 64, hashlib.sha256(data).hexdigest(), str(at)))
    return spark.createDataFrame(out, "archive string, path string, member string, size_bytes long, original_sha256 string, modified_sha256 string, location string")


@pytest.mark.parametrize("most", [p.MOST_PACKED, 600, -1])
def test_members_are_packed_by_tasks(spark, tmp_path, monkeypatch, most):
    """Whether tasks pack the files or the writer streams those that are longer."""
    monkeypatch.setattr(p, "MOST_PACKED", most)
    target = str(tmp_path / "a.zip")
    files = rows(spark, tmp_path)
    assert {r.path for r in p._packed(files).where("packed is null").collect()} == {k for k, v in FILES.items() if len(v) > most}
    p.build(files, target, {"id": "abc", "version": "1", "name": "é"})
    with zipfile.ZipFile(target) as z:
        assert z.testzip() is None
        assert {n: z.read(n) for n in z.namelist() if n != p.MANIFEST} == {f"files/x/{k}": v for k, v in FILES.items()}
        told = json.loads(z.read(p.MANIFEST))
    assert told["name"] == "é" and [f["path"] for f in told["files"]] == sorted(FILES) and set(told["files"][0]) == {"archive", "path", "member", "size_bytes", "original_sha256", "modified_sha256"}
    assert p.inspected(spark.createDataFrame([("a.zip", target)], "path string, location string")).count() == 0


def test_files_that_change_while_they_are_packed(spark, tmp_path):
    files = rows(spark, tmp_path)
    (tmp_path / "x/a.txt").write_bytes(b"other words" * 50)
    (tmp_path / "x/empty.txt").write_bytes(b"longer")
    with pytest.raises(ValueError, match="changed while it was packed"):
        p.build(files, str(tmp_path / "a.zip"), {"id": "abc", "version": "1", "name": "n"})
    assert os.listdir(tmp_path) == ["x"]


def test_only_named_files_are_read(spark, tmp_path):
    rows(spark, tmp_path)
    (tmp_path / ".assetlake").mkdir()
    s = CatalogSession(spark, str(tmp_path / "packs"), str(tmp_path))
    named = spark.createDataFrame([("X", "a.txt"), ("x", "a.txt"), ("x", "c"), ("x", "none.txt"), ("y", "a.txt")], "archive string, path string")
    got = s._named(named).collect()
    assert [(r.archive, r.path, r["size"], r.sha256) for r in got] == [("x", "a.txt", 550, hashlib.sha256(FILES["a.txt"]).hexdigest())]


def installed(spark, tmp_path, damaged=None):
    """Applies a package of new texts for all files; of a damaged one the manifest has another digest."""
    rows(spark, tmp_path / "ws")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for path in FILES:
            z.writestr(f"files/x/{path}", f"new {path}")
    manifest = [("x", path, f"files/x/{path}", hashlib.sha256(f"new {path}{'!' if path == damaged else ''}".encode()).hexdigest()) for path in FILES]
    plan = spark.createDataFrame([("x", path, None) for path in FILES], "archive string, path string, failure string")
    return p.apply(str(tmp_path / "a.zip"), spark.createDataFrame(manifest, "archive string, path string, member string, modified_sha256 string"), plan, str(tmp_path / "ws"), str(tmp_path / "ws/.assetlake/backup"))


def test_originals_become_backups(spark, tmp_path):
    rows(spark, tmp_path / "ws")
    (tmp_path / "kept").mkdir()
    os.link(tmp_path / "ws/x/c/long.txt", tmp_path / "kept/long.txt")
    inode = os.stat(tmp_path / "kept/long.txt").st_ino
    assert installed(spark, tmp_path) == sorted(str(tmp_path / "ws/x" / path) for path in FILES)
    back = tmp_path / "ws/.assetlake/backup/x"
    assert {path: (back / path).read_bytes() for path in FILES} == FILES and os.stat(back / "c/long.txt").st_ino == inode  # not copied
    assert all((tmp_path / "ws/x" / path).read_text() == f"new {path}" for path in FILES)


def test_damaged_package_leaves_all_as_it_was(spark, tmp_path):
    with pytest.raises(ValueError, match="damaged"):
        installed(spark, tmp_path, damaged="b.png")
    assert {str(f.relative_to(tmp_path / "ws/x")): f.read_bytes() for f in (tmp_path / "ws").rglob("*") if f.is_file()} == FILES


def test_workspace_is_listed_once(spark, tmp_path, monkeypatch):
    """A package, and its installation and removal, list the workspace once between them."""
    from .test_stack import build

    (tmp_path / "packs").mkdir()
    build(tmp_path / "packs/one.gpk", b"0123456789ABCDEFG")
    s = CatalogSession(spark, str(tmp_path / "packs"), str(tmp_path / "ws"), b"0123456789ABCDEFG")
    s.unpack()
    calls, files = [], CatalogSession.files
    monkeypatch.setattr(CatalogSession, "files", lambda self: calls.append(1) or files(self))
    edit = tmp_path / "ws/one/TEXT/FIRST.INI"
    original = edit.read_bytes()
    edit.write_bytes(b"[Window]\r\nwidth=mod\r\n")
    s.package(str(tmp_path / "a.zip"), {"id": "abc", "version": "1", "name": "n"})
    edit.write_bytes(original)
    assert s.install(str(tmp_path / "a.zip")) == [str(edit)] and edit.read_bytes() != original
    assert s.uninstall() == [str(edit)] and edit.read_bytes() == original
    assert len(calls) == 1

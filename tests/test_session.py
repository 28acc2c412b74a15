import os

import pytest
from pyspark.sql import functions as F

from assetlake.plans.session import CatalogSession, ValidationBlocked
from assetlake.sources import media, packages
from assetlake.streaming.incremental import current, keep_catalog

from .test_stack import FILES, NAMES, build


@pytest.fixture
def session(spark, tmp_path):
    packs = tmp_path / "packs"
    packs.mkdir()
    build(packs / "One.GPK", None, {**FILES, "IMG/A.PNG": media.png_bytes(4, 2, bytes(8)), "IMG/B.PNG": media.png_bytes(4, 2, bytes(8))})
    build(packs / "two.gpk", b"0123456789ABCDEF")
    return CatalogSession(spark, str(packs), str(tmp_path / "ws"), b"0123456789ABCDEF")


def counts(df, column):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def test_whole_cycle(spark, session, tmp_path):
    assert {r.name: r.stack_footer.valid for r in session.archives(digest=True).collect()} == {"One.GPK": True, "two.gpk": True}
    assert counts(session.unpack(), "error") == {None: 8}
    assert session.unpack().count() == 0
    ws = tmp_path / "ws"
    assert counts(session.refresh(), "state") == {"original": 8}
    base = session.baseline().cache()
    assert counts(base, "status") == {"PASS": 8}
    (ws / "One/TEXT/FIRST.INI").write_bytes(b"[Window]\r\nwidth=changed\r\n")
    (ws / "One/IMG/A.PNG").write_bytes(media.png_bytes(5, 2, bytes(10)))
    (ws / "One/IMG/B.PNG").write_bytes(media.png_bytes(4, 2, bytes(range(8))))
    (ws / "two/new.txt").write_bytes(b"new")
    assert counts(session.refresh(), "state") == {"original": 5, "modificado": 3, "novo": 1}
    got = {(r.path, r.status): r.error for r in session.validate(base).where("status != 'UNCHANGED'").collect()}
    assert got == {("IMG/A.PNG", "FAIL"): "dimensions changed", ("IMG/B.PNG", "PASS"): None, ("TEXT/FIRST.INI", "PASS"): None, ("new.txt", "FAIL"): "Extra entries are unsupported"}
    with pytest.raises(ValidationBlocked, match="dimensions changed"):
        session.repack(str(tmp_path / "out"), ["one"])
    assert session.last_validation.invalid == 1 and not (tmp_path / "out").exists()
    with pytest.raises(ValidationBlocked, match="not in the index"):  # a file too many blocks in every mode
        session.repack(str(tmp_path / "out"), mode="experimental")
    assert counts(session.refresh(check=True), "state") == {"original": 5, "modificado": 2, "inválido": 1, "novo": 1}
    order = [(r.archive, r.path) for r in session.natural(session.refresh()).orderBy("row").collect()]
    assert order[:2] == [("One", NAMES[0]), ("One", NAMES[1])] and order[-1] == ("two", "new.txt") and len(order) == 9
    done = session.repack(str(tmp_path / "out"), ["ONE"], "experimental").collect()
    assert [(r.archive, r.entries, r.modified, r.error) for r in done] == [("One.GPK", 5, 3, None)] and session.last_validation.status == "WARN"
    levels = {r.level for r in session.summary().collect()}
    assert levels == {"total", "extension", "format", "archive", "archive_extension", "archive_format"}
    again = CatalogSession(spark, str(tmp_path / "out"), str(tmp_path / "ws2"))
    again.unpack()
    assert (tmp_path / "ws2/One/TEXT/FIRST.INI").read_bytes() == (ws / "One/TEXT/FIRST.INI").read_bytes()


def test_packages(spark, session, tmp_path):
    session.unpack()
    ws = tmp_path / "ws"
    target, original = ws / "two/TEXT/FIRST.INI", FILES["TEXT/FIRST.INI"]
    target.write_bytes(b"[Window]\r\nwidth=mod\r\n")
    package = str(tmp_path / "a.zip")
    plan = packages.edited(session.recorded(), session.files())
    assert [(r.member, r.size_bytes) for r in plan.collect()] == [("files/two/TEXT/FIRST.INI", 21)]
    with pytest.raises(ValueError, match="changed since"):
        session.package(package, {"id": "abc", "version": "1", "name": "n"}, expected="other")
    session.package(package, {"id": "abc", "version": "1", "name": "n"})
    with pytest.raises(ValueError, match="file was edited"):
        session.install(package)
    target.write_bytes(original)
    assert session.install(package) == [str(target)] and target.read_bytes() != original
    assert session.uninstall() == [str(target)] and target.read_bytes() == original
    assert session.uninstall() == []
    data = open(package, "rb").read()
    open(package, "wb").write(data.replace(b"files/two/TEXT/FIRST.INI", b"files/two/TEXT/OTHER.INI"))
    row = spark.createDataFrame([("a.zip", package)], "path string, location string")
    assert {r.problem for r in packages.inspected(row).collect()} >= {"extra: files/two/TEXT/OTHER.INI"}


def test_incremental_catalog(spark, tmp_path):
    scans, state, checkpoint = (str(tmp_path / x) for x in ("scans", "state", "cp"))
    schema = "archive string, path string, size long, scanned_at long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(scans)
    put([("a", "x", 1, 1), ("a", "y", 2, 1)])
    keep_catalog(spark, scans, schema, state, checkpoint).awaitTermination()
    put([("a", "x", 5, 2), ("b", "z", 3, 2), ("a", "y", 9, 0)])
    keep_catalog(spark, scans, schema, state, checkpoint).awaitTermination()
    assert {(r.archive, r.path): r["size"] for r in current(spark, state).collect()} == {("a", "x"): 5, ("a", "y"): 2, ("b", "z"): 3}
    assert current(spark, str(tmp_path / "none")) is None
    for n in range(3, 9):
        put([("a", "x", n, n)])
        keep_catalog(spark, scans, schema, state, checkpoint, every=3).awaitTermination()
    got = {(r.archive, r.path): r["size"] for r in current(spark, state).collect()}
    assert got == {("a", "x"): 8, ("a", "y"): 2, ("b", "z"): 3}
    assert sorted(os.listdir(state)) == [f"{kind}={n:010d}" for kind, n in (("base", 2), ("base", 5), *(("delta", n) for n in range(3, 8)))]  # one older base stays
    assert os.path.exists(state) and current(spark, state).where(F.col("size") > 4).count() == 1


def test_selection_resume_and_restore(spark, session, tmp_path):
    name = lambda *rows: spark.createDataFrame(list(rows), "archive string, path string")
    got = session.extract(name(("two", NAMES[0]), ("two", "no such file")))
    assert got == {"newly": 1, "already": 0, "restored": 0, "failed": 0, "status": "PASS"}
    assert counts(session.refresh(), "state") == {"original": 1, "não extraído": 7}
    assert session.extract(folders=[("two", "")])["newly"] == 2
    edited = tmp_path / "ws/two" / NAMES[0]
    edited.write_bytes(b"mine")
    assert session.extract(folders=[("two", "")]) == {"newly": 0, "already": 3, "restored": 0, "failed": 0, "status": "PASS"} and edited.read_bytes() == b"mine"
    (tmp_path / "ws/two" / NAMES[1]).unlink()
    assert session.extract(folders=[("two", "")], restore=True) == {"newly": 0, "already": 1, "restored": 2, "failed": 0, "status": "PASS"}
    assert counts(session.refresh(), "state") == {"original": 3, "não extraído": 5}


def test_batches(spark, session, tmp_path, monkeypatch):
    (tmp_path / "packs/bad.gpk").write_bytes(b"x" * 100)
    status = lambda df: {r.archive: r.status for r in df.collect()}
    assert status(session.unpack_all(stop_on_error=True)) == {"One": "NOT_RUN", "two": "NOT_RUN", "bad": "FAILED"}
    with monkeypatch.context() as m:
        m.setattr("shutil.disk_usage", lambda path: type("D", (), {"free": 0}))
        assert status(session.unpack_all())["One"] == "INSUFFICIENT_SPACE" and not (tmp_path / "ws/One").exists()
    assert status(session.unpack_all()) == {"One": "PASS", "two": "PASS", "bad": "FAILED"}
    assert status(session.unpack_all()) == {"One": "SKIPPED_COMPLETE", "two": "SKIPPED_COMPLETE", "bad": "FAILED"}
    out = str(tmp_path / "out")
    assert status(session.repack_all(out)) == {"One": "PASS", "two": "PASS"}
    assert status(session.repack_all(out)) == {"One": "SKIPPED_COMPLETE", "two": "SKIPPED_COMPLETE"}
    (tmp_path / "ws/two" / NAMES[0]).write_bytes(FILES[NAMES[0]] + b"; more\r\n")
    assert status(session.repack_all(out)) == {"One": "SKIPPED_COMPLETE", "two": "FAILED"}  # another file is there
    assert status(session.repack_all(str(tmp_path / "next"))) == {"One": "PASS", "two": "PASS"}
    base = session.baseline(allow_unknown=False)
    assert counts(base.where("archive = 'One'"), "status") == {"PASS": 4, "FAIL": 1}

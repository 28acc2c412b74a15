import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from assetlake.sources.catalog import file_catalog
from assetlake.sources.stack import KEYS, extracted, payloads, rebuilt, stack_index, xor

NAMES = ["TEXT/FIRST.INI", "SOUND/NOISE.BIN", "TEXT/LONG.TXT"]
FILES = dict(zip(NAMES, [b"[Window]\r\nwidth=640\r\n", bytes(range(256)) * 3, b"line after line\n" * 5000], strict=True))
#: How each kind of entry is stored: packed or not, and how many of its first bytes its record holds.
STORED = {".INI": (True, 7), ".TXT": (True, 0), ".BIN": (False, 16), ".PNG": (False, 4)}


def build(path, key, files=FILES):
    """An archive from rows of (name, stored bytes, length, packed, bytes in the record); the body is laid out first."""
    rows = []
    for name, data in files.items():
        packed, head = STORED[name[-4:]]
        rows.append((name, zlib.compress(data, 1) if packed else data, len(data), packed, head))
    start = 10
    offsets = [start + sum(len(s) - h for _, s, _, _, h in rows[:k]) for k in range(len(rows))]
    body = bytes(start) + b"".join(s[h:] for _, s, _, _, h in rows)

    def record(row, offset):
        name, stored, length, packed, head = row
        tag = b"DFLT" if packed else bytes(4)
        return b"".join([len(name).to_bytes(2, "little"), name.encode("utf-16-le"), struct.pack("<ihII", -5, 6, offset, len(stored)), tag, struct.pack("<IB", length if packed else 0, head), stored[:head]])

    table = b"".join(map(record, rows, offsets)) + bytes(2) + b"what follows"
    index = len(table).to_bytes(4, "little") + zlib.compress(table)
    if key:
        index = xor(index, key)
    path.write_bytes(b"".join([body, index, b"STKFile0PIDX", len(index).to_bytes(4, "little"), b"STKFile0PACKFILE"]))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("packs")
    build(root / "a.gpk", b"0123456789ABCDEFG")
    build(root / "b.gpk", KEYS[1][1])
    build(root / "c.gpk", None)
    (root / "broken.gpk").write_bytes(b"x" * 100)
    (root / "empty.gpk").write_bytes(b"")
    (root / "_hidden").mkdir()
    (root / "_hidden" / ".dot").write_bytes(b"z")
    return root


def test_catalog_lists_every_file(spark, folder):
    rows = {r.path: r for r in file_catalog(spark, str(folder), digest=True, content=True).collect()}
    assert set(rows) == {"a.gpk", "b.gpk", "c.gpk", "broken.gpk", "empty.gpk", "_hidden/.dot"}
    assert rows["empty.gpk"].size == 0 and rows["_hidden/.dot"].content == b"z"
    assert rows["a.gpk"].sha256 == hashlib.sha256((folder / "a.gpk").read_bytes()).hexdigest()
    assert file_catalog(spark, str(folder / "none")).count() == 0


def test_index_and_payloads(spark, folder):
    entries = stack_index(file_catalog(spark, str(folder)).where("path like '%.gpk'"), b"0123456789ABCDEFG").cache()
    rows = entries.collect()
    assert {r.archive: r.key_name for r in rows if r.ordinal == 1} == {"a.gpk": "given", "b.gpk": "B", "c.gpk": "none"}
    assert {r.archive: r.error for r in rows if r.error} == {"broken.gpk": "no valid footer", "empty.gpk": "no valid footer"}
    assert [r.path for r in sorted((r for r in rows if r.archive == "b.gpk"), key=lambda r: r.ordinal)] == NAMES
    assert {r.compression_tag for r in rows if r.is_packed} == {"DFLT"}
    got = payloads(entries).collect()
    assert len(got) == 9 and all(r.content == FILES[r.path] and r.sha256 == hashlib.sha256(FILES[r.path]).hexdigest() for r in got)
    assert payloads(entries.withColumn("unpacked_size", F.lit(7)), with_content=False).where("error is not null").count() == 9
    wrong = stack_index(file_catalog(spark, str(folder)).where("path = 'a.gpk'"), b"other").collect()
    assert len(wrong) == 1 and "no key opens the index" in wrong[0].error


def test_rebuild_and_extract(spark, folder, tmp_path):
    entries = stack_index(file_catalog(spark, str(folder)).where("path like '%.gpk'"), b"0123456789ABCDEFG").cache()
    edit, short = tmp_path / "edit.ini", tmp_path / "short.bin"
    edit.write_bytes(b"[Window]\r\nwidth=640, and more than before\r\n")
    short.write_bytes(b"x")
    edits = spark.createDataFrame([("a.gpk", "TEXT/FIRST.INI", str(edit)), ("a.gpk", "SOUND/NOISE.BIN", str(short))], "archive string, path string, source string")
    out = tmp_path / "out"
    done = {r.archive: r for r in rebuilt(entries, edits, str(out)).collect()}
    assert {a: (r.entries, r.modified, r.error) for a, r in done.items()} == {"a.gpk": (3, 2, None), "b.gpk": (3, 0, None), "c.gpk": (3, 0, None)}
    again = stack_index(file_catalog(spark, str(out)), b"0123456789ABCDEFG")
    want = {**FILES, "TEXT/FIRST.INI": edit.read_bytes(), "SOUND/NOISE.BIN": b"x"}
    assert {r.path: r.content for r in payloads(again.where("archive = 'a.gpk'")).collect()} == want
    assert {r.path: r.content for r in payloads(again.where("archive = 'b.gpk'")).collect()} == FILES
    assert [r.error for r in rebuilt(entries, edits, str(out)).collect()] == [None] * 3  # a repeated run writes the same
    other = {r.archive: r.error for r in rebuilt(entries, edits.limit(0), str(out)).collect()}
    assert "already" in other["a.gpk"] and other["b.gpk"] is None
    files = extracted(again, str(tmp_path / "ws")).collect()
    assert all(r.error is None for r in files) and (tmp_path / "ws/a/TEXT/FIRST.INI").read_bytes() == edit.read_bytes()
    assert all(r.error is None for r in extracted(again, str(tmp_path / "ws")).collect())
    (tmp_path / "ws/b/TEXT/FIRST.INI").write_bytes(b"edited")
    assert {r.archive: r.error for r in extracted(again, str(tmp_path / "ws")).collect() if r.error} == {"b.gpk": "another file is there already"}

import struct


from assetlake.functions import formats
from assetlake.sources.catalog import file_catalog
from assetlake.sources.container import laid_out, objects, rebuilt, safe_component, tree_paths, typed

PREFIX = bytes.fromhex(formats.CONTAINER)


def size_code(n):
    rotated = ((n << 13) | (n >> 19)) & 0xFFFFFFFF
    return (0xE7B5D9F8 + rotated + (n & 0xFFF)) & 0xFFFFFFFF


def build(path, tree, wrong=False):
    """tree: [(name, declared class or None, payload, children)]"""
    flat = []

    def table(nodes, offsets):
        out = b""
        for name, declared, payload, children in nodes:
            k = len(flat)
            flat.append(payload)
            raw = name.encode("cp932")
            out += bytes([len(raw)]) + raw + b"\x08\xc0\x00"
            out += struct.pack("<H", 0) if declared is None else struct.pack("<HHH", 0xFFFF, 1, len(declared)) + declared.encode()
            out += struct.pack("<IIH", (offsets[k] + 0xA2FB6AD1) & 0xFFFFFFFF if offsets else 0, size_code(len(payload) + wrong), len(children))
            out += table(children, offsets)
        return out

    end = 20 + len(table(tree, None))
    payloads, at = list(flat), end
    offsets = []
    for p in payloads:
        offsets.append(at)
        at += len(p)
    flat.clear()
    path.write_bytes(PREFIX + struct.pack("<H", len(tree)) + table(tree, offsets) + b"".join(payloads))


TREE = [("Folder", "CAutoFolder", bytes.fromhex(formats.FOLDER), [("音", None, b"OggSDEMO", []), ("A", None, b"\x89PNG\r\n\x1a\nxx", []), ("a", None, b"dup", [])]), ("last", "CThing", b"", [])]


def test_objects_layout_and_types(spark, tmp_path):
    build(tmp_path / "ok.bin", TREE)
    build(tmp_path / "bad.bin", TREE, wrong=True)
    (tmp_path / "no.bin").write_bytes(b"nothing of the kind")
    seen = objects(file_catalog(spark, str(tmp_path)))
    assert {r.container: r.error for r in seen.where("error is not null").collect()} == {"no.bin": "not a container"}
    rows = tree_paths(typed(laid_out(seen))).orderBy("container", "index").collect()
    ok = [r for r in rows if r.container == "ok.bin"]
    assert [r.path for r in ok] == ["Folder", "Folder/音", "Folder/A", "Folder/a", "last"]
    assert [r.payload_type for r in ok] == ["FOLDER", "OGG", "PNG", "UNKNOWN", "CThing"]
    assert [r.payload_size for r in ok] == [25, 8, 10, 3, 0] and [r.parent_index for r in ok] == [None, 0, 0, 0, None]
    assert [r.storage_kind for r in ok] == ["object", "tree", "tree", "object", "tree"]
    assert {r.problem for r in rows if r.container == "bad.bin"} == {"encoded size does not match"}


def test_rebuild(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    build(source / "c.bin", TREE)
    edit = tmp_path / "new.ogg"
    edit.write_bytes(b"OggS" + bytes(5000))
    plan = laid_out(objects(file_catalog(spark, str(source))))
    done = rebuilt(plan, spark.createDataFrame([("c.bin", 1, str(edit))], "container string, index long, source string"), str(out)).collect()
    assert [(r.objects, r.changed, r.error) for r in done] == [(5, 1, None)]
    rows = typed(laid_out(objects(file_catalog(spark, str(out))))).orderBy("index").collect()
    assert all(r.problem is None for r in rows) and [r.payload_size for r in rows] == [25, 5004, 10, 3, 0]
    same = rebuilt(plan, spark.createDataFrame([], "container string, index long, source string"), str(tmp_path / "same")).collect()
    assert same[0].changed == 0 and (tmp_path / "same/c.bin").read_bytes() == (source / "c.bin").read_bytes()


def test_safe_components():
    names = ["a:b", "50%", "end. ", "", "con", "COM1.txt", "fine", "tab\t"]
    assert [safe_component(n) for n in names] == ["a%3Ab", "50%25", "end.%20", "%00_EMPTY", "%5Fcon", "%5FCOM1.txt", "fine", "tab%09"]

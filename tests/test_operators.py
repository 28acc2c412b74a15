import pytest
from pyspark.sql import functions as F

from assetlake.functions import binary, formats, paths
from assetlake.operators import inventory, layout, probing, raster, rules, selection, states

ASF = bytes.fromhex(formats.ASF)


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "header,extension,size,label",
    [
        (b"\x89PNG\r\n\x1a\nrest", "", None, "PNG"), (b"RIFF\0\0\0\0WAVE", "", None, "WAV"), (b"RIFF", "", None, "RIFF container (WAV/AVI/WebP)"), (b"ABCD", "", None, "UNKNOWN"),
        (b" \n[SkipFRAME]=1", ".ors", None, "ORS script"), (b"\0\0\0\1Bud1", "[no extension]", None, "macOS DS_Store"), (ASF, ".wmv", 16, "ASF/WMV"),
        (b"\x20\x03\0\0\x58\x02\0\0" + bytes(8), ".cmap", 480008, "CMAP raster"), (b"\x20\x03\0\0\x58\x02\0\0" + bytes(8), ".cmap", 480009, "UNKNOWN"), (b"\x02\0\0\0\x02\0\0\0\0\1\2\3", ".CMAP", 12, "CMAP raster"),
        (b'[Version]="1"', ".ini", None, "INI text"), (b"\xef\xbb\xbfhi", ".txt", None, "UTF-8 text"), (b"\x89PNG\r\n\x1a\n\0", ".txt", None, "PNG"), (b"\0\0\4\0", ".dat", 4, "UNKNOWN"), (b"GIF89a", None, None, "GIF"),
    ],
)
def test_detect(spark, header, extension, size, label):
    df = spark.createDataFrame([(bytearray(header), extension, size)], "h binary, e string, s long")
    assert df.select(formats.detect(F.col("h"), F.col("e"), F.col("s"))).first()[0] == label


def test_numbers_and_text(spark):
    assert column(spark, [bytearray(b"\xc3\xa9\0\0"), bytearray(b"\1")], "binary", lambda c: binary.uint_le(c, 0, 4)) == [43459, None]
    assert column(spark, [bytearray(b"\0\0\1\2")], "binary", lambda c: binary.uint_be(c, 0, 4)) == [258]
    assert column(spark, [bytearray(b"\x89PNG"), bytearray()], "binary", binary.hex_text) == ["89 50 4E 47", ""]
    assert column(spark, [bytearray(b"a\0\xffz")], "binary", binary.printable) == ["a..z"]
    assert [bytes(x) for x in column(spark, ["89 50", "zz", None], "string", binary.from_hex)] == [b"\x89P", b"", b""]
    assert column(spark, [0, 1023, 1536, 5 << 20, 7 << 40], "long", binary.human_size) == ["0 B", "1023 B", "1.50 KiB", "5.00 MiB", "7168.00 GiB"]
    assert column(spark, [0, 1 << 40], "long", binary.space_needed) == [16 << 20, (1 << 40) + (1 << 40) // 100]
    codes = column(spark, [0, 1, 0x80000, 0xFFFFFFFF], "long", binary.encode_size)
    assert codes == [(0xE7B5D9F8 + (((n << 13) | (n >> 19)) & 0xFFFFFFFF) + (n & 0xFFF)) & 0xFFFFFFFF for n in (0, 1, 0x80000, 0xFFFFFFFF)]
    assert column(spark, [0, 5, 0xFFFFFFFF], "long", lambda c: binary.decode_offset(binary.encode_offset(c))) == [0, 5, 0xFFFFFFFF]


def test_paths(spark):
    assert column(spark, ["a/b.TXT", ".DS_Store", "x/.hid", "noext", "a.tar.gz"], "string", paths.extension) == [".txt", "[no extension]", "[no extension]", "[no extension]", ".gz"]
    assert column(spark, ["a/b.TXT", ".DS_Store", "n"], "string", paths.stem) == ["b", ".DS_Store", "n"]
    assert column(spark, ["a/b/c", "c"], "string", paths.ancestors) == [["a", "a/b"], []]
    assert column(spark, ["a/b", "../a", "a/./b", "/a", "a\\b", "c:x", "a//b", "", "a..b/c"], "string", paths.is_relative) == [True, False, False, False, False, False, False, False, True]
    assert column(spark, ["a\\b", "a\\..\\b", "\\a"], "string", paths.is_inside) == [True, False, False]
    assert column(spark, ["ab", "abc", "a-b.c", "Abc", "abc\n"], "string", paths.is_identity) == [False, True, True, False, False]


ROWS = [("One", "INI/A.INI", "INI", ".ini", "original", 1), ("One", "IMG/b.png", "PNG", ".png", "modificado", 2), ("two", "IMG/c.png", "PNG", ".png", "ausente", 3), ("two", "d.dat", "DAT/UNKNOWN", ".dat", "novo", 4)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "archive string, path string, format string, extension string, state string, ordinal long")


def test_filter_and_select(rows, spark):
    ids = lambda df: sorted(r.ordinal for r in df.collect())
    assert ids(selection.filter_rows(rows)) == [1, 2, 3, 4]
    assert ids(selection.filter_rows(rows, "ONE ini")) == [1] and ids(selection.filter_rows(rows, extension=".PNG", state="ausente")) == [3]
    assert ids(selection.filter_rows(rows, scope=[])) == [] and ids(selection.filter_rows(rows, scope=[("One", ""), ("two", "IMG/")])) == [1, 2, 3]
    named = spark.createDataFrame([("two", "d.dat"), ("two", "d.dat"), ("no", "file")], "archive string, path string")
    assert ids(selection.select_rows(rows, named, [("One", "IMG")])) == [2, 4] and ids(selection.select_rows(rows, everything=True)) == [1, 2, 3, 4]
    assert ids(selection.page(rows, "ordinal", number=9, size=3)) == [4] and ids(selection.page(rows.limit(0), "ordinal")) == []
    assert {r.archive: r.paths for r in selection.by_archive(rows).collect()} == {"One": ["INI/A.INI", "IMG/b.png"], "two": ["IMG/c.png", "d.dat"]}


@pytest.mark.parametrize("mode,allow,want", [("strict", False, (2, 1, "FAIL")), ("experimental", False, (2, 1, "FAIL")), ("strict", True, (2, 1, "FAIL"))])
def test_issues(rows, mode, allow, want):
    r = states.issue_summary(rows.withColumn("errors", F.lit(None).cast("array<string>")).withColumn("warnings", F.when(F.col("ordinal") == 1, F.array(F.lit("w")))), mode, allow).first()
    assert (r.blocking, r.warnings, r.status) == want and r.checked == 4


def test_unknown_formats_by_mode(spark):
    edit = spark.createDataFrame([("a", "x.dat", "DAT/UNKNOWN", "modificado", None, None), ("a", "y.png", "PNG", "inválido", ["bad", "worse"], None), ("a", "z.dat", "UNKNOWN", "inválido", None, None)], "archive string, path string, format string, state string, errors array<string>, warnings array<string>")
    n = lambda **k: (lambda r: (r.blocking, r.warnings, r.status))(states.issue_summary(edit, **k).first())
    assert n() == (5, 0, "FAIL") and n(allow_unknown=True) == (3, 2, "FAIL") and n(mode="experimental") == (0, 5, "WARN")


def test_legacy_record_counts_as_extracted(spark):
    index = spark.createDataFrame([("a", p, 1) for p in "xyz"], "archive string, path string, size long")
    known = spark.createDataFrame([("a", "x", None), ("a", "y", False)], "archive string, path string, extracted boolean")
    assert {r.path: r.state for r in states.catalog(index, known).collect()} == {"x": "não verificado", "y": "não extraído", "z": "não extraído"}


def test_rules_of_text_ogg_raster(spark):
    def run(rule, schema, old, new):
        r = rules.compared(spark.createDataFrame([(old, new)], f"old struct<{schema}>, new struct<{schema}>"), rule).first()
        return r.errors, r.warnings

    text = "encoding string, sections array<string>, keys array<string>, newlines string"
    assert run(rules.text, text, ("UTF-8", None, None, None), ("UTF-8-SIG", ["A"], ["k"], "LF")) == ([], [])
    assert run(rules.text, text, ("UTF-8", ["A"], ["k"], "LF"), ("CP932", ["B"], ["k"], "CRLF")) == (["text encoding changed", "text structure changed: sections"], ["text newline convention changed"])
    ogg = "codec string, channels int, sample_rate int, nominal_bitrate int"
    assert run(rules.ogg, ogg, ("Vorbis", 2, 44100, 1), ("Vorbis", 1, 44100, 2)) == (["channels changed"], ["nominal_bitrate changed"])
    assert run(rules.ogg, ogg, ("Theora", None, None, None), ("Theora", None, None, None)) == ([], [])
    assert run(rules.raster, "width int, height int, region_ids array<int>", (4, 2, [0, 1]), (4, 3, [0, 9, 5])) == (["dimensions changed from 4x2 to 4x3", "new region IDs: 5, 9"], [])


def test_top_headers_keep_the_first_of_equals(spark):
    df = spark.createDataFrame([(".a", h, i) for i, h in enumerate("xyzyxw")], "extension string, header_hex string, ordinal long")
    assert [(r.header_hex, r.rank) for r in inventory.top_headers(df, k=3).orderBy("rank").collect()] == [("x", 1), ("y", 2), ("z", 3)]


def test_empty_catalogs(spark, rows):
    none = rows.limit(0).withColumn("size", F.lit(1).cast("long"))
    assert tuple(inventory.totals(none).first()) == (0, 0)
    assert layout.identity(none, ["path"]).count() == 0 and inventory.summary(none).where("level = 'total'").count() <= 1


def test_first_difference_and_keys(spark):
    df = spark.createDataFrame([("same", "same"), ("abc", "abd"), ("ab", "abc"), ("", ""), ("x" * 9000 + "y", "x" * 9000 + "z"), ("", "q")], "left string, right string")
    assert [r.first_difference for r in probing.first_difference(df).collect()] == [None, 2, 2, None, 9000, 0]
    texts = spark.createDataFrame([(1, "has beta and alpha"), (2, "none"), (3, None)], "id int, text string")
    keys = spark.createDataFrame([(2, "alpha"), (1, "beta")], "priority int, literal string")
    assert [tuple(r) for r in probing.first_key(texts, keys, "id", "text").collect()] == [(1, 1, 5)]
    assert [tuple(r) for r in probing.first_key(texts, keys, "id", "text", at_once=1).collect()] == [(1, 1, 5)]  # in turns


def test_lineage_of_deep_and_empty_forests(spark):
    nodes = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"n{i}") for i in range(6)], "id string, parent string, name string")
    out = {r.id: (r.depth, r.path) for r in layout.lineage(nodes).collect()}
    assert out["5"] == (5, "n0/n1/n2/n3/n4/n5")
    assert layout.lineage(nodes.limit(0)).count() == 0


def test_companions(spark):
    r = spark.createDataFrame([("d", "TITLE_WIDE"), ("d", "both_H"), ("d", "none_FULL")], "folder string, stem string")
    p = spark.createDataFrame([("d", "title", "d/TITLE.PNG"), ("d", "BOTH", "d/both.png"), ("d", "both_h", "d/both_h.png"), ("e", "none", "e/none.png")], "folder string, stem string, path string")
    assert {x.stem: x.picture for x in raster.companions(r, p).collect()} == {"TITLE_WIDE": "d/TITLE.PNG", "both_H": "d/both_h.png"}


def test_find_bytes(spark):
    key, other = bytes(range(16)), b"\x21\x12"
    rows = [("a.exe", bytearray(b"MZ" + bytes(128) + key + bytes(64))), ("b.exe", bytearray(b"\x12\x11\x20")), ("c.exe", bytearray(b"z\x21\x12" + key)), ("none", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.key, r.place) for r in probing.find_bytes(df, [("first", key), ("second", other)]).collect()}
    assert got == {"a.exe": ("first", 130), "c.exe": ("first", 3)}


def test_lineage_has_no_last_level(spark):
    rows = [(0, None, "n0"), *((i, i - 1, f"n{i}") for i in range(1, 70)), (100, 101, "a"), (101, 100, "b"), (102, 999, "c")]
    nodes = spark.createDataFrame(rows, "id long, parent long, name string").coalesce(1)
    assert {r.id: r.depth for r in layout.lineage(nodes).collect()} == {i: i for i in range(70)}
    assert {r.id for r in layout.unreached(nodes.where("id < 2 or id >= 100")).collect()} == {100, 101, 102}


def test_first_key_of_many(spark):
    words = [f"k{n}x" for n in range(300)]
    keys = spark.createDataFrame([(7 * n % 300, w) for n, w in enumerate(words)] + [(3, None), (None, "k1x")], "priority long, literal string")
    rows = [(i, f"é {words[i % 300]} {words[(i * i) % 300]} end" if i % 3 else None if i % 2 else "none") for i in range(400)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    want = {}
    for i, t in rows:
        hit = sorted((7 * n % 300, w) for n, w in enumerate(words) if t and w in t)
        if hit:
            want[i] = (hit[0][0], t.find(hit[0][1]) + 1)
    for at_once in (10_000, 100):
        assert {r.id: (r.priority, r.place) for r in probing.first_key(texts, keys, "id", "text", at_once).collect()} == want


def test_ordered_numbers_by_ranges(spark):
    df = spark.createDataFrame([(k * 37 % 101, f"v{k % 5}") for k in range(101)], "k long, v string").repartition(7)
    rows = {r.k: r.ordinal for r in probing.ordered(df, "v", "k").collect()}
    want = sorted((f"v{k % 5}", k * 37 % 101) for k in range(101))
    assert rows == {k: n for n, (_, k) in enumerate(want, 1)}
    assert probing.ordered(df.limit(0), "k").count() == 0

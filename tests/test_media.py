import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.operators import raster, rules
from assetlake.sources import media


def page(payload, serial=7, sequence=0, granule=0, kind=2):
    sizes = bytes([255] * (len(payload) // 255) + [len(payload) % 255])
    head = b"OggS" + bytes([0, kind]) + struct.pack("<QII", granule, serial, sequence) + bytes(4) + bytes([len(sizes)])
    data = head + sizes + payload
    return data[:22] + struct.pack("<I", media.ogg_crc(data)) + data[26:]


def vorbis(channels=2, rate=44100):
    return b"\x01vorbis" + struct.pack("<IBIiii", 0, channels, rate, 0, 128000, 0) + bytes([0xB8, 1])


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def asf(width=640, play=50_000_000):
    obj = lambda kind, body: kind + struct.pack("<Q", 24 + len(body)) + body
    properties = bytearray(80)
    struct.pack_into("<Q", properties, 40, play)
    bitmap = struct.pack("<IIIHH4s", 40, width, 480, 1, 24, b"WMV3") + bytes(20)
    data = struct.pack("<IIBH", width, 480, 2, len(bitmap)) + bitmap
    stream = media._VIDEO + bytes(16) + bytes(8) + struct.pack("<IIHI", len(data), 0, 1, 0) + data
    body = obj(media._FILE, bytes(properties)) + obj(media._STREAM, stream)
    return media._ASF + struct.pack("<QI", 30 + len(body), 2) + b"\x01\x02" + body


def frame(spark, rows):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "path string, content binary")


def test_ogg(spark):
    assert all(media.ogg_crc(d) == slow_crc(d) for d in (b"", b"OggS", bytes(range(256))))
    ok = page(vorbis(), granule=0) + page(b"x" * 600, sequence=1, granule=88200, kind=4)
    rows = {"ok": ok, "crc": ok[:-1] + b"y", "gap": page(vorbis()) + page(b"z", sequence=5), "none": b"RIFF" + bytes(40), "opus": page(b"OpusHead" + bytes([1, 2]) + bytes(9))}
    got = {r.path: r for r in media.ogg_properties(media.ogg_pages(frame(spark, rows))).collect()}
    assert (got["ok"].codec, got["ok"].channels, got["ok"].duration_seconds, got["ok"].page_count, got["ok"].error) == ("Vorbis", 2, 2.0, 2, None)
    assert got["crc"].error == "a page's checksum is wrong" and got["gap"].error == "a page is missing" and got["none"].error
    assert got["opus"].codec == "Opus" and got["opus"].sample_rate == 48000


def test_asf(spark):
    bad = bytearray(asf())
    bad[24] = 3
    got = {r.path: r for r in media.asf_properties(frame(spark, {"a": asf(), "b": asf(800), "c": asf(play=60_000_000), "bad": bytes(bad), "short": b"0&"})).collect()}
    assert got["a"].duration_seconds == 5.0 and got["a"].streams[0].codec == "WMV3" and got["a"].streams[0].width == 640
    assert got["bad"].error and got["short"].error
    rows = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a")], "o string, n string")
    p = media.asf_properties(frame(spark, {"a": asf(), "b": asf(800), "c": asf(play=60_000_000)}))
    pairs = rows.join(p.select(F.col("path").alias("o"), F.struct("streams", "duration_seconds").alias("old")), "o").join(p.select(F.col("path").alias("n"), F.struct("streams", "duration_seconds").alias("new")), "n")
    out = {r.n: (r.errors, r.warnings) for r in rules.compared(pairs, rules.asf).collect()}
    assert out == {"b": (["stream 1 width changed"], []), "c": ([], ["duration changed"]), "a": ([], [])}


def filtered(kind, samples, n):
    """One scanline of a filter, from the samples it stands for (first row)."""
    left = [0] * n + list(samples)
    guess = {0: lambda k: 0, 1: lambda k: left[k], 2: lambda k: 0, 3: lambda k: left[k] // 2, 4: lambda k: left[k]}[kind]
    return bytes([kind] + [(s - guess(k)) & 255 for k, s in enumerate(samples)])


def png(w, h, colour, lines, depth=8):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return media.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    samples = bytes([3, 200, 7, 90, 255, 0, 1, 2, 3])
    w, h, p = media.png_rgba(png(3, 1, 2, filtered(kind, samples, 3)))
    assert (w, h) == (3, 1) and p[:, :3].tobytes() == samples


def test_png_columns_and_checks(spark):
    grey = media.png_bytes(4, 2, bytes(range(8)))
    rows = {"grey": grey, "tail": grey + b"x", "crc": grey[:40] + b"\0" + grey[41:], "red": media.png_bytes(1, 1, b"\xff\0\0", 2), "no": b"BM"}
    df = frame(spark, rows)
    head = {r.path: r.h for r in df.select("path", media.png_header(F.col("content")).alias("h")).collect()}
    assert (head["grey"].width, head["grey"].height, head["grey"].color_type) == (4, 2, 0) and head["no"] is None
    got = {r.path: r for r in media.png_checked(df).collect()}
    assert got["grey"].error is None and got["tail"].error == "bytes after the image" and got["crc"].error and got["no"].error
    ids = {r.name: r for r in media.png_to_raster(df).collect()}
    assert bytes(ids["grey"].pixels) == bytes(range(8)) and ids["red"].error == "the picture is not grey"


def test_raster_round_trip_and_histogram(spark):
    data = bytes([0, 1, 1, 0, 0, 2, 2, 0])
    files = frame(spark, {"a.cmap": struct.pack("<II", 4, 2) + data, "short": struct.pack("<II", 800, 600), "zero": bytes(8)})
    out = raster.decoded(files).withColumnRenamed("path", "name")
    assert {r.name: r.error for r in out.collect()} == {"a.cmap": None, "short": "length is not width * height + 8", "zero": "empty dimensions"}
    cells = raster.pixels(out).cache()
    assert [(r.x, r.y, r.value) for r in cells.orderBy("y", "x").collect()][1] == (1, 0, 1)
    counts = {(r.name, r.value): r.pixel_count for r in raster.histogram(cells).collect()}
    assert counts == {("a.cmap", 0): 4, ("a.cmap", 1): 2, ("a.cmap", 2): 2, (None, 0): 4, (None, 1): 2, (None, 2): 2}
    back = media.png_to_raster(media.raster_to_png(out).select(F.col("name").alias("path"), F.col("png").alias("content"))).first()
    assert bytes(back.pixels) == data
    colours = raster.palette(spark)
    assert raster.regions_of(raster.coloured(cells, colours).drop("value"), colours).where("value is null").count() == 0
    p = b"".join(bytes([r.red, r.green, r.blue]) for r in colours.orderBy("id").collect())
    w, h, rgba = media.png_rgba(media.raster_to_png(out, p).first().png)
    assert np.array_equal(rgba[:, :3], np.frombuffer(p, np.uint8).reshape(-1, 3)[list(data)])


def test_text(spark):
    rows = {"u": "[A]\r\nx = 1\r\n".encode(), "bom": b"\xef\xbb\xbf[B]\ny=2", "sjis": "音=1\n".encode("cp932"), "wide": "[W]\n".encode("utf-16"), "nul": b"a\0b"}
    got = {r.path: r for r in media.text_properties(frame(spark, rows)).collect()}
    assert (got["u"].encoding, got["u"].sections, got["u"].keys, got["u"].line_count, got["u"].newlines) == ("UTF-8", ["A"], ["x"], 2, "CRLF")
    assert got["bom"].encoding == "UTF-8-SIG" and got["sjis"].encoding == "CP932" and got["wide"].sections == ["W"] and got["nul"].error == "NUL in text"

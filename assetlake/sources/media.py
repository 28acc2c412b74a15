"""Properties of media files, from rows (path, content) of a catalog.

Fixed-place fields are column expressions; what needs a walk over chunks, pages or objects is a
small reader that turns a file into rows, and windows and aggregates do the rest. A file that cannot be read
keeps its row, with an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import uint_be
from ..functions.formats import keys, sections
from .arrow import flat_map

PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type; Adam7 passes (first x, first y, step x, step y).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
MOST_PIXELS = 100_000_000


# ---- PNG


def png_header(content: Column) -> Column:
    """width, height, bit_depth, color_type, interlace of a picture's first chunk; null if it is not sound."""
    at = lambda k, n: uint_be(content, k, n)
    sound = (F.hex(F.substring(content, 1, 16)) == "89504E470D0A1A0A0000000D49484452") & (at(16, 4) > 0) & (at(20, 4) > 0) & (F.crc32(F.substring(content, 13, 17)) == at(29, 4))
    return F.when(sound, F.struct(at(16, 4).alias("width"), at(20, 4).alias("height"), at(24, 1).alias("bit_depth"), at(25, 1).alias("color_type"), at(28, 1).alias("interlace")))


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not data.startswith(PNG):
        raise ValueError("not a PNG")
    at = 8
    while True:
        if at + 12 > len(data):
            raise ValueError("chunks are cut off")
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("a chunk is damaged")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            if at != len(data):
                raise ValueError("bytes after the image")
            return


def png_scanlines(data: bytes) -> tuple[tuple[int, int, int, int, int], bytes, bytes, bytes]:
    """((width, height, bit depth, colour type, interlace), scanlines, palette, transparency), checked to the last byte."""
    head, body, palette, clear = None, [], b"", b""
    for k, (kind, chunk) in enumerate(png_chunks(data)):
        if (kind == b"IHDR") != (k == 0):
            raise ValueError("the header is not the first chunk")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", chunk)
            if not w or not h or w * h > MOST_PIXELS or colour not in SAMPLES or lace > 1:
                raise ValueError("the header is not sound")
            head = (w, h, depth, colour, lace)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"PLTE":
            palette = chunk
        elif kind == b"tRNS":
            clear = chunk
    w, h, depth, colour, lace = head
    bits = SAMPLES[colour] * depth
    passes = [(-(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in ADAM7] if lace else [(w, h)]
    want = sum(rows * (1 + -(-columns * bits // 8)) for columns, rows in passes if columns > 0 and rows > 0)
    z = zlib.decompressobj()
    out = z.decompress(b"".join(body), want + 1)
    if len(out) != want or not z.eof or z.unused_data:
        raise ValueError("scanlines have another size than the header says")
    return head, out, palette, clear


def png_rgba(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels x 4) of an 8-bit picture that is not interlaced."""
    (w, h, depth, colour, lace), lines, palette, clear = png_scanlines(data)
    if depth != 8 or lace:
        raise ValueError("only 8-bit pictures without interlacing are decoded")
    n = SAMPLES[colour]
    rows = np.frombuffer(lines, np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w + 1, n), np.int32)  # a row above and a pixel before, of zeros
    for y in range(h):
        kind, raw = rows[y, 0], rows[y, 1:].reshape(w, n).astype(np.int32)
        up = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = raw
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(raw, 0) & 255
        elif kind == 2:
            out[y + 1, 1:] = (raw + up) & 255
        elif kind in (3, 4):
            for x in range(w):
                a, b, c = out[y + 1, x], up[x], out[y, x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[y + 1, x + 1] = (raw[x] + guess) & 255
        else:
            raise ValueError(f"unknown filter {kind}")
    p = out[1:, 1:].reshape(-1, n).astype(np.uint8)
    full = np.full((len(p), 1), 255, np.uint8)
    if colour == 3:
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        if p.max(initial=0) >= len(table):
            raise ValueError("a pixel lies outside the palette")
        alpha = np.concatenate([np.frombuffer(clear, np.uint8), np.full(256, 255, np.uint8)])[:256]
        return w, h, np.concatenate([table[p[:, 0]], alpha[p]], 1)
    if colour in (0, 4):
        return w, h, np.concatenate([p[:, :1]] * 3 + [p[:, 1:] if colour == 4 else full], 1)
    return w, h, p if colour == 6 else np.concatenate([p, full], 1)


def png_bytes(width: int, height: int, pixels: bytes, colour: int = 0, palette: bytes = b"") -> bytes:
    """An 8-bit PNG of rows of samples."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.frombuffer(pixels, np.uint8).reshape(height, width * SAMPLES[colour])
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows], 1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(lines, 9)) + chunk(b"IEND", b"")


def png_checked(files: DataFrame) -> DataFrame:
    """path, width, height, bit_depth, color_type, interlace, error, after a check of every byte."""

    def read(path: str, data: bytes) -> Iterator[tuple]:
        try:
            yield path, *png_scanlines(data)[0], None
        except (ValueError, zlib.error, TypeError) as e:
            yield path, None, None, None, None, None, str(e)

    return flat_map(files.select("path", "content"), read, "path string, width long, height long, bit_depth long, color_type long, interlace long, error string")


def png_to_raster(files: DataFrame) -> DataFrame:
    """name, width, height, pixels, error of grey pictures whose samples are region ids."""

    def read(path: str, data: bytes) -> Iterator[tuple]:
        try:
            w, h, p = png_rgba(data)
            if (p[:, 0] != p[:, 1]).any() or (p[:, 1] != p[:, 2]).any():
                raise ValueError("the picture is not grey")
            yield path, w, h, p[:, 0].tobytes(), None
        except (ValueError, zlib.error, TypeError) as e:
            yield path, None, None, None, str(e)

    return flat_map(files.select("path", "content"), read, "name string, width long, height long, pixels binary, error string")


def raster_to_png(rasters: DataFrame, palette: bytes = b"") -> DataFrame:
    """name, png of rasters (name, width, height, pixels); with a palette (768 bytes) in colour."""

    def write(name: str, w: int, h: int, pixels: bytes) -> Iterator[tuple]:
        yield name, png_bytes(w, h, pixels, 3 if palette else 0, palette)

    return flat_map(rasters.where("pixels is not null").select("name", "width", "height", "pixels"), write, "name string, png binary")


def colours_to_raster(files: DataFrame, palette: bytes) -> DataFrame:
    """path, content, error of region rasters from pictures (path, content) in the colours of a palette of 256; any other colour fails."""
    table = np.frombuffer(palette, np.uint8).reshape(256, 3).astype(np.int64) @ np.array([65536, 256, 1])

    def read(path: str, data: bytes) -> Iterator[tuple]:
        try:
            w, h, p = png_rgba(data)
            value = p[:, :3].astype(np.int64) @ np.array([65536, 256, 1])
            order = np.argsort(table, kind="stable")
            at = np.minimum(np.searchsorted(table[order], value), 255)
            if (table[order][at] != value).any():
                raise ValueError("a colour is not in the palette")
            yield path, struct.pack("<II", w, h) + order[at].astype(np.uint8).tobytes(), None
        except (ValueError, zlib.error, TypeError) as e:
            yield path, None, str(e)

    return flat_map(files.select("path", "content"), read, "path string, content binary, error string")


# ---- Ogg

_MIRROR = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC with polynomial 04C11DB7 from 0, most significant bit first: zlib's, mirrored."""
    plain = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{plain:032b}"[::-1], 2)


def _codec(packet: bytes) -> tuple:
    """(codec, channels, sample rate, nominal bitrate) of an identification packet."""
    if packet.startswith(b"\x01vorbis") and len(packet) >= 30:
        version, channels, rate = struct.unpack_from("<IBI", packet, 7)
        if version or not channels or not rate or not packet[29] & 1:
            raise ValueError("the Vorbis header is not sound")
        return "Vorbis", channels, rate, struct.unpack_from("<i", packet, 20)[0]
    if packet.startswith(b"OpusHead") and len(packet) >= 19 and packet[9]:
        return "Opus", packet[9], 48000, None
    if packet.startswith(b"\x80theora"):
        return "Theora", None, None, None
    raise ValueError("the codec is not known")


PAGES = "path string, page long, serial long, sequence long, granule long, crc_ok boolean, codec string, channels long, sample_rate long, nominal_bitrate long, error string"


def ogg_pages(files: DataFrame) -> DataFrame:
    """One row per page; the page that ends the first packet says the codec. granule is null where none is set."""

    def read(path: str, data: bytes) -> Iterator[tuple]:
        at, page, packet, done = 0, 0, b"", False
        try:
            while at < len(data):
                head = data[at : at + 27]
                if len(head) < 27 or head[:4] != b"OggS" or head[4]:
                    raise ValueError("a page header is damaged")
                sizes = data[at + 27 : at + 27 + head[26]]
                body = data[at + 27 + head[26] : at + 27 + head[26] + sum(sizes)]
                if len(sizes) != head[26] or len(body) != sum(sizes):
                    raise ValueError("a page is cut off")
                granule, serial, sequence, crc = struct.unpack_from("<QIII", head, 6)
                known: tuple = (None,) * 4
                cut = 0
                for n in sizes if not done else ():
                    packet += body[cut : cut + n]
                    cut += n
                    if n < 255:
                        known, done = _codec(packet), True
                        break
                page += 1
                at += 27 + len(sizes) + len(body)
                yield path, page, serial, sequence, granule if granule < 1 << 63 else None, ogg_crc(head[:22] + bytes(4) + head[26:] + sizes + body) == crc, *known, None
            if not done:
                raise ValueError("no complete identification packet")
        except (ValueError, TypeError) as e:
            yield path, page + 1, *(None,) * 8, str(e)

    return flat_map(files.select("path", "content"), read, PAGES)


def ogg_properties(pages: DataFrame) -> DataFrame:
    """path, codec, channels, sample_rate, nominal_bitrate, page_count, duration_seconds, error (the first)."""
    before = F.lag("sequence").over(Window.partitionBy("path", "serial").orderBy("page"))
    problem = F.coalesce("error", F.when(~F.col("crc_ok"), "a page's checksum is wrong"), F.when(before.isNotNull() & (F.col("sequence") != before + 1), "a page is missing"))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    out = pages.withColumn("problem", problem).groupBy("path").agg(
        first("codec"), first("channels"), first("sample_rate"), first("nominal_bitrate"), F.count_if(F.col("error").isNull()).alias("page_count"), F.max("granule").alias("last"),
        F.min(F.when(F.col("problem").isNotNull(), F.struct("page", "problem")))["problem"].alias("error"),
    )
    return out.withColumn("duration_seconds", F.when((F.col("last") > 0) & F.col("sample_rate").isNotNull(), F.col("last") / F.col("sample_rate"))).drop("last")


# ---- ASF

#: Object and stream kinds.
_ASF = bytes.fromhex("3026B2758E66CF11A6D900AA0062CE6C")
_FILE = uuid.UUID("8cabdca1-a947-11cf-8ee4-00c00c205365").bytes_le
_STREAM = uuid.UUID("b7dc0791-a9b7-11cf-8ee6-00c00c205365").bytes_le
_VIDEO = uuid.UUID("bc19efc0-5b4d-11cf-a8fd-00805f5c442b").bytes_le
_AUDIO = uuid.UUID("f8699e40-5b4d-11cf-a8fd-00805f5c442b").bytes_le
STREAM = "struct<number:int,type:string,width:long,height:long,codec:string,format_tag:int,channels:int,sample_rate:long>"


def _asf_stream(body: bytes) -> tuple:
    kind, n = body[:16], struct.unpack_from("<I", body, 40)[0]
    number, data = struct.unpack_from("<H", body, 48)[0] & 0x7F, body[54 : 54 + n]
    if kind == _VIDEO:
        w, h = struct.unpack_from("<II", data)
        return number, "video", w, h, data[27:31].decode("ascii", "replace").rstrip("\0"), None, None, None
    if kind == _AUDIO:
        return number, "audio", None, None, None, *struct.unpack_from("<HHI", data)
    return number, "other", None, None, None, None, None, None


def asf_properties(files: DataFrame) -> DataFrame:
    """path, duration_seconds, max_bitrate, declared_size, streams, error."""

    def read(path: str, data: bytes) -> Iterator[tuple]:
        try:
            if not data.startswith(_ASF):
                raise ValueError("not ASF")
            size, count = struct.unpack_from("<QI", data, 16)
            if not 30 <= size <= len(data):
                raise ValueError("the header's size is wrong")
            at, duration, rate, declared, streams = 30, None, None, None, []
            for _ in range(count):
                n = struct.unpack_from("<Q", data, at + 16)[0]
                if n < 24 or at + n > size:
                    raise ValueError("an object's size is wrong")
                kind, body = data[at : at + 16], data[at + 24 : at + n]
                if kind == _FILE:
                    declared, play, preroll, rate = (struct.unpack_from(f, body, k)[0] for f, k in (("<Q", 16), ("<Q", 40), ("<Q", 56), ("<I", 76)))
                    duration = max(0.0, play / 1e7 - preroll / 1e3)
                elif kind == _STREAM:
                    streams.append(_asf_stream(body))
                at += n
            if at != size or duration is None or not streams:
                raise ValueError("the header is not complete")
            if declared not in (0, len(data)):
                raise ValueError("the file has another size than it declares")
            yield path, duration, rate, declared, streams, None
        except (ValueError, struct.error, TypeError) as e:
            yield path, None, None, None, None, str(e)

    return flat_map(files.select("path", "content"), read, f"path string, duration_seconds double, max_bitrate long, declared_size long, streams array<{STREAM}>, error string")


# ---- text


def text_properties(files: DataFrame) -> DataFrame:
    """path, encoding, text, sections, keys, line_count, newlines, error. A byte-order mark decides, then UTF-8, then CP932."""

    def read(path: str, data: bytes) -> Iterator[tuple]:
        try:
            encoding = "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig" if data.startswith(b"\xef\xbb\xbf") else "utf-8"
            try:
                text = data.decode(encoding)
            except UnicodeError:
                if encoding != "utf-8":
                    raise
                encoding = "cp932"
                text = data.decode(encoding)
            if "\0" in text:
                raise ValueError("NUL in text")
            yield path, encoding.upper(), text, len(text.splitlines()), "CRLF" if b"\r\n" in data else "LF", None
        except (ValueError, TypeError) as e:
            yield path, None, None, None, None, str(e)

    rows = flat_map(files.select("path", "content"), read, "path string, encoding string, text string, line_count long, newlines string, error string")
    return rows.withColumn("sections", sections(F.col("text"))).withColumn("keys", keys(F.col("text")))

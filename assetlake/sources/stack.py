"""Stack archives: entries, payloads and rebuilt archives.

An archive is a body, a protected index and a 32-byte footer. The index is a
32-bit length and a zlib stream, under a repeating XOR key or none; its records give each
entry's name, place, sizes and the first bytes of its payload. One task reads one archive's
index; entries are dealt over all tasks before their payloads are read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from .arrow import _batch, arrow_schema, flat_map, spread
from .catalog import digest

#: Keys that archives in use have, tried in this order after a given one.
KEYS = [
    ("A", bytes.fromhex("82EE1DB357E92CC22F547B104C9A7549")),
    ("B", bytes.fromhex("567C1B90B6FE3FDBB60679EACC11A04F")),
    ("C", bytes.fromhex("F0D0BC0554AC68A9F17C8E3D640BF3AA")),
]
FIRST, LAST = b"STKFile0PIDX", b"STKFile0PACKFILE"
_FIXED = struct.Struct("<ihIIiIB")
BLOCK = 1 << 20
ENTRIES = (
    "archive string, location string, archive_size long, index_offset long, key string, key_name string, trailer binary, ordinal long, path string, unknown_1 int, unknown_2 int, "
    "offset long, stored_size long, unknown_3 int, compression_tag string, unpacked_size long, is_packed boolean, header binary, error string"
)


def record(path: str, header: bytes, *numbers: int) -> bytes:
    """An entry of the index: the numbers are as ``_FIXED`` has them, less the length of the header."""
    name = path.encode("utf-16le")
    return struct.pack("<H", len(name) // 2) + name + _FIXED.pack(*numbers, len(header)) + header


def xor(data: bytes, key: bytes) -> bytes:
    """Bytes under a repeating key; twice gives them back."""
    if not key:
        raise ValueError("the key is empty")
    a = np.frombuffer(data, np.uint8)
    return (a ^ np.resize(np.frombuffer(key, np.uint8), len(a))).tobytes()


def records(index: bytes, archive_size: int) -> tuple[list[tuple], bytes]:
    """Entries of an open index, and what follows its end mark."""
    at, out = 0, []

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(index):
            raise ValueError("the index is cut off")
        at += n
        return index[at - n : at]

    rest = b""
    while at < len(index):
        begin = at
        units = int.from_bytes(take(2), "little")
        if not units:
            rest = index[begin:]
            break
        name = take(2 * units).decode("utf-16le")
        parts = name.replace("\\", "/").split("/")
        if ".." in parts or parts[0] == "" or ":" in parts[0]:
            raise ValueError(f"unsafe path {name!r}")
        u1, u2, offset, stored, u3, unpacked, n = _FIXED.unpack(take(_FIXED.size))
        header = take(n)
        if offset + stored > archive_size:
            raise ValueError(f"entry {name!r} lies outside the archive")
        out.append((name, u1, u2, offset, stored, u3, unpacked, header))
    if not out:
        raise ValueError("the index has no entries")
    return out, rest


def opened(data: bytes, archive_size: int, key: bytes | None) -> tuple[str, bytes | None, list[tuple], bytes]:
    """(key name, key, entries, rest) under the first key that opens an index; a given one comes first, none last."""
    tries: list[tuple[str, bytes | None]] = [("given", key)] if key else []
    tries += [(n, k) for n, k in KEYS if k != key] + [("none", None)]
    failures = []
    for name, k in tries:
        plain = data if k is None else xor(data, k)
        try:
            if len(plain) < 5:
                raise ValueError("too short")
            index = zlib.decompress(plain[4:])
            if len(index) != int.from_bytes(plain[:4], "little"):
                raise ValueError("another length than declared")
            return name, k, *records(index, archive_size)
        except (ValueError, zlib.error) as e:
            failures.append(f"{name}: {e}")
    raise ValueError("no key opens the index (" + "; ".join(failures) + ")")


def stack_index(files: DataFrame, key: bytes | None = None) -> DataFrame:
    """Entries of archives (path, location, size, footer; as ``file_catalog`` gives them), ordinal from 1.

    An archive that cannot be read is one row with an error.
    """
    foot = formats.footer(F.col("footer"), F.col("size"))
    rows = files.select("path", "location", "size", foot.alias("f")).select("path", "location", "size", "f.valid", "f.index_offset", "f.index_size")

    def read(path: str, location: str, size: int, valid: bool, offset: int, length: int) -> Iterator[tuple]:
        nothing = (None,) * 11
        try:
            if not valid:
                raise ValueError("no valid footer")
            with open(location, "rb") as f:
                f.seek(offset)
                data = f.read(length)
            name, k, entries, rest = opened(data, size, key)
        except (OSError, ValueError) as e:
            yield path, location, size, offset, None, None, None, 0, *nothing[:10], str(e)
            return
        for i, (entry, u1, u2, at, stored, u3, unpacked, header) in enumerate(entries, 1):
            tag = struct.pack("<i", u3).decode("ascii", "replace")
            yield path, location, size, offset, k.hex() if k else "", name, rest, i, entry, u1, u2, at, stored, u3, tag, unpacked, unpacked != 0, header, None

    return flat_map(rows, read, ENTRIES)


def publish(part: str, target: str) -> None:
    """Gives a whole file its name, unless another file has it."""
    if not os.path.exists(target):
        os.replace(part, target)
    elif digest(part) == digest(target):
        os.remove(part)
    else:
        raise FileExistsError("another file is there already")


def payload(location: str, offset: int, stored: int, unpacked: int, header: bytes) -> Iterator[bytes]:
    """Blocks of an entry's content: its header bytes and body, inflated if packed. Checks its end."""

    def raw() -> Iterator[bytes]:
        yield header
        left = stored - len(header)
        with open(location, "rb") as f:
            f.seek(offset)
            while left:
                block = f.read(min(BLOCK, left))
                if not block:
                    raise ValueError("the archive is cut off")
                left -= len(block)
                yield block

    if not unpacked:
        yield from raw()
        return
    z, size = zlib.decompressobj(), 0
    for block in raw():
        while block:
            made = z.decompress(block, BLOCK)
            block = z.unconsumed_tail
            size += len(made)
            if size > unpacked:
                raise ValueError("more content than declared")
            if made:
                yield made
    while made := z.decompress(z.unconsumed_tail, BLOCK):
        size += len(made)
        yield made
    if not z.eof or z.unused_data or size != unpacked:
        raise ValueError("the packed content does not end as declared")


def payloads(entries: DataFrame, with_content: bool = True) -> DataFrame:
    """archive, ordinal, path, content_size, sha256, content, error. Without content, entries of any size pass in blocks."""

    def read(archive, location, ordinal, path, offset, stored, unpacked, header) -> Iterator[tuple]:
        h, size, kept = hashlib.sha256(), 0, []
        try:
            for block in payload(location, offset, stored, unpacked, header):
                h.update(block)
                size += len(block)
                if with_content:
                    kept.append(block)
        except (OSError, ValueError, zlib.error) as e:
            yield archive, ordinal, path, None, None, None, str(e)
            return
        yield archive, ordinal, path, size, h.hexdigest(), b"".join(kept) if with_content else None, None

    rows = entries.where("error is null").select("archive", "location", "ordinal", "path", "offset", "stored_size", "unpacked_size", "header")
    rows = spread(rows, "location", "ordinal")
    return flat_map(rows, read, "archive string, ordinal long, path string, content_size long, sha256 string, content binary, error string", block=16)


def extracted(entries: DataFrame, folder: str) -> DataFrame:
    """Writes each entry under folder/archive stem/path, and returns archive, ordinal, path, extracted_size, extracted_sha256, error.

    A file is written under another name and renamed when it is whole. One that is there with the same content counts as
    written, so that a repeated task or run does no harm; any other is left and reported, unless the row has ``restore``.
    """

    def write(archive, location, ordinal, path, offset, stored, unpacked, header, restore) -> Iterator[tuple]:
        target = os.path.join(folder, os.path.splitext(archive)[0], *path.replace("\\", "/").split("/"))
        part = f"{target}.{os.getpid()}.part"
        h, size = hashlib.sha256(), 0
        try:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(part, "wb") as f:
                for block in payload(location, offset, stored, unpacked, header):
                    h.update(block)
                    size += len(block)
                    f.write(block)
            if restore:
                os.replace(part, target)
            else:
                publish(part, target)
        except (OSError, ValueError, zlib.error) as e:
            if os.path.exists(part):
                os.remove(part)
            yield archive, ordinal, path, None, None, str(e)
            return
        yield archive, ordinal, path, size, h.hexdigest(), None

    restore = F.col("restore") if "restore" in entries.columns else F.lit(False)
    rows = entries.where("error is null").select("archive", "location", "ordinal", "path", "offset", "stored_size", "unpacked_size", "header", restore.alias("restore"))
    rows = spread(rows, "location", "ordinal")
    return flat_map(rows, write, "archive string, ordinal long, path string, extracted_size long, extracted_sha256 string, error string")


def rebuilt(entries: DataFrame, edits: DataFrame, folder: str) -> DataFrame:
    """Rebuilds archives into a folder: archive, target, size, entries, modified, error; one row each.

    edits: archive, path, source (a file that stands for the entry). Entries stream past one writer per archive in
    their order; all others are copied byte by byte. Packed edits are deflated again; the index gets its true length.
    A target that is there with the same content counts as written; any other is never overwritten.
    """
    e = edits.select("archive", "path", "source")
    plan = entries.where("error is null").join(e, ["archive", "path"], "left")
    columns = ["archive", "location", "index_offset", "key", "trailer", "ordinal", "path", "unknown_1", "unknown_2", "offset", "stored_size", "unknown_3", "compression_tag", "unpacked_size", "header", "source"]
    ordered = plan.repartition("archive").sortWithinPartitions("archive", "ordinal").select(columns)
    schema = "archive string, target string, size long, entries long, modified long, error string"
    arrow = arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, done = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if work is None or work.archive != row[0]:
                    if work:
                        done.append(work.close())
                    work = _Rebuild(folder, *row[:5])
                work.add(*row[5:])
        if work:
            done.append(work.close())
        if done:
            yield _batch(done, arrow)

    return ordered.mapInArrow(write, schema)


class _Rebuild:
    """One archive that is being written."""

    def __init__(self, folder: str, archive: str, location: str, index_offset: int, key: str, trailer: bytes):
        self.archive, self.location, self.key, self.trailer, self.end = archive, location, bytes.fromhex(key), trailer, index_offset
        self.target = os.path.join(folder, archive)
        self.part = f"{self.target}.{os.getpid()}.part"
        self.index, self.n, self.modified, self.error, self.pending = [], 0, 0, None, None
        os.makedirs(os.path.dirname(self.target), exist_ok=True)
        self.out = open(self.part, "wb")  # noqa: SIM115
        self.source = open(location, "rb")  # noqa: SIM115

    def add(self, ordinal, path, u1, u2, offset, stored, u3, tag, unpacked, header, source) -> None:
        if self.error:
            return
        try:
            if self.n == 0:
                self._copy(0, offset)
            if source is None:
                body = stored - len(header)
                at = self.out.tell()
                self._copy(offset, body)
            else:
                self.modified += 1
                header, at, stored, unpacked = self._edit(source, tag, unpacked, len(header))
            self.index.append(record(path, header, u1, u2, at, stored, u3, unpacked))
            self.n += 1
        except (OSError, ValueError) as e:
            self.error = f"{path}: {e}"

    def _copy(self, offset: int, size: int) -> None:
        self.source.seek(offset)
        while size:
            block = self.source.read(min(BLOCK, size))
            if not block:
                raise ValueError("the archive is cut off")
            self.out.write(block)
            size -= len(block)

    def _edit(self, source: str, tag: str, unpacked: int, head: int) -> tuple[bytes, int, int, int]:
        """Header bytes, place, stored and unpacked size of a file that takes an entry's place."""
        if unpacked and tag != "DFLT":
            raise ValueError(f"compression {tag!r} cannot be written")
        z, first, at, stored, size = zlib.compressobj(9) if unpacked else None, b"", self.out.tell(), 0, 0
        with open(source, "rb") as f:
            while True:
                block = f.read(BLOCK)
                size += len(block)
                made = (z.compress(block) if block else z.flush()) if z else block
                stored += len(made)
                need = head - len(first)
                first, made = first + made[:need], made[need:]
                self.out.write(made)
                if not block:
                    break
        if z and not size:
            raise ValueError("an empty file cannot take the place of a packed entry")
        return first, at, stored, size if z else 0

    def close(self) -> tuple:
        if self.error is None:
            raw = b"".join(self.index) + self.trailer
            plain = struct.pack("<I", len(raw)) + zlib.compress(raw, 9)
            data = xor(plain, self.key) if self.key else plain
            self.out.write(data + FIRST + struct.pack("<I", len(data)) + LAST)
            size = self.out.tell()
            self.out.close()
            with open(self.part, "rb") as f:
                f.seek(size - 32 - len(data))
                if len(opened(f.read(len(data)), size, self.key or None)[2]) != self.n:
                    self.error = "the rebuilt index does not read back"
        self.out.close(), self.source.close()
        try:
            if self.error is None:
                publish(self.part, self.target)
        except OSError as e:
            self.error = str(e)
        if os.path.exists(self.part):
            os.remove(self.part)
        done = self.error is None
        return self.archive, self.target if done else None, os.path.getsize(self.target) if done else None, self.n, self.modified, self.error

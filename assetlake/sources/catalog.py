"""Directory trees as a DataFrame: the Python data source ``file_catalog``.

Spark's own binary listing leaves out empty files and names that begin with a dot or an
underscore; this one lists every file. The driver lists names only; files are dealt over
partitions by size, and tasks read first and last bytes, digests and contents as asked.

    spark.dataSource.register(FileCatalog)
    spark.read.format("file_catalog").option("path", root).option("digest", "true").load()
"""

from __future__ import annotations

import contextlib
import hashlib
import os
from collections.abc import Iterator
from stat import S_ISREG

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BLOCK = 1 << 20
SCHEMA = "path string, size long, mtime_ns long, header binary, footer binary, sha256 string, content binary, location string"


class _Files(InputPartition):
    """Files as (folder, folder relative to the root and its slash, names): names are short, folders told once."""

    def __init__(self, folders: list[tuple[str, str, list[str]]]):
        self.folders = folders


def listed(root: str) -> Iterator[tuple[str, str, list[tuple[str, int]]]]:
    """(folder, its relative path with a slash, (name, size) of its files) of all folders; none if there is no such folder."""
    for folder, names, found in os.walk(root):
        names.sort()
        own = []
        for name in sorted(found):
            with contextlib.suppress(OSError):  # a link to nothing
                stat = os.stat(f"{folder}/{name}")
                if S_ISREG(stat.st_mode):
                    own.append((name, stat.st_size))
        if own:
            relative = os.path.relpath(folder, root).replace(os.sep, "/")
            yield folder, "" if relative == "." else f"{relative}/", own


def digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            h.update(block)
    return h.hexdigest()


class FileCatalog(DataSource):
    """Options: path; header and footer (bytes to read, 64 and 32); digest, content (false); partition (bytes, 64 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "file_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.header, self.footer = int(options.get("header", 64)), int(options.get("footer", 32))
        self.digest, self.content = (str(options.get(k, "false")).lower() == "true" for k in ("digest", "content"))
        self.size = int(options.get("partition", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        out, folders, total = [], [], 0
        for folder, relative, found in listed(self.root):
            names: list[str] = []
            folders.append((folder, relative, names))
            for name, size in found:
                names.append(name)
                total += 4096 + (size if self.digest or self.content else size >> 10)  # what is read later grows with the size, too
                if total >= self.size:
                    out.append(_Files(folders))
                    names, total = [], 0
                    folders = [(folder, relative, names)]
        return [*out, _Files(folders)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for folder, prefix, names in partition.folders:
            for name in names:
                yield self._file(f"{prefix}{name}", os.path.join(folder, name))

    def _file(self, relative: str, path: str) -> tuple:
        with open(path, "rb") as f:
            stat = os.fstat(f.fileno())
            head = f.read(self.header)
            f.seek(max(0, stat.st_size - self.footer))
            tail = f.read(self.footer)
            data = None
            if self.content:
                f.seek(0)
                data = f.read()
        return relative, stat.st_size, stat.st_mtime_ns, head, tail, digest(path) if self.digest else None, data, path


def file_catalog(spark, root: str, **options):
    spark.dataSource.register(FileCatalog)
    reader = spark.read.format("file_catalog").option("path", root)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()

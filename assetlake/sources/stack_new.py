"""New stack archives from rows: one streaming writer an archive."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import _batch, arrow_schema, flat_map
from .stack import FIRST, LAST, publish, record, xor

DONE = "archive string, target string, size long, entries long, error string"


def created(rows: DataFrame, folder: str, key: bytes | None = None, header: int = 16, prefix: bytes = bytes(64)) -> DataFrame:
    """Writes an archive for each ``archive`` of rows (archive, ordinal, path, content, packed) into a folder: archive, target,
    size, entries, error.

    Entries are packed where their rows are (not empty ones: an unpacked size of 0 says that an entry is stored as it is), then stream past in the order of their ordinal; ``header`` first bytes of each go to the index. An archive that is there with
    the same content counts as written; any other is left and reported.
    """
    arrow = arrow_schema(DONE)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, index, done = None, None, [], []

        def finish() -> None:
            plain = b"".join([*index, bytes(2)])
            data = struct.pack("<I", len(plain)) + zlib.compress(plain, 9)
            data = xor(data, key) if key else data
            out.write(data + FIRST + struct.pack("<I", len(data)) + LAST)
            out.close()
            target, size = os.path.join(folder, f"{now}.gpk"), os.path.getsize(out.name)
            try:
                publish(out.name, target)
                done.append((f"{now}.gpk", target, size, len(index), None))
            except OSError as e:
                os.remove(out.name)
                done.append((f"{now}.gpk", None, None, len(index), str(e)))

        for batch in batches:
            for archive, path, stored, size, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != now:
                    if now is not None:
                        finish()
                    os.makedirs(folder, exist_ok=True)
                    now, index = archive, []
                    out = open(os.path.join(folder, f"{archive}.{TaskContext.get().taskAttemptId()}.part"), "wb")  # noqa: SIM115
                    out.write(prefix)
                tag = int.from_bytes(b"DFLT", "little") if packed else 0
                index.append(record(path, stored[:header], 0, 0, out.tell(), len(stored), tag, size if packed else 0))
                out.write(stored[header:])
        if now is not None:
            finish()
        if done:
            yield _batch(done, arrow)

    def pack(archive: str, ordinal: int, path: str, content: bytes, packed: bool) -> Iterator[tuple]:
        packed = packed and len(content) > 0
        yield archive, ordinal, path, zlib.compress(content, 9) if packed else content, len(content), packed

    own = rows.select("archive", F.col("ordinal").cast("long").alias("ordinal"), "path", "content", "packed")
    stored = flat_map(own, pack, "archive string, ordinal long, path string, stored binary, size long, packed boolean")
    ordered = stored.repartition("archive").sortWithinPartitions("archive", "ordinal")
    return ordered.select("archive", "path", "stored", "size", "packed").mapInArrow(write, DONE)

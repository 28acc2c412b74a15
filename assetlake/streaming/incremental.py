"""A catalog kept up to date from a stream of scans.

Scans arrive as Parquet files of catalog rows in a folder. The stream takes what is new, and stops (available now), so
that a run after each scan is an incremental batch. A batch writes its own latest rows only, as a delta; a read merges
the last base with the deltas after it, and every few batches they become a new base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

KEY = ["archive", "path"]
BASE, DELTA = "base=", "delta="
#: Batches from one base to the next.
EVERY = 16


def latest(rows: DataFrame, key: list[str] = KEY, at: str = "scanned_at") -> DataFrame:
    """Of rows with one key the last; an aggregate, combined on the map side."""
    others = [c for c in rows.columns if c not in key]
    newest = F.max_by(F.struct(*others), F.struct(F.col(at), F.hash(*others))).alias("row")
    return rows.groupBy(*key).agg(newest).select(*key, "row.*")


def keep_catalog(spark: SparkSession, scans: str, schema: StructType | str, state: str, checkpoint: str, every: int = EVERY) -> StreamingQuery:
    """Merges new scans into the table in ``state``, which ``current`` reads.

    Batch n writes state/delta=n, so that a repeated batch writes the same again; each ``every``-th also writes
    state/base=n, the whole table then, and removes what came before the base ahead of it. One older base stays for
    whoever reads it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        latest(batch).write.mode("overwrite").parquet(_path(state, DELTA, number))
        if number % every == every - 1:
            whole = current(session, state, upto=number)
            whole.write.mode("overwrite").parquet(_path(state, BASE, number))
            _forget(session, state, number)

    stream = spark.readStream.schema(schema).parquet(scans)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(state: str, kind: str, number: int) -> str:
    return f"{state}/{kind}{number:010d}"


def _store(spark: SparkSession, state: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, state: str) -> dict[str, list[int]]:
    """Numbers of the bases and deltas that are whole, in order."""
    fs, path = _store(spark, state)
    out: dict[str, list[int]] = {BASE: [], DELTA: []}
    if fs.exists(path):
        for f in fs.listStatus(path):
            name = f.getPath().getName()
            kind = name[: name.find("=") + 1]
            if kind in out and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
                out[kind].append(int(name[len(kind) :]))
    return {kind: sorted(numbers) for kind, numbers in out.items()}


def current(spark: SparkSession, state: str, upto: int | None = None) -> DataFrame | None:
    """The table after the last batch, or None. ``upto``: after that batch, without a base of its own."""
    found = _versions(spark, state)
    bases = [n for n in found[BASE] if upto is None or n < upto]
    first = bases[-1] if bases else -1
    deltas = [n for n in found[DELTA] if n > first and (upto is None or n <= upto)]
    parts = [_path(state, BASE, first)] * bool(bases) + [_path(state, DELTA, n) for n in deltas]
    if not parts:
        return None
    rows = spark.read.parquet(*parts)
    return latest(rows) if len(parts) > 1 else rows


def _forget(spark: SparkSession, state: str, number: int) -> None:
    """Removes bases and deltas that the base before ``number`` has made needless."""
    found = _versions(spark, state)
    before = [n for n in found[BASE] if n < number]
    if not before:
        return
    fs, _ = _store(spark, state)
    for kind, last in ((BASE, before[-1] - 1), (DELTA, before[-1])):
        for n in found[kind]:
            if n <= last:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(_path(state, kind, n)), True)


def activity(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each type in windows of time, of a batch or a stream with a bound on lateness."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))

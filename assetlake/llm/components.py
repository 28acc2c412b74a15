"""Connected components of a link table, as Spark joins.

Large-star and small-star steps alternate (Kiveris et al., 2014) until the table
stands still. Each step is one aggregate by node, combined on the map side, and
one join that AQE can split, so a hub with any number of links is no hot group;
only a count and a checksum come to the driver. A table of a bounded number of links is
finished by one task, as steps over many tasks cost more than it is worth.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, written

#: Links that one task joins, at most: about 30 MB of it.
FEW = 1 << 17


def _mark(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return r.n, r.x


def _finished(links: DataFrame) -> DataFrame:
    """(id, component) of at most FEW links, joined in one task."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := over.setdefault(x, x)) != x:
                over[x] = x = over[up]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                if a != b:
                    over[max(a, b)] = min(a, b)
        ids = list(over)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([top(i) for i in ids], pa.int64())], names=["id", "component"])

    return links.select("u", "v").coalesce(1).mapInArrow(join, "id long, component long")


def components(links: DataFrame, few: int | None = None) -> DataFrame:
    """(id, component), written, for every id of ``links`` (u, v); component is the smallest id reachable.

    As soon as the table has no more than ``few`` links (FEW), one task joins them; until then, steps over all tasks.
    """
    few = FEW if few is None else few
    e = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e)
    mark = _mark(e)
    while mark[0]:
        if mark[0] <= few:
            out = written(_finished(e))
            discard(e)
            return out
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(new.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = _mark(new)
        discard(e)
        e, stands = new, now == mark
        mark = now
        if stands:
            break
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    out = written(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots))
    discard(e)
    return out

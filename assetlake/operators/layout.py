"""Layout of containers: windows over entries in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cuts import written


def _order(by: str, ordinal: str):
    return Window.partitionBy(by).orderBy(ordinal)


def sizes_from_offsets(entries: DataFrame, end: Column, by: str = "archive", ordinal: str = "ordinal", offset: str = "offset") -> DataFrame:
    """Adds payload_size: the next offset, or the end, less this one."""
    following = F.lead(offset).over(_order(by, ordinal))
    return entries.withColumn("payload_size", F.coalesce(following, end) - F.col(offset))


def body_mismatches(entries: DataFrame, end: Column, by: str = "archive", ordinal: str = "ordinal") -> DataFrame:
    """Entries whose room in the archive is not stored_size less header_size: physical, expected."""
    sized = sizes_from_offsets(entries, end, by, ordinal).withColumnRenamed("payload_size", "physical")
    return sized.withColumn("expected", F.col("stored_size") - F.col("header_size")).where("physical != expected")


def out_of_order(entries: DataFrame, by: str = "archive", ordinal: str = "ordinal", offset: str = "offset") -> DataFrame:
    """Entries that begin before the one ahead of them."""
    before = F.lag(offset).over(_order(by, ordinal))
    return entries.withColumn("before", before).where(F.col(offset) < F.col("before"))


def running_offsets(entries: DataFrame, start: Column, by: str = "archive", ordinal: str = "ordinal", size: str = "size") -> DataFrame:
    """Adds offset: the start and the sizes of all entries ahead."""
    ahead = F.sum(size).over(_order(by, ordinal).rowsBetween(Window.unboundedPreceding, -1))
    return entries.withColumn("offset", start + F.coalesce(ahead, F.lit(0)))


def sequence_gaps(pages: DataFrame, by: str = "serial", ordinal: str = "page", sequence: str = "sequence") -> DataFrame:
    """Pages whose sequence number is not one more than the last of their stream."""
    before = F.lag(sequence).over(_order(by, ordinal))
    return pages.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(sequence) != F.col("before") + 1))


def first_wins(rows: DataFrame, key: Column, ordinal: str = "ordinal") -> DataFrame:
    """Of rows with one key, the first."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(ordinal))
    return rows.withColumn("n", n).where("n = 1").drop("n")


def identity(entries: DataFrame, fields: list[str], by: str = "archive", ordinal: str = "ordinal", block: int = 4096) -> DataFrame:
    """identity_sha256 of each archive: a digest of the chosen fields of its entries in order.

    Each entry is digested where it lies, then each block of ordinals, then the blocks of an archive, so that
    no group holds more than ``block`` entries, or one digest a block.
    """
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("\\N")) for f in fields]), 256)

    def folded(rows: DataFrame, *keys: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: x.d), "\n")
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("d"))

    rows = entries.select(by, F.col(ordinal).alias("o"), F.floor(F.col(ordinal) / block).alias("block"), line.alias("d"), F.lit(1).cast("long").alias("n"))
    blocks = folded(rows, by, "block").withColumnRenamed("block", "o")
    return folded(blocks, by).select(by, F.col("n").alias("entries"), F.col("d").alias("identity_sha256"))


def lineage(nodes: DataFrame, key: str = "id", parent: str = "parent", name: str = "name") -> DataFrame:
    """id, depth, path of every node of a forest: one join per level, as long as there are nodes below. Each level
    is written to the shared folder, so that none is computed twice.

    Nodes that no root reaches have no row; ``unreached`` names them. An id that is its own ancestor below a root raises.
    """
    level = nodes.where(F.col(parent).isNull()).select(F.col(key).alias("id"), F.lit(0).alias("depth"), F.col(name).alias("path"))
    out, below = level, nodes.where(F.col(parent).isNotNull())
    most, depth = nodes.count(), 0
    while True:
        depth += 1
        up = level.select(F.col("id").alias(parent), F.col("path").alias("above"))
        level = written(below.join(up, parent).select(F.col(key).alias("id"), F.lit(depth).alias("depth"), F.concat_ws("/", "above", name).alias("path")))
        if level.isEmpty():
            return out
        if depth > most:
            raise ValueError("an id is its own ancestor")
        out = out.unionByName(level)


def unreached(nodes: DataFrame, key: str = "id", parent: str = "parent", name: str = "name") -> DataFrame:
    """The nodes that no root reaches: those below a missing parent, or in or below a cycle."""
    return nodes.join(lineage(nodes, key, parent, name).select(F.col("id").alias(key)), key, "left_anti").select(nodes.columns)

"""Summaries of file catalogs.

A catalog has a row per file: archive, ordinal, path, size, and what an operator names besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, paths
from .probing import ordered


def totals(files: DataFrame, size: str = "size") -> DataFrame:
    """file_count, total_size; zeros for no files."""
    return files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_size"))


def counts_by(files: DataFrame, *by: str, size: str | None = None) -> DataFrame:
    """Files (and bytes) of each group."""
    more = [F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_size")] if size else []
    return files.groupBy(*by).agg(F.count("*").alias("file_count"), *more)


def top_headers(files: DataFrame, by: str = "extension", header: str = "header_hex", ordinal: str = "ordinal", k: int = 10) -> DataFrame:
    """The k most frequent headers of each group; of equally frequent ones the first seen."""
    counted = files.groupBy(by, header).agg(F.count("*").alias("file_count"), F.min(ordinal).alias("first_seen"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("file_count"), "first_seen"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def summary(files: DataFrame, archive: str = "archive", extension: str = "extension", fmt: str = "format", size: str = "size") -> DataFrame:
    """Files and bytes over all, by extension, by format, by archive, and by both within an archive.

    One scan and one shuffle: level is total, extension, format, archive, archive_extension or archive_format.
    """
    sets = [[], [extension], [fmt], [archive], [archive, extension], [archive, fmt]]
    out = files.groupingSets([[F.col(c) for c in s] for s in sets], archive, extension, fmt).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("file_count"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_size")
    )
    level = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 5, "extension").when(F.col("gid") == 6, "format").when(F.col("gid") == 3, "archive").when(F.col("gid") == 1, "archive_extension").otherwise("archive_format")
    key = F.when(F.col("gid").isin(5, 1), F.col(extension)).when(F.col("gid").isin(6, 2), F.col(fmt))
    return out.select(level.alias("level"), F.col(archive).alias("archive"), key.alias("key"), "file_count", "total_size")


def described(files: DataFrame, header: str = "header") -> DataFrame:
    """A catalog with archive (first path segment), extension and detected_format from path, size and first bytes."""
    out = files.withColumn("archive", paths.first_segment(F.col("path"))).withColumn("extension", paths.extension(F.col("path")))
    return out.withColumn("detected_format", formats.detect(F.col(header), F.col("extension"), F.col("size")))


def numbered(files: DataFrame, by: str = "path", name: str = "ordinal") -> DataFrame:
    """Ordinals from 1 in the order of lower-cased ``by``, then ``by`` itself."""
    return ordered(files, F.lower(by), F.col(by), name=name)


def archive_problems(files: DataFrame, suffix: str = ".gpk") -> DataFrame:
    """stem, problem of a folder of archives, names compared without case: stems that two of its own files have; a folder without any has one row.

    files: path, relative to the folder. Files in folders below it are not its own.
    """
    own = files.where(~F.contains("path", F.lit("/")) & F.lower("path").endswith(suffix))
    stems = own.groupBy(F.lower(paths.stem(F.col("path"))).alias("stem")).agg(F.count("*").alias("n"))
    twice = stems.where("n > 1").select("stem", F.lit("two archives have this name").alias("problem"))
    none = own.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("stem"), F.lit("no archives").alias("problem"))
    return twice.unionByName(none)


def duplicates(rows: DataFrame, key: Column, ordinal: str = "ordinal") -> DataFrame:
    """Keys that more than one row has: key, rows, first ordinal."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n_rows"), F.min(ordinal).alias("first")).where("n_rows > 1")


def distinct_ignoring_case(rows: DataFrame, column: str) -> DataFrame:
    """values: distinct values in the order of their lower-cased form."""
    pairs = F.array_sort(F.collect_set(F.struct(F.lower(column).alias("low"), F.col(column).alias("value"))))
    return rows.agg(F.transform(pairs, lambda x: x.value).alias("values"))


def report_lines(files: DataFrame) -> DataFrame:
    """Text lines of a catalog in its order: ordinal, line."""
    line = F.concat_ws("  ", F.lpad(F.col("ordinal").cast("string"), 6, " "), F.col("detected_format"), F.col("size").cast("string"), F.col("path"))
    return files.select("ordinal", line.alias("line"))

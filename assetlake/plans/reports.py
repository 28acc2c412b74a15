"""Reports of a catalog: tables as Parquet or JSON lines, listings as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.binary import human_size
from ..operators import inventory


def write_tables(folder: str, form: str = "parquet", **tables: DataFrame) -> None:
    """Each table under its name as ``form``, parquet or json (lines); a report that is there is not overwritten."""
    if form not in ("parquet", "json"):
        raise ValueError(f"unknown form {form!r}")
    for name, df in tables.items():
        df.write.format(form).mode("errorifexists").save(f"{folder}/{name}")


def listing(assets: DataFrame) -> DataFrame:
    """One line per file, in the order of its path."""
    rows = inventory.numbered(assets)
    return inventory.report_lines(rows).orderBy("ordinal").select("line")


def unknown(assets: DataFrame) -> DataFrame:
    """The listing of files whose format is not known, numbered among themselves."""
    return listing(assets.where(F.col("detected_format") == formats.UNKNOWN))


def summary_lines(summary: DataFrame) -> DataFrame:
    """Lines of ``inventory.summary``: the total, then each level, largest count first."""
    text = F.concat_ws("  ", "level", F.coalesce("archive", F.lit("*")), F.coalesce("key", F.lit("*")), F.col("file_count").cast("string"), human_size(F.col("total_size")))
    order = F.array_position(F.array(*[F.lit(x) for x in ("total", "extension", "format", "archive", "archive_extension", "archive_format")]), F.col("level"))
    return summary.orderBy(order, F.lower("archive"), F.desc("file_count"), "key").select(text.alias("line"))


def write_text(lines: DataFrame, folder: str) -> None:
    """Lines in their order as one text file: a report for people, small by nature."""
    lines.coalesce(1).write.mode("errorifexists").text(folder)

"""Filtering, selecting and paging the rows of a catalog."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .probing import ordered

PAGE = 500


def in_folder(archive: Column, path: Column, scope: tuple[str, str]) -> Column:
    """Inside (archive, folder); an empty folder is the whole archive."""
    name, folder = scope
    inside = F.startswith(path, F.lit(folder.rstrip("/") + "/")) if folder else F.lit(True)
    return (archive == F.lit(name)) & inside


def filter_rows(rows: DataFrame, query: str = "", extension: str = "", format_name: str = "", state: str = "", scope: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """Rows that hold all words of the query in archive/path (case ignored), with this extension, format and
    state, inside one of the folders of the scope.

    An empty string asks for nothing; so does a scope of None, but an empty scope holds no row.
    """
    text = F.lower(F.concat_ws("/", "archive", "path"))
    tests = [F.contains(text, F.lit(word)) for word in query.lower().split()]
    if extension:
        tests.append(F.lower("extension") == extension.lower())
    if format_name:
        tests.append(F.col("format") == format_name)
    if state:
        tests.append(F.col("state") == state)
    if scope is not None:
        tests.append(reduce(Column.__or__, [in_folder(F.col("archive"), F.col("path"), s) for s in scope], F.lit(False)))
    return rows.where(reduce(Column.__and__, tests)) if tests else rows


def select_rows(rows: DataFrame, files: DataFrame | None = None, folders: Iterable[tuple[str, str]] = (), everything: bool = False) -> DataFrame:
    """Rows that are named (archive, path), lie in a folder, or all; each once; unknown files are ignored."""
    if everything:
        return rows
    inside = reduce(Column.__or__, [in_folder(F.col("archive"), F.col("path"), s) for s in folders], F.lit(False))
    if files is None:
        return rows.where(inside)
    named = files.select("archive", "path").distinct().withColumn("named", F.lit(True))
    return rows.join(named, ["archive", "path"], "left").where(F.coalesce("named", F.lit(False)) | inside).drop("named")


def preferred(rows: DataFrame, marks: DataFrame | None = None, picked: DataFrame | None = None, files: DataFrame | None = None, folders: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """What a user means: the rows they marked; without marks those picked in the table; without these files and folders of the tree.

    Marks, picked rows and files have archive and path; marks that the catalog no longer has count for nothing.
    """
    for names in (marks, picked):
        if names is not None:
            own = rows.join(names.select("archive", "path").distinct(), ["archive", "path"], "left_semi")
            if not own.isEmpty():
                return own
    return select_rows(rows, files, folders)


def natural(rows: DataFrame, name: str = "row") -> DataFrame:
    """Rows (archive, path, is_extra, ordinal) numbered in natural order: archives by name, entries as their index has them, then extra files."""
    return ordered(rows, F.lower("archive"), "archive", "is_extra", "ordinal", F.lower("path"), "path", name=name)


def by_archive(rows: DataFrame) -> DataFrame:
    """archive, paths in catalog order. A selection is as long as its reader wants; large ones stay rows."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "path")))
    return rows.groupBy("archive").agg(F.transform(ordered, lambda x: x.path).alias("paths"))


def page(rows: DataFrame, *order: str | Column, number: int = 0, size: int = PAGE) -> DataFrame:
    """One page of the rows in an order; beyond the end, the last page."""
    total = rows.count()
    last = max(1, -(-total // size)) - 1
    return rows.orderBy(*order).offset(min(max(0, number), last) * size).limit(size)


def page_numbers(rows: DataFrame, *order: str | Column, size: int = PAGE) -> DataFrame:
    """Rows of an ordered listing with their page and their place on it, numbered by ranges."""
    n = F.col("_n") - 1
    return ordered(rows, *order, name="_n").withColumn("page", F.floor(n / size)).withColumn("place", n % size).drop("_n")


def folders(rows: DataFrame) -> DataFrame:
    """archive, folder, depth, file_count of every folder above a file."""
    up = rows.select("archive", F.posexplode(paths.ancestors(F.col("path"))).alias("k", "folder"))
    return up.groupBy("archive", "folder").agg((F.first("k") + 1).alias("depth"), F.count("*").alias("file_count"))


def still_there(marks: DataFrame, rows: DataFrame) -> DataFrame:
    """Marks (archive, path) that the catalog still has."""
    return marks.select("archive", "path").intersect(rows.select("archive", "path"))


def choices(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()


def choices_in_order(rows: DataFrame, column: str, ordinal: str = "ordinal") -> DataFrame:
    """Distinct values with the ordinal at which each is first seen."""
    return rows.groupBy(column).agg(F.min(ordinal).alias("first_seen"))

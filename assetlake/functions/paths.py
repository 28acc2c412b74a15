"""Relative paths as Column expressions; separators are slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """'.txt', lower-cased; '' for none. A name's leading dot begins no suffix."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def extension(path: Column) -> Column:
    s = suffix(path)
    return F.when(s == "", "[no extension]").otherwise(s)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def first_segment(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def ancestors(path: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def is_relative(path: Column) -> Column:
    """No backslash, no root or drive, no empty part, '.' or '..'."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"\\|^/|^[A-Za-z]:") & ~path.rlike(r"(^|/)(\.{1,2})?(/|$)")


def is_inside(path: Column) -> Column:
    """Backslashes count as slashes; no root, drive or '..' part."""
    p = F.regexp_replace(path, r"\\", "/")
    return path.isNotNull() & (p != "") & ~p.rlike(r"^/|^[A-Za-z]:") & ~p.rlike(r"(^|/)\.\.(/|$)")


def is_archive_name(text: Column) -> Column:
    return text.isNotNull() & (text != "") & ~text.rlike(r"[/\\]") & ~text.isin(".", "..")


def is_identity(text: Column) -> Column:
    return text.rlike(r"\A[a-z0-9][a-z0-9._-]{2,63}\z")


def is_version(text: Column) -> Column:
    return text.rlike(r"\A[0-9A-Za-z][0-9A-Za-z._+-]{0,31}\z")


def is_digest(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{64}\z")


def overlap(a: Column, b: Column) -> Column:
    """One path is the other or lies in it."""
    x, y = F.rtrim(a, F.lit("/")), F.rtrim(b, F.lit("/"))
    return (x == y) | F.startswith(x, F.concat(y, F.lit("/"))) | F.startswith(y, F.concat(x, F.lit("/")))

"""Catalog versions joined and classified: reference index, recorded extraction, workspace, baseline, package."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats

#: States of a catalog row.
ORIGINAL, MODIFIED, MISSING, NEW, INVALID, NOT_EXTRACTED, NOT_VERIFIED = "original", "modificado", "ausente", "novo", "inválido", "não extraído", "não verificado"
SAME, REPLACE, RETAIN, NOT_INCLUDED = "igual", "substituir", "manter referência", "novo — não incluído"
KEY = ["archive", "path"]


def extracted(recorded: Column, flag: Column) -> Column:
    """Was the entry extracted? No record: no. A record that does not say: yes."""
    return F.when(recorded.isNull(), F.lit(False)).otherwise(F.coalesce(flag, F.lit(True)))


def matched_references(workspaces: DataFrame, references: DataFrame, name: str = "name", stem: str = "stem") -> DataFrame:
    """Every workspace with its reference, names compared without case: status FOUND or FAILED with an error."""
    r = references.withColumn("low", F.lower(stem)).drop(stem) if stem in references.columns else references
    out = workspaces.withColumn("low", F.lower(name)).join(r.withColumn("matched", F.lit(True)), "low", "left").drop("low")
    found = F.coalesce("matched", F.lit(False))
    return out.withColumn("status", F.when(found, "FOUND").otherwise("FAILED")).withColumn("error", F.when(~found, "Matching reference archive not found")).drop("matched")


def catalog(index: DataFrame, recorded: DataFrame) -> DataFrame:
    """Index entries with what is recorded of them: not verified yet, or not extracted.

    recorded: archive, path, extracted (may be null).
    """
    r = recorded.select(*KEY, F.lit(True).alias("recorded"), "extracted")
    out = index.join(r, KEY, "left")
    return out.withColumn("state", F.when(extracted(F.col("recorded"), F.col("extracted")), NOT_VERIFIED).otherwise(NOT_EXTRACTED)).drop("recorded", "extracted")


def refreshed(index: DataFrame, recorded: DataFrame, workspace: DataFrame) -> DataFrame:
    """State of every index entry against the workspace, and of every file outside the index.

    index: archive, path, size; recorded: archive, path, extracted, extracted_sha256; workspace: archive, path,
    size, sha256, errors (array, empty or null for none). One full join of the workspace; no row is lost.
    """
    entries = index.select(*KEY, F.col("size").alias("index_size"), F.lit(True).alias("indexed"))
    known = recorded.select(*KEY, F.lit(True).alias("recorded"), "extracted", "extracted_sha256")
    files = workspace.select(*KEY, F.lit(True).alias("present"), F.col("size").alias("file_size"), "sha256", "errors")
    out = entries.join(known, KEY, "left").join(files, KEY, "full_outer")
    present, indexed = F.coalesce("present", F.lit(False)), F.coalesce("indexed", F.lit(False))
    taken = extracted(F.col("recorded"), F.col("extracted"))
    broken = F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0
    state = (
        F.when(~indexed, NEW).when(~taken & present, NEW).when(~taken, NOT_EXTRACTED).when(~present, MISSING)
        .when(F.col("sha256").eqNullSafe(F.col("extracted_sha256")), ORIGINAL).when(broken, INVALID).otherwise(MODIFIED)
    )
    return out.select(*KEY, state.alias("state"), F.coalesce("file_size", "index_size").alias("size"), "sha256", F.when(state == INVALID, F.col("errors")).alias("errors"))


def nontrivial(rows: DataFrame) -> DataFrame:
    """Rows that a user has to look at: neither original nor not extracted."""
    return rows.where(~F.col("state").isin(ORIGINAL, NOT_EXTRACTED))


def baseline(recorded: DataFrame, workspace: DataFrame) -> DataFrame:
    """archive, path, sha256, status PASS or FAIL, error: is each extracted entry as it was recorded?"""
    files = workspace.select(*KEY, F.lit(True).alias("present"), "sha256")
    out = recorded.where(F.coalesce("extracted", F.lit(True))).join(files, KEY, "left")
    error = F.when(F.col("present").isNull(), "Asset is missing from workspace").when(~F.col("sha256").eqNullSafe(F.col("extracted_sha256")), "Workspace is not clean")
    return out.select(*KEY, "sha256", F.when(error.isNull(), "PASS").otherwise("FAIL").alias("status"), error.alias("error"))


def status_fold(rows: DataFrame, *by: str, bad: str = "FAIL", status: str = "status", otherwise: str = "PARTIAL") -> DataFrame:
    """passed, failed and one status of all."""
    failed = F.count_if(F.col(status) == bad)
    return rows.groupBy(*by).agg(F.count_if(F.col(status) == "PASS").alias("passed"), failed.alias("failed"), F.when(failed == 0, "PASS").otherwise(otherwise).alias("status"))


def validated(base: DataFrame, workspace: DataFrame, allow_unknown: bool = False) -> DataFrame:
    """One row per baseline entry and per file outside it: status UNCHANGED, PASS or FAIL, whether modified, error.

    base: archive, path, format, sha256; workspace: archive, path, sha256, errors, warnings.
    """
    entries = base.select(*KEY, "format", F.col("sha256").alias("original_sha256"), F.lit(True).alias("expected"))
    files = workspace.select(*KEY, "sha256", "errors", "warnings", F.lit(True).alias("present"))
    out = entries.join(files, KEY, "full_outer")
    none = F.array().cast("array<string>")
    here, expected = F.coalesce("present", F.lit(False)), F.coalesce("expected", F.lit(False))
    modified = expected & here & ~F.col("sha256").eqNullSafe(F.col("original_sha256"))
    unknown = F.lit(not allow_unknown) & F.col("format").isin(formats.UNKNOWN, "DAT/UNKNOWN")
    error = (
        F.when(~expected, "Extra entries are unsupported").when(~here, "Asset is missing from workspace")
        .when(modified & unknown, "Modified unknown format requires permission").when(modified & (F.size(F.coalesce("errors", none)) > 0), F.array_join("errors", "; "))
    )
    status = F.when(error.isNotNull(), "FAIL").when(modified, "PASS").otherwise("UNCHANGED")
    warnings = F.when(status == "PASS", F.size(F.coalesce("warnings", none))).otherwise(0)
    return out.select(*KEY, F.when(expected, F.col("format")).otherwise("EXTRA").alias("format"), status.alias("status"), modified.alias("modified"), (~expected).alias("extra"), error.alias("error"), warnings.alias("warning_count"))


def validation_counts(rows: DataFrame) -> DataFrame:
    """modified, unchanged, extra, failed, warnings, status; unknown or incompatible edits count as modified and as failed."""
    failed = F.count_if(F.col("status") == "FAIL")
    return rows.agg(
        F.count_if("modified").alias("modified"), F.count_if(F.col("status") == "UNCHANGED").alias("unchanged"), F.count_if("extra").alias("extra"), failed.alias("failed"),
        F.coalesce(F.sum("warning_count"), F.lit(0)).cast("long").alias("warnings"), F.when(failed == 0, "PASS").otherwise("FAIL").alias("status"),
    )


def folder_preview(index: DataFrame, folder: DataFrame) -> DataFrame:
    """What a folder of edits would replace: path, state. index: path, sha256 of the reference; folder: path, sha256."""
    out = index.select("path", F.col("sha256").alias("reference"), F.lit(True).alias("indexed")).join(folder.select("path", F.col("sha256").alias("edit"), F.lit(True).alias("present")), "path", "full_outer")
    state = F.when(F.col("indexed").isNull(), NOT_INCLUDED).when(F.col("present").isNull(), RETAIN).when(F.col("edit").eqNullSafe(F.col("reference")), SAME).otherwise(REPLACE)
    return out.select("path", state.alias("state"))


def preview_counts(rows: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    return rows.agg(n(REPLACE).alias("replacements"), n(SAME).alias("unchanged"), n(RETAIN).alias("retained"), n(NOT_INCLUDED).alias("extras"))


def extras(present: DataFrame, declared: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``present`` that ``declared`` has no key of."""
    return present.join(declared.select(*on).distinct(), on, "left_anti")


def name_mismatch(declared: DataFrame, found: DataFrame) -> DataFrame:
    """name, problem: 'missing' or 'extra', each as often as counts differ."""
    return declared.exceptAll(found).withColumn("problem", F.lit("missing")).unionByName(found.exceptAll(declared).withColumn("problem", F.lit("extra")))


def apply_plan(package: DataFrame, workspaces: DataFrame, entries: DataFrame, current: DataFrame, backups: DataFrame) -> DataFrame:
    """Each file of a package with the first check that it fails (null: none), in a fixed order."""
    low = package.withColumn("low", F.lower("archive"))
    w = workspaces.select(F.lower("archive").alias("low"), F.lit(True).alias("w"))
    e = entries.select(F.lower("archive").alias("low"), "path", F.lit(True).alias("e"), "extracted_sha256")
    c = current.select(F.lower("archive").alias("low"), "path", F.col("sha256").alias("current_sha256"))
    b = backups.select(F.lower("archive").alias("low"), "path", F.col("sha256").alias("backup_sha256"))
    out = low.join(w, "low", "left").join(e, ["low", "path"], "left").join(c, ["low", "path"], "left").join(b, ["low", "path"], "left")
    failure = (
        F.when(F.col("w").isNull(), "workspace not found").when(F.col("e").isNull(), "entry not in the archive")
        .when(~F.col("extracted_sha256").eqNullSafe(F.col("original_sha256")), "package was built for another original")
        .when(F.col("current_sha256").isNull(), "file is missing").when(F.col("current_sha256") != F.col("original_sha256"), "file was edited")
        .when(F.col("backup_sha256").isNotNull() & (F.col("backup_sha256") != F.col("original_sha256")), "backup differs from the original")
    )
    return out.select("archive", "path", failure.alias("failure"))


def remove_plan(installed: DataFrame, current: DataFrame, backups: DataFrame) -> DataFrame:
    """Each installed file: restore it (true), leave it as it is the original (false), or null with a conflict."""
    c = current.select(*KEY, F.col("sha256").alias("current_sha256"))
    b = backups.select(*KEY, F.col("sha256").alias("backup_sha256"))
    out = installed.join(c, KEY, "left").join(b, KEY, "left")
    at_original, at_modified = F.col("current_sha256").eqNullSafe(F.col("original_sha256")), F.col("current_sha256").eqNullSafe(F.col("modified_sha256"))
    conflict = F.when(F.col("current_sha256").isNull(), "file is missing").when(~at_original & ~at_modified, "file was edited later").when(at_modified & ~F.col("backup_sha256").eqNullSafe(F.col("original_sha256")), "backup is missing or damaged")
    return out.select(*KEY, F.when(conflict.isNull(), at_modified).alias("needs_restore"), conflict.alias("conflict"))


def requested(names: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Requested names (ordinal, name) in their order, with the workspace's own spelling; missing ones say so."""
    w = workspaces.select(F.lower("name").alias("low"), F.col("name").alias("workspace"))
    out = names.withColumn("low", F.lower("name")).join(w, "low", "left")
    return out.select("ordinal", "name", "workspace", F.col("workspace").isNull().alias("missing"))


def identity_violations(expected: DataFrame, actual: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Places (``on``) where two tables that must agree row by row do not: fields compared with nulls equal. Rows that share
    a place must occur equally often on both sides, in any order; a place is told once."""
    side = lambda rows, n: rows.select(*on, F.struct(*fields).alias("fields"), F.lit(n).alias("side"))
    rows = side(expected, 1).unionByName(side(actual, -1))
    each = rows.groupBy(*on, "fields").agg(F.sum("side").alias("balance"), F.min("side").alias("least"), F.max("side").alias("most"))
    places = each.groupBy(*on).agg(F.max(F.col("balance") != 0).alias("differs"), F.min("least").alias("least"), F.max("most").alias("most"))
    problem = F.when(F.col("least") == 1, "missing").when(F.col("most") == -1, "extra").when(F.col("differs"), "differs")
    return places.select(*on, problem.alias("problem")).where("problem is not null")


def issues(rows: DataFrame, mode: str = "strict", allow_unknown: bool = False) -> DataFrame:
    """archive, path, reason, category, severity of every problem of catalog rows.

    rows: archive, path, state, format, errors, warnings. Container problems always block; broken or unknown
    formats only warn in 'experimental' mode, unknown ones also with ``allow_unknown``.
    """
    if mode not in ("strict", "experimental"):
        raise ValueError(f"unknown mode {mode!r}")
    none = F.array().cast("array<string>")
    soft = F.lit("warning" if mode == "experimental" else "error")
    softer = F.lit("warning" if mode == "experimental" or allow_unknown else "error")
    state, reasons = F.col("state"), F.coalesce("errors", none)
    one = lambda reason, category, severity: F.struct(reason.alias("reason"), F.lit(category).alias("category"), severity.alias("severity"))
    blocked = F.when(state == MISSING, "extracted file is missing").when(state == NEW, "file is not in the index").when(state == NOT_VERIFIED, "file is not verified")
    container = F.when(blocked.isNotNull(), F.array(one(blocked, "container", F.lit("error"))))
    invalid = F.when(state == INVALID, F.transform(F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("incompatible format"))), lambda x: one(x, "asset_format", soft)))
    unknown = F.when(state.isin(MODIFIED, INVALID) & ~F.col("format").isin(*formats.CHECKED), F.array(one(F.lit("content of unknown format is not checked"), "unknown_format", softer)))
    advice = F.transform(F.coalesce("warnings", none), lambda x: one(x, "asset_warning", F.lit("warning")))
    empty = F.array().cast("array<struct<reason:string,category:string,severity:string>>")
    every = F.flatten(F.array(*[F.coalesce(x, empty) for x in (container, invalid, unknown, advice)]))
    return rows.select(*KEY, F.inline(every))


def issue_summary(rows: DataFrame, mode: str = "strict", allow_unknown: bool = False) -> DataFrame:
    return issue_summaries(rows, (mode,), allow_unknown)


def issue_summaries(rows: DataFrame, modes: Sequence[str] = ("strict", "experimental"), allow_unknown: bool = False) -> DataFrame:
    """One row for each mode: mode, checked, modified, invalid, not_extracted, blocking,
    warnings, status. One pass over the rows counts for all modes."""
    if set(modes) - {"strict", "experimental"}:
        raise ValueError(f"unknown mode in {modes!r}")
    s, none = F.col("state"), F.array().cast("array<string>")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = rows.agg(
        F.count("*").alias("checked"), F.count_if(s.isin(MODIFIED, INVALID)).alias("modified"), F.count_if(s == INVALID).alias("invalid"), F.count_if(s == NOT_EXTRACTED).alias("not_extracted"),
        F.count_if(s.isin(MISSING, NEW, NOT_VERIFIED)).alias("blocked"), total(F.when(s == INVALID, F.greatest(F.size(F.coalesce("errors", none)), F.lit(1)))).alias("broken"),
        F.count_if(s.isin(MODIFIED, INVALID) & ~F.col("format").isin(*formats.CHECKED)).alias("unknown"), total(F.size(F.coalesce("warnings", none))).alias("advice"),
    )
    each = []
    for mode in modes:
        soft = mode == "experimental"
        hard = [] if soft else ["broken"] if allow_unknown else ["broken", "unknown"]
        mild = ["advice", *(c for c in ("broken", "unknown") if c not in hard)]
        add = lambda first, more: reduce(Column.__add__, [F.col(c) for c in more], F.col(first))
        each.append(F.struct(F.lit(mode).alias("mode"), add("blocked", hard).alias("blocking"), add("advice", mild[1:]).alias("warnings")))
    out = counts.withColumn("m", F.explode(F.array(*each))).select("m.mode", "checked", "modified", "invalid", "not_extracted", "m.blocking", "m.warnings")
    return out.withColumn("status", F.when(F.col("blocking") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def replaced(old: DataFrame, new: DataFrame, by: str = "archive") -> DataFrame:
    """Rows of ``old``, those of archives that ``new`` has replaced by ``new``'s."""
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new)


def pending(todo: DataFrame, completed: DataFrame, on: list[str]) -> DataFrame:
    """What an interrupted batch still has to do."""
    return todo.join(completed.select(*on).distinct(), on, "left_anti")


def extraction_tallies(selected: DataFrame, before: DataFrame, edited: DataFrame) -> DataFrame:
    """newly, already and restored counts of a selective extraction."""
    out = selected.select(*KEY).join(before.select(*KEY, F.lit(True).alias("was")), KEY, "left").join(edited.select(*KEY, F.lit(True).alias("edit")), KEY, "left")
    was, edit = F.coalesce("was", F.lit(False)), F.coalesce("edit", F.lit(False))
    return out.agg(F.count_if(~was).alias("newly"), F.count_if(was & ~edit).alias("already"), F.count_if(was & edit).alias("restored"))

"""The library's front: one object for a folder of archives and a workspace.

    s = CatalogSession(spark, packs="packs", workspace="ws", key=...)
    s.index(); s.unpack(); s.refresh(); s.validate(base); s.repack("out")
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, paths
from ..functions.binary import hex_text, printable, space_needed
from ..operators import assets, inventory, layout, rules, selection, states
from ..sources import container, packages, stack
from ..sources.arrow import flat_map, spread
from ..sources.catalog import digest, file_catalog
from ..sources.cuts import written

#: Where a workspace keeps what is recorded of it; never a part of its catalog.
OWN = ".assetlake"
#: Edits whose names are broadcast to the reading of indexes at most; more are joined by a shuffle.
BROADCAST_EDITS = 100_000


class ValidationBlocked(ValueError):
    """What ``CatalogSession.preflight`` raises: ``summary`` counts, the message names the first problems."""

    def __init__(self, summary, problems: list[str]):
        super().__init__(f"{summary.blocking} problems: " + "; ".join(problems))
        self.summary = summary


class CatalogSession:
    def __init__(self, spark: SparkSession, packs: str, workspace: str | None = None, key: bytes | None = None):
        self.spark, self.packs, self.workspace, self.key = spark, packs, workspace, key

    # -- catalogs

    def archives(self, digest: bool = False) -> DataFrame:
        """name, path, size, header and footer in hex and as text, stack_footer, sha256 of every archive."""
        rows = file_catalog(self.spark, self.packs, digest=digest).where(F.lower("path").endswith(".gpk"))
        return rows.select(
            paths.name(F.col("path")).alias("name"), "path", "size", hex_text(F.col("header")).alias("header_hex"), printable(F.col("header")).alias("header_ascii"), hex_text(F.col("footer")).alias("footer_hex"),
            printable(F.col("footer")).alias("footer_ascii"), formats.footer(F.col("footer"), F.col("size")).alias("stack_footer"), "sha256", rules.basic_errors(F.col("size"), F.col("path"), F.lit(True)).alias("errors"), "location", "footer",
        )

    def index(self) -> DataFrame:
        """Entries of all archives; archive is the name without its ending."""
        rows = file_catalog(self.spark, self.packs, partition=1 << 15).where(F.lower("path").endswith(".gpk"))  # eight archives a task
        return stack.stack_index(rows, self.key)

    def objects(self, folder: str | None = None) -> DataFrame:
        """Objects of all containers in a folder, with sizes, problems and types."""
        return container.tree_paths(container.typed(container.laid_out(container.objects(file_catalog(self.spark, folder or self.packs)))))

    def assets(self, folder: str | None = None, header: int = 32) -> DataFrame:
        """path, size, archive, extension, detected_format, header_hex of every file of a workspace."""
        rows = file_catalog(self.spark, folder or self.workspace, header=header).where(~F.col("path").rlike(r"(^|/)(\.gitkeep$|\.assetlake/)"))
        return inventory.described(rows.select("path", "size", "header", "location")).withColumn("header_hex", hex_text(F.col("header"))).drop("header")

    def summary(self, folder: str | None = None) -> DataFrame:
        return inventory.summary(self.assets(folder).withColumnRenamed("detected_format", "format"))

    # -- workspaces

    def _record(self, extracted: DataFrame) -> DataFrame:
        """Runs an extraction and records it."""
        os.makedirs(os.path.join(self.workspace, OWN), exist_ok=True)
        part = os.path.join(self.workspace, OWN, f"entries-{os.urandom(4).hex()}.parquet")
        extracted.withColumn("archive", paths.stem(F.col("archive"))).write.parquet(part)
        return self.spark.read.parquet(part)

    def unpack(self, reserve: int | None = None) -> DataFrame:
        """Extracts what is not yet extracted and records it: archive, path, extracted_size, extracted_sha256, error.

        Nothing is written unless the disk has room for all of it.
        """
        entries = self.index().where("error is null")
        done = self.recorded()
        todo = entries if done is None else entries.withColumn("stem", paths.stem(F.col("archive"))).join(done.select(F.col("archive").alias("stem"), "path"), ["stem", "path"], "left_anti")
        size = F.when(F.col("is_packed"), F.col("unpacked_size")).otherwise(F.col("stored_size"))
        todo = written(todo)  # indexes are read once
        need = todo.agg(space_needed(F.coalesce(F.sum(size), F.lit(0))).alias("n")).first().n
        os.makedirs(os.path.join(self.workspace, OWN), exist_ok=True)
        if need > shutil.disk_usage(self.workspace).free - (reserve or 0):
            raise OSError(f"{need} bytes are needed")
        return self._record(stack.extracted(todo, self.workspace))

    def recorded(self) -> DataFrame | None:
        """Recorded extractions: archive, path, ordinal, extracted, extracted_size, extracted_sha256."""
        folder = os.path.join(self.workspace, OWN)
        parts = sorted(os.path.join(folder, p) for p in os.listdir(folder) if p.startswith("entries")) if os.path.isdir(folder) else []
        if not parts:
            return None
        return self.spark.read.parquet(*parts).where("error is null").select("archive", "path", "ordinal", F.lit(True).alias("extracted"), "extracted_size", "extracted_sha256").dropDuplicates(["archive", "path"])

    def files(self) -> DataFrame:
        """archive, path, size, sha256, location of every file of the workspace."""
        rows = file_catalog(self.spark, self.workspace, digest=True).where(~F.startswith("path", F.lit(f"{OWN}/")) & F.contains("path", F.lit("/")))
        return rows.select(paths.first_segment(F.col("path")).alias("archive"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), "size", "sha256", "location")

    def _named(self, rows: DataFrame) -> DataFrame:
        """archive, path, size, sha256, location of those files of the workspace that rows (archive, path) name, archives in
        any case; no other file is listed or read."""
        root = self.workspace
        folders = [(n, n.lower()) for n in sorted(os.listdir(root)) if n != OWN and os.path.isdir(os.path.join(root, n))]  # names of archives

        def read(archive: str, path: str) -> Iterator[tuple]:
            location = os.path.join(root, archive, path)
            if os.path.isfile(location):
                yield archive, path, os.path.getsize(location), digest(location), location

        own = self.spark.createDataFrame(folders, "folder string, low string")
        named = rows.select(F.lower("archive").alias("low"), "path").distinct().join(F.broadcast(own), "low").select("folder", "path")
        return flat_map(spread(named, "folder", "path"), read, "archive string, path string, size long, sha256 string, location string")

    def _sizes(self) -> DataFrame:
        return self.index().where("error is null").select(paths.stem(F.col("archive")).alias("archive"), "path", "ordinal", F.when(F.col("is_packed"), F.col("unpacked_size")).otherwise(F.col("stored_size")).alias("size"))

    def refresh(self, check: bool = False, files: DataFrame | None = None) -> DataFrame:
        """The state of every entry and file, with archive, ordinal and is_extra for the natural order: archives by
        name, entries as their index has them, then extra files by path.

        ``check``: edits are held against the originals; those that do not fit are invalid. ``files``: what ``files`` gave,
        where it is written already.
        """
        index, files = written(self._sizes()), written(self.files()) if files is None else files  # listed and digested once
        known = self.recorded()
        if known is None:
            known = index.limit(0).select("archive", "path", F.lit(True).alias("extracted"), F.lit("").alias("extracted_sha256"))
        files = files.select("archive", "path", "size", "sha256", "location")
        if check:
            was = known.select("archive", "path", F.col("extracted_sha256").alias("was"))
            files = files.join(written(self.compared(files.join(was, ["archive", "path"]).where("sha256 != was"))), ["archive", "path"], "left")
        else:
            files = files.withColumns({"errors": F.lit(None).cast("array<string>"), "warnings": F.lit(None).cast("array<string>")})
        rows = states.refreshed(index, known, files)
        rows = rows.join(files.select("archive", "path", "warnings"), ["archive", "path"], "left").join(index.select("archive", "path", "ordinal"), ["archive", "path"], "left")
        return rows.withColumn("format", formats.by_extension(paths.extension(F.col("path")))).withColumn("is_extra", F.col("ordinal").isNull())

    def natural(self, rows: DataFrame) -> DataFrame:
        """Rows of ``refresh`` with their row number in natural order."""
        return selection.natural(rows)

    def compared(self, edits: DataFrame) -> DataFrame:
        """archive, path, errors, warnings of edited files (archive, path, location). Only what was edited is read: the index
        is joined to the edits before payloads are inflated, and files are opened by their rows."""
        edits = written(edits.select("archive", "path", "location").withColumn("format", formats.by_extension(paths.extension(F.col("path")))).where(F.col("format").isin(*assets.READERS)))
        wanted = self.index().where("error is null").withColumn("stem", paths.stem(F.col("archive"))).join(F.broadcast(edits.select(F.col("archive").alias("stem"), "path")) if edits.count() < BROADCAST_EDITS else edits.select(F.col("archive").alias("stem"), "path"), ["stem", "path"], "left_semi")
        old = stack.payloads(wanted).select(paths.stem(F.col("archive")).alias("archive"), "path", F.col("content").alias("old"))
        new = assets.with_content(edits).withColumnRenamed("content", "new")
        return assets.compared(written(new.join(old, ["archive", "path"], "left")))

    def baseline(self, allow_unknown: bool = True) -> DataFrame:
        """What a clean workspace holds: archive, path, format, sha256, status, error. Without ``allow_unknown`` files of
        an unknown format fail."""
        out = states.baseline(self.recorded(), self.files()).withColumn("format", formats.by_extension(paths.extension(F.col("path"))))
        if allow_unknown:
            return out
        bad = F.col("error").isNull() & ~F.col("format").isin(*formats.CHECKED)
        out = out.withColumn("error", F.when(bad, "unknown format requires permission").otherwise(F.col("error")))
        return out.withColumn("status", F.when(F.col("error").isNull(), "PASS").otherwise("FAIL"))

    def validate(self, base: DataFrame, allow_unknown: bool = False) -> DataFrame:
        """Edits against a baseline; those of checked formats are held against the originals in the archives."""
        files = self.files()
        found = self.compared(files.join(base.select("archive", "path", F.col("sha256").alias("was")), ["archive", "path"]).where("sha256 != was"))
        return states.validated(base, files.join(found, ["archive", "path"], "left"), allow_unknown)

    def preflight(self, names: list[str] | None = None, mode: str = "strict", allow_unknown: bool = False, files: DataFrame | None = None) -> DataFrame:
        """The checked rows of archives (all, or those named), if nothing blocks; raises ``ValidationBlocked`` otherwise.

        Problems of the container always block; edits that do not fit or are of unknown format only warn in
        mode 'experimental', unknown ones also with ``allow_unknown``.
        """
        rows = self.refresh(check=True, files=files)
        if names is not None:
            rows = rows.where(F.lower("archive").isin(*[n.lower() for n in names]) if names else F.lit(False))
        rows = written(rows)
        self.last_validation = states.issue_summary(rows, mode, allow_unknown).first()
        if self.last_validation.blocking:
            some = states.issues(rows, mode, allow_unknown).where("severity = 'error'").orderBy("archive", "path").limit(5).collect()
            raise ValidationBlocked(self.last_validation, [f"{r.archive}/{r.path}: {r.reason}" for r in some])
        return rows

    def repack(self, folder: str, names: list[str] | None = None, mode: str = "strict", allow_unknown: bool = False) -> DataFrame:
        """Rebuilds archives (all, or those named) with the workspace's edits, after ``preflight``."""
        return self._rebuilt(self.preflight(names, mode, allow_unknown), folder)

    def _rebuilt(self, rows: DataFrame, folder: str) -> DataFrame:
        stems = rows.select(F.col("archive").alias("stem")).distinct()
        entries = self.index().withColumn("stem", paths.stem(F.col("archive"))).join(stems, "stem", "left_semi")
        edits = rows.where(F.col("state").isin(states.MODIFIED, states.INVALID)).select(F.col("archive").alias("stem"), "path", F.concat_ws("/", F.lit(self.workspace), "archive", "path").alias("source"))
        full = entries.select("archive", "stem").distinct()
        return stack.rebuilt(entries.drop("stem"), edits.join(full, "stem").select("archive", "path", "source"), folder)

    # -- selections and batches

    def extract(self, files: DataFrame | None = None, folders: Sequence[tuple[str, str]] = (), everything: bool = False, restore: bool = False) -> dict:
        """Extracts a selection (archive, path, or folders) and tells how many entries were newly extracted, were there
        already, and were restored: edited or lost files come back only with ``restore``."""
        index = self.index().where("error is null").withColumn("full", F.col("archive")).withColumn("archive", paths.stem(F.col("archive")))
        chosen = selection.select_rows(index, files, folders, everything)
        known, here = self.recorded(), self.files()
        before = known.select("archive", "path") if known is not None else chosen.limit(0).select("archive", "path")
        same = before.limit(0) if known is None else known.join(here, ["archive", "path"]).where("sha256 = extracted_sha256").select("archive", "path")
        edited = before.join(same, ["archive", "path"], "left_anti") if restore else before.limit(0)
        tallies = states.extraction_tallies(chosen, before, edited).first().asDict()
        todo = chosen.join(before, ["archive", "path"], "left_anti").withColumn("restore", F.lit(False))
        if restore:
            todo = todo.unionByName(chosen.join(edited, ["archive", "path"], "left_semi").withColumn("restore", F.lit(True)))
        done = self._record(stack.extracted(todo.withColumn("archive", F.col("full")), self.workspace))
        failed = done.where("error is not null").count()
        return {**tallies, "failed": failed, "status": "FAIL" if failed else "PASS"}

    def unpack_all(self, stop_on_error: bool = False) -> DataFrame:
        """Extracts all archives and tells for each: archive, status, entries, extracted, failed, error.

        PASS; SKIPPED_COMPLETE where all is recorded; FAILED, or PARTIAL where some entries failed; INSUFFICIENT_SPACE where
        the disk has no room for what is to be done, and nothing is written; NOT_RUN where ``stop_on_error`` and an unreadable archive kept all from starting.
        """
        bad = inventory.archive_problems(file_catalog(self.spark, self.packs).select(paths.name(F.col("path")).alias("path"))).limit(5).collect()
        if bad:
            raise ValueError("; ".join(r.problem if r.stem is None else f"{r.stem}: {r.problem}" for r in bad))
        index = written(self.index().withColumn("stem", paths.stem(F.col("archive"))))
        known = self.recorded()
        known = index.limit(0).select("stem", "path") if known is None else known.select(F.col("archive").alias("stem"), "path")
        todo = index.where("error is null").join(known, ["stem", "path"], "left_anti")
        size = F.when(F.col("is_packed"), F.col("unpacked_size")).otherwise(F.col("stored_size"))
        need = todo.agg(space_needed(F.coalesce(F.sum(size), F.lit(0))).alias("n"), F.count("*").alias("rows")).first()
        os.makedirs(os.path.join(self.workspace, OWN), exist_ok=True)
        broken = not index.where("error is not null").isEmpty()
        kept = "NOT_RUN" if stop_on_error and broken else "INSUFFICIENT_SPACE" if need.rows and need.n > shutil.disk_usage(self.workspace).free else None
        done = self._record(stack.extracted(todo if kept is None else todo.limit(0), self.workspace)).select(F.col("archive").alias("stem"), F.col("error").alias("failure"))
        made = done.groupBy("stem").agg(F.count_if(F.col("failure").isNull()).alias("extracted"), F.count_if(F.col("failure").isNotNull()).alias("failed"), F.min("failure").alias("failure"))
        asked = todo.groupBy("stem").agg(F.count("*").alias("todo"))
        each = index.groupBy("stem").agg(F.count_if(F.col("error").isNull()).alias("entries"), F.min("error").alias("error")).join(asked, "stem", "left").join(made, "stem", "left")
        status = (
            F.when(F.col("error").isNotNull(), "FAILED").when(F.col("todo").isNull(), "SKIPPED_COMPLETE").when(F.lit(kept is not None), F.lit(kept))
            .when(F.col("failed") == F.col("todo"), "FAILED").when(F.col("failed") > 0, "PARTIAL").otherwise("PASS")
        )
        return each.select(F.col("stem").alias("archive"), status.alias("status"), "entries", F.coalesce("extracted", F.lit(0)).alias("extracted"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("error", "failure").alias("error"))

    def repack_all(self, folder: str, mode: str = "strict", allow_unknown: bool = False) -> DataFrame:
        """Rebuilds every archive that can be and tells for each: archive, status, modified, error, fingerprint.

        A fingerprint of all states and digests, the archive's size and date and the mode names what a build was made of. SKIPPED_COMPLETE: that build is in the folder and
        reported; FAILED: problems block it, or another file is there without such a report; PASS.
        """
        rows = written(self.refresh(check=True))
        found = states.issues(rows, mode, allow_unknown).where("severity = 'error'").groupBy("archive").agg(F.min(F.concat_ws(": ", "path", "reason")).alias("problem"))
        stat = file_catalog(self.spark, self.packs).where(F.lower("path").endswith(".gpk")).select(paths.stem(F.col("path")).alias("archive"), F.concat_ws("|", "size", "mtime_ns", F.lit(mode)).alias("stamp"))
        marks = layout.identity(rows, ["path", "state", "sha256"], "archive", "ordinal").join(stat, "archive").select("archive", F.sha2(F.concat_ws("|", "identity_sha256", "stamp"), 256).alias("fingerprint"))
        there = file_catalog(self.spark, folder).where(F.lower("path").endswith(".gpk")).select(paths.stem(F.col("path")).alias("archive"), F.lit(True).alias("there"))
        report = os.path.join(folder, OWN)
        old = self.spark.read.json(report, schema="archive string, status string, fingerprint string").where("status = 'PASS'").select("archive", F.col("fingerprint").alias("was")) if os.path.isdir(report) else there.limit(0).select("archive", F.lit("").alias("was"))
        plan = marks.join(found, "archive", "left").join(there, "archive", "left").join(old.distinct(), ["archive"], "left")
        same = F.col("there") & (F.col("was") == F.col("fingerprint"))
        plan = plan.groupBy("archive", "fingerprint").agg(F.first("problem").alias("problem"), F.max(F.coalesce("there", F.lit(False))).alias("there"), F.max(F.coalesce(same, F.lit(False))).alias("same"))
        plan = written(plan.withColumn("status", F.when(F.col("problem").isNotNull(), "FAILED").when(F.col("same"), "SKIPPED_COMPLETE").when(F.col("there"), "FAILED").otherwise("PASS")))
        made = self._rebuilt(rows.join(plan.where("status = 'PASS'").select("archive"), "archive", "left_semi"), folder)
        made = written(made.select(paths.stem(F.col("archive")).alias("archive"), "modified", "error"))
        error = F.coalesce("problem", "error", F.when((F.col("status") == "FAILED") & F.col("there"), "another file is there already"))
        out = plan.join(made, "archive", "left").select("archive", F.when(F.col("error").isNotNull(), "FAILED").otherwise(F.col("status")).alias("status"), F.coalesce("modified", F.lit(0)).alias("modified"), error.alias("error"), "fingerprint")
        out = written(out)
        out.where("status = 'PASS'").write.mode("append").json(report)
        return out

    # -- packages

    def package(self, target: str, identity: dict, expected: str | None = None, mode: str = "strict", allow_unknown: bool = False) -> str:
        """Builds a package of the workspace's edits, after ``preflight`` of the edited archives. The workspace is listed and
        digested once; a file that has changed since is found when it is packed."""
        files = written(self.files())
        edited = written(packages.edited(self.recorded(), files))
        self.preflight([r.archive for r in edited.select("archive").distinct().collect()], mode, allow_unknown, files)  # names of archives
        return packages.build(edited, target, identity, expected)

    def _installed(self) -> str:
        return os.path.join(self.workspace, OWN, "installed.parquet")

    def _backups(self) -> tuple[str, DataFrame]:
        folder = os.path.join(self.workspace, OWN, "backup")
        rows = file_catalog(self.spark, folder, digest=True)
        return folder, rows.select(paths.first_segment(F.col("path")).alias("archive"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), "sha256")

    def install(self, package: str) -> list[str]:
        """Puts a package's files into the workspace and returns their paths; none if that package is installed already."""
        row = self.spark.createDataFrame([(os.path.basename(package), package)], "path string, location string")
        problems = packages.inspected(row).limit(5).collect()
        if problems:
            raise ValueError("; ".join(r.problem for r in problems))
        manifest = written(packages.manifests(row))
        told = manifest.select("id", "version", "name").first().asDict()
        if os.path.exists(self._installed()):
            old = self.spark.read.parquet(self._installed()).select("id", "version").first()
            if (old.id, old.version) == (told["id"], told["version"]):
                return []
            raise ValueError(f"{old.id} {old.version} is installed")
        if broken := packages.refused(manifest, told):
            raise ValueError("; ".join(broken))
        files = written(self._named(manifest))
        backups, saved = self._backups()
        plan = states.apply_plan(manifest, files.select("archive").distinct(), self.recorded(), files, saved)
        done = packages.apply(package, manifest, plan, self.workspace, backups)
        manifest.write.mode("overwrite").parquet(self._installed())
        return done

    def uninstall(self) -> list[str]:
        """Takes the installed package's files out again and returns the paths that were restored; none if there is none."""
        if not os.path.exists(self._installed()):
            return []
        installed = self.spark.read.parquet(self._installed()).select("archive", "path", "original_sha256", "modified_sha256")
        backups, saved = self._backups()
        out = packages.remove(states.remove_plan(installed, self._named(installed), saved), self.workspace, backups)
        shutil.rmtree(self._installed())
        return out

"""Container projects: all containers of a folder extracted, edited, validated against the reference and rebuilt.

    p = ContainerProject(spark, "reference", "project")
    p.build(); ...; p.validate(); p.repack("out")

The project keeps tables of its objects and loose files in ``.assetlake``; everything is rows, so that containers of any number are read,
compared and written by tasks.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, paths
from ..operators import rules, states
from ..sources import container
from ..sources.arrow import flat_map
from ..sources.catalog import file_catalog
from ..sources.cuts import written

OWN, OBJECTS, LOOSE = ".assetlake", "objects", "LOOSE"
#: What must agree between the project's objects and the reference's, place by place.
IDENTITY = ["path", "depth", "flags", "class_tag", "child_count", "payload_size", "payload_sha256"]


def _copied(rows: DataFrame, folder: str) -> DataFrame:
    """Copies files (path, location) into a folder: path, error."""

    def copy(path: str, location: str) -> Iterator[tuple]:
        target = os.path.join(folder, path)
        try:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{TaskContext.get().taskAttemptId()}.part"
            shutil.copyfile(location, part)
            os.replace(part, target)
            yield path, None
        except OSError as e:
            yield path, str(e)

    return written(flat_map(rows.select("path", "location"), copy, "path string, error string"))


class ContainerProject:
    def __init__(self, spark: SparkSession, reference: str, root: str):
        self.spark, self.reference, self.root = spark, reference, root

    def _table(self, name: str) -> str:
        return os.path.join(self.root, OWN, name)

    def _files(self) -> tuple[DataFrame, DataFrame]:
        """(containers, other files) of the reference."""
        rows = file_catalog(self.spark, self.reference, digest=True)
        is_one = formats.is_container(F.col("header"))
        return rows.where(is_one), rows.where(~is_one)

    def objects(self) -> DataFrame:
        """The reference's objects, with layout, types and digests."""
        return container.tree_paths(container.typed(container.laid_out(container.objects(self._files()[0]))))

    def build(self) -> DataFrame:
        """Extracts all containers and copies loose files into a new project: one row of tallies (containers, loose, objects, failed)."""
        if os.path.exists(self.root) and os.listdir(self.root):
            raise FileExistsError(self.root)
        inside = paths.overlap(F.lit(os.path.abspath(self.root)), F.lit(os.path.abspath(self.reference)))
        if self.spark.range(1).select(inside).first()[0]:
            raise ValueError("the project must lie outside the reference")
        whole = written(self.objects().drop("error"))
        done = container.extracted(whole, self.root)
        kept = whole.join(done.select("container", "index", "file", "error"), ["container", "index"], "left").withColumn("error", F.coalesce(F.col("error"), "problem"))
        kept.select("container", "index", "storage_kind", "payload_type", "file", *IDENTITY, "error").write.parquet(self._table(OBJECTS))
        loose = self._files()[1]
        failed = _copied(loose, os.path.join(self.root, LOOSE)).where("error is not null").count()
        loose.select("path", "size", "sha256").write.parquet(self._table(LOOSE))
        return self.tallies().withColumn("failed", F.col("failed") + failed)

    def tallies(self) -> DataFrame:
        rows = self.spark.read.parquet(self._table(OBJECTS))
        loose = self.spark.read.parquet(self._table(LOOSE))
        sides = rows.select("container", F.lit(0).alias("loose"), F.lit(1).alias("object"), F.col("error").isNotNull().cast("int").alias("bad"))
        sides = sides.unionByName(loose.select(F.lit(None).cast("string").alias("container"), F.lit(1).alias("loose"), F.lit(0).alias("object"), F.lit(0).alias("bad")))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return sides.agg(F.countDistinct("container").alias("containers"), total("loose").alias("loose"), total("object").alias("objects"), total("bad").alias("failed"))

    def problems(self) -> DataFrame:
        """container, path, problem of a project whose own tables are not sound: names that differ only in case, files named twice, kinds that are unknown."""
        rows, loose = self.spark.read.parquet(self._table(OBJECTS)), self.spark.read.parquet(self._table(LOOSE))
        names = rows.select(F.col("container").alias("name")).distinct().unionByName(loose.select(F.col("path").alias("name")))
        twice = lambda df, key, text: df.groupBy(F.lower(key).alias("path")).count().where("count > 1").select(F.lit(None).cast("string").alias("container"), "path", F.lit(text).alias("problem"))
        kinds = rows.where("storage_kind not in ('tree', 'object')").select("container", "path", F.lit("unknown kind").alias("problem"))
        unsafe = loose.where(~paths.is_inside(F.col("path"))).select(F.lit(None).cast("string").alias("container"), "path", F.lit("path leaves the project").alias("problem"))
        return twice(names, "name", "source is named twice").unionByName(twice(rows.where("file is not null"), "file", "file is named twice")).unionByName(kinds).unionByName(unsafe)

    def _edits(self) -> DataFrame:
        """Extracted files that are not as they were: container, index, path, file, source, was, payload_type, what (null: the file is gone)."""
        rows = self.spark.read.parquet(self._table(OBJECTS)).where("file is not null and error is null")
        at = F.concat(F.lit(self.root + "/"), "file")
        asked = rows.select("container", "index", at.alias("location"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("long").alias("size"))
        seen = container.measured(asked)
        own = rows.select("container", "index", "path", "file", at.alias("source"), F.col("payload_sha256").alias("was"), "payload_type")
        return own.join(seen, ["container", "index"]).where(~F.col("what.sha256").eqNullSafe(F.col("was")))

    def validate(self, allow_png_dimension_change: bool = False, allow_type_change: bool = False) -> DataFrame:
        """container, path, problem, severity of everything that is wrong: the project's tables, a reference that is not the one
        of the project, edits that cannot stand for their originals, files that are gone; files too many only warn."""
        kept = self.spark.read.parquet(self._table(OBJECTS))
        now = written(self.objects())
        differs = states.identity_violations(kept.select("container", "index", *IDENTITY), now.select("container", "index", *IDENTITY), ["container", "index"], IDENTITY)
        error = F.lit("error").alias("severity")
        out = self.problems().select("container", "path", "problem", error)
        out = out.unionByName(differs.select("container", F.col("index").cast("string").alias("path"), F.concat(F.lit("reference: "), "problem").alias("problem"), error))
        edits = written(self._edits())
        before = now.join(edits.select("container", "index"), ["container", "index"], "left_semi").select("container", "index", "location", F.col("payload_offset").alias("offset"), F.col("payload_size").alias("size"), "class_declared")
        old = container.measured(before).withColumnRenamed("what", "old").join(before.select("container", "index", "class_declared"), ["container", "index"])
        both = edits.join(old, ["container", "index"])
        side = lambda c, allow: F.struct(F.col(f"{c}.size").alias("size"), (F.lit("any") if allow else formats.payload_type(F.col(f"{c}.sample"), F.col("class_declared"))).alias("payload_type"), F.when(F.lit(not allow_png_dimension_change), F.col(f"{c}.width")).alias("width"), F.when(F.lit(not allow_png_dimension_change), F.col(f"{c}.height")).alias("height"), F.col(f"{c}.trailing_bytes").alias("trailing_bytes"), F.col(f"{c}.sha256").alias("sha256"))
        failure = rules.payload_failure(side("old", allow_type_change), side("what", allow_type_change))
        out = out.unionByName(both.select("container", "path", failure.alias("problem"), error).where("problem is not null"))
        here = file_catalog(self.spark, self.root).where(F.col("path").rlike("/(tree|objects)/") & ~F.col("path").rlike(rf"^({LOOSE}|{OWN})/".replace(".", r"\."))).select("path")
        extra = here.join(kept.select(F.col("file").alias("path")), "path", "left_anti")
        return out.unionByName(extra.select(F.lit(None).cast("string").alias("container"), "path", F.lit("file is not in the project").alias("problem"), F.lit("warning").alias("severity")))

    def repack(self, folder: str, **allow: bool) -> DataFrame:
        """Rebuilds all containers with the project's edits and copies loose files, after ``validate``: container, target, size, objects, changed, error."""
        if os.path.exists(folder) and os.listdir(folder):
            raise FileExistsError(folder)
        for other in (self.root, self.reference):
            if self.spark.range(1).select(paths.overlap(F.lit(os.path.abspath(folder)), F.lit(os.path.abspath(other)))).first()[0]:
                raise ValueError("the output must lie outside the project and the reference")
        bad = self.validate(**allow).where("severity = 'error'").limit(5).collect()
        if bad:
            raise ValueError("; ".join(f"{r.container}/{r.path}: {r.problem}" for r in bad))
        edits = self._edits().select("container", "index", "source")
        done = written(container.rebuilt(self.objects().where("problem is null"), edits, folder))
        loose = self.spark.read.parquet(self._table(LOOSE)).select("path", F.concat(F.lit(os.path.join(self.root, LOOSE) + "/"), "path").alias("location"))
        copies = _copied(loose, folder).select(F.col("path").alias("container"), F.concat(F.lit(folder + "/"), "path").alias("target"), F.lit(None).cast("long").alias("size"), F.lit(0).cast("long").alias("objects"), F.lit(0).cast("long").alias("changed"), "error")
        return done.unionByName(copies)

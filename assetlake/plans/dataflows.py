"""Whole dataflows over the test tables: sessions, batches, packages, projects and the streamed catalog, run in the shared
folder on archives and containers made of ``documents``, with SQL over the table for what must come out."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import inventory, states
from ..sources import container, media, stack
from ..sources.catalog import file_catalog
from ..sources.cuts import written
from ..streaming import incremental
from .catalogue import query, table
from .containers import ContainerProject
from .rasters import RasterProject, encoded, saved
from .roundtrips import KEY, OBJECTS, _saved, archives, containers, documents, entries, laid, scratch, whole_pictures
from .session import CatalogSession

E = "e AS (SELECT source AS archive, doc_id, coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256, sha256(text || '!') AS edited, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"


def unpacked(spark: SparkSession, packs: str) -> CatalogSession:
    s = CatalogSession(spark, packs, scratch(spark), KEY)
    if not s.unpack().where("error is not null").isEmpty():
        raise RuntimeError("entries were not extracted")
    return s


def edited(spark: SparkSession, sf_dir: str, packs: str) -> CatalogSession:
    """A workspace in which every seventh entry is edited."""
    s = unpacked(spark, packs)
    rows = documents(spark, sf_dir).where("ordinal % 7 = 0").withColumn("file", F.concat_ws("/", "archive", "path"))
    _saved(rows.withColumn("content", F.concat("content", F.lit(b"!"))), s.workspace)
    return s


# ---- archives


@query(f"WITH {E} SELECT archive || '.gpk' AS path, row_number() OVER (ORDER BY lower(archive), archive) AS ordinal, count(*) AS entries FROM e GROUP BY archive")
def archive_scan(spark, sf_dir):
    """Archives in the order of their names, with the number of their entries."""
    folder = archives(spark, sf_dir)
    counted = entries(spark, folder).groupBy(F.col("archive").alias("path")).agg(F.count("*").alias("entries"))
    rows = file_catalog(spark, folder).where(F.lower("path").endswith(".gpk")).select("path")
    return inventory.numbered(rows).join(counted, "path").select("path", "ordinal", "entries")


@query(f"WITH {E} SELECT archive, 'PASS' AS status, count(*) AS entries, count(*) AS extracted, 0 AS failed, 'first' AS run FROM e GROUP BY 1 UNION ALL SELECT archive, 'SKIPPED_COMPLETE', count(*), 0, 0, 'again' FROM e GROUP BY 1")
def batch_extraction(spark, sf_dir):
    s = CatalogSession(spark, archives(spark, sf_dir), scratch(spark), KEY)
    runs = [written(s.unpack_all().withColumn("run", F.lit(name))) for name in ("first", "again")]
    return runs[0].unionByName(runs[1]).select("archive", "status", "entries", "extracted", "failed", "run")


@query(f"WITH {E} SELECT archive, path, CASE WHEN doc_id % 7 = 0 THEN 'modificado' ELSE 'original' END AS state, size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size FROM e UNION ALL SELECT archive, 'more/' || doc_id || '.txt', 'novo', 4 FROM e WHERE doc_id % 17 = 0")
def workspace_states(spark, sf_dir):
    s = edited(spark, sf_dir, archives(spark, sf_dir))
    more = documents(spark, sf_dir).where("ordinal % 17 = 0").withColumn("file", F.concat(F.col("archive"), F.lit("/more/"), F.col("ordinal").cast("string"), F.lit(".txt")))
    _saved(more.withColumn("content", F.lit(b"more")), s.workspace)
    return s.refresh().select("archive", "path", "state", "size")


@query(f"WITH {E} SELECT 'first' AS run, count_if(doc_id % 3 = 0) AS newly, 0 AS already, 0 AS restored, 0 AS failed FROM e UNION ALL SELECT 'again', 0, count_if(doc_id % 3 = 0 AND doc_id % 7 != 0), count_if(doc_id % 21 = 0), 0 FROM e")
def selective_extraction(spark, sf_dir):
    """Every third entry is extracted; of these every seventh is edited and restored by the second run."""
    s = CatalogSession(spark, archives(spark, sf_dir), scratch(spark), KEY)
    os.makedirs(s.workspace)
    chosen = documents(spark, sf_dir).where("ordinal % 3 = 0")
    runs = [("first", s.extract(chosen.select("archive", "path")))]
    rows = chosen.where("ordinal % 7 = 0").withColumn("file", F.concat_ws("/", "archive", "path"))
    _saved(rows.withColumn("content", F.lit(b"edited")), s.workspace)
    runs.append(("again", s.extract(chosen.select("archive", "path"), restore=True)))
    counts = [(name, *(out[k] for k in ("newly", "already", "restored", "failed"))) for name, out in runs]
    return spark.createDataFrame(counts, "run string, newly long, already long, restored long, failed long")


@query(f"WITH {E} SELECT archive || '.gpk' AS archive, path, CASE WHEN doc_id % 7 = 0 THEN edited ELSE sha256 END AS sha256 FROM e")
def batch_rebuild(spark, sf_dir):
    """The gate, then every archive with its edits; read back."""
    s, out = edited(spark, sf_dir, archives(spark, sf_dir)), scratch(spark)
    if not s.repack_all(out).where("status != 'PASS'").isEmpty():
        raise RuntimeError("archives were not rebuilt")
    return stack.payloads(entries(spark, out), with_content=False).select("archive", "path", "sha256")


# ---- packages


@query(f"WITH {E} SELECT 'installed' AS step, archive, path, CASE WHEN doc_id % 7 = 0 THEN edited ELSE sha256 END AS sha256 FROM e UNION ALL SELECT 'removed', archive, path, sha256 FROM e")
def package_cycle(spark, sf_dir):
    """A package of the edits of one workspace is installed in another and taken out again."""
    packs = archives(spark, sf_dir)
    package = os.path.join(scratch(spark), "edits.zip")
    os.makedirs(os.path.dirname(package))
    edited(spark, sf_dir, packs).package(package, {"id": "edits", "version": "1.0", "name": "Edits"})
    other, steps = unpacked(spark, packs), []
    for name, step in (("installed", lambda: other.install(package)), ("removed", other.uninstall)):
        step()
        steps.append(written(other.files().select(F.lit(name).alias("step"), "archive", "path", "sha256")))
    return steps[0].unionByName(steps[1])


# ---- projects of containers and rasters


@query(f"WITH {OBJECTS} SELECT container, CAST(20 + 15 + 16 + 4 + sum(16 + length(CAST(doc_id AS VARCHAR))) AS BIGINT) AS prefix FROM o GROUP BY 1")
def container_prefix(spark, sf_dir):
    """How many bytes of each container lie ahead of its first payload."""
    return laid(spark, containers(spark, sf_dir)).groupBy("container").agg(F.min("payload_offset").cast("long").alias("prefix"))


@query(f"WITH {OBJECTS} SELECT container, path, problem FROM (SELECT container, 'docs/' || doc_id AS path, 'differs' AS problem FROM o WHERE doc_id % 2 = 0)")
def container_identity(spark, sf_dir):
    """Places at which a rebuilt container is not the one it was built of."""
    plan, out = laid(spark, containers(spark, sf_dir)), scratch(spark)
    edits = plan.where("depth = 1").withColumn("id", paths.name(F.col("path"))).where(F.col("id").cast("long") % 2 == 0)
    rows = edits.select(F.col("container").alias("archive"), F.col("index").cast("string").alias("path"), F.concat_ws("/", "container", "id").alias("file"), F.concat(F.lit("in place of "), "id").cast("binary").alias("content"))
    made = _saved(rows, scratch(spark)).select(F.col("archive").alias("container"), F.col("path").cast("long").alias("index"), "source")
    container.rebuilt(plan, made, out).where("error is not null").count()
    sides = [container.typed(x).select("container", "index", "path", "depth", "flags", "payload_sha256") for x in (plan, laid(spark, out))]
    found = states.identity_violations(sides[0], sides[1], ["container", "index"], ["path", "depth", "flags", "payload_sha256"])
    return found.join(plan.select("container", "index", "path"), ["container", "index"]).select("container", "path", "problem")


@query(f"WITH {OBJECTS}, w AS (SELECT container, doc_id FROM o WHERE doc_id % 4 = 0) SELECT container, 'docs/' || doc_id AS path, 'payload type changed' AS problem, 'error' AS severity FROM w UNION ALL SELECT NULL, container || '/tree/docs/more' || doc_id, 'file is not in the project', 'warning' FROM w")
def container_project_check(spark, sf_dir):
    """A project in which some objects have become pictures, and files lie that are not its own."""
    project = ContainerProject(spark, containers(spark, sf_dir), scratch(spark))
    project.build()
    rows = documents(spark, sf_dir).where("ordinal % 5 = 1 and ordinal % 4 = 0").withColumn("content", F.lit(b"BM"))
    for prefix in ("docs/", "docs/more"):
        file = F.concat(F.col("archive"), F.lit(f".bin/tree/{prefix}"), F.col("ordinal").cast("string"))
        _saved(rows.withColumn("file", file), project.root)
    return project.validate()


@query(f"WITH {OBJECTS} SELECT count(DISTINCT container) AS containers, 0 AS loose, count(*) + count(DISTINCT container) AS objects, 0 AS failed FROM o")
def container_project_tallies(spark, sf_dir):
    return ContainerProject(spark, containers(spark, sf_dir), scratch(spark)).build()


@query("""SELECT doc_id || '.cmap' AS path, CASE WHEN doc_id % 30 = 0 THEN 'MODIFIED' WHEN doc_id % 20 = 0 THEN 'FAIL' ELSE 'UNCHANGED' END AS status, CASE WHEN doc_id % 30 != 0 AND doc_id % 20 = 0 THEN 'new region IDs: 193' END AS error FROM documents""")
def raster_project_build(spark, sf_dir):
    """Pictures of rasters turned about are edits, those with a region that the raster has not are refused. Below its
    picture a raster has a line of regions that no text holds (bytes that UTF-8 never has, as 193 is one), so that a
    picture of one pattern is another when that line comes first."""
    maps, root, out = scratch(spark), scratch(spark), scratch(spark)
    foot = F.unhex(F.lit("F8F9FAFBFCFDFEFF" * 8))
    own = written(whole_pictures(spark, sf_dir).withColumns({"height": F.col("height") + 1, "pixels": F.concat("pixels", foot)}))
    path = F.concat("name", F.lit(".cmap"))
    saved(own.select(path.alias("path"), encoded(F.col("width"), F.col("height"), F.col("pixels")).alias("content")), maps, ".cmap")
    project = RasterProject(spark, maps, root)
    project.export()
    k = F.col("name").cast("long")
    turned = F.concat(foot, F.expr("substring(pixels, 1, octet_length(pixels) - 64)"))
    foreign = F.concat(F.unhex(F.lit("C1")), F.expr("substring(pixels, 2)"))
    edits = own.where((k % 30 == 0) | (k % 20 == 0)).withColumn("pixels", F.when(k % 30 == 0, turned).otherwise(foreign))
    made = media.raster_to_png(edits).select(path.alias("path"), F.col("png").alias("content"))
    saved(made, os.path.join(root, "edit"), ".png")
    return project.build(out)


# ---- the streamed catalog


@query("""WITH s AS (SELECT source AS archive, doc_id, octet_length(encode(text)) AS size, 0 AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL
UNION ALL SELECT source, doc_id, octet_length(encode(text)) + k.n, k.n FROM documents, (SELECT unnest([1, 2, 3]) AS n) k WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id % (2 + k.n) = 0)
SELECT archive, CAST(doc_id AS VARCHAR) AS path, arg_max(size, n) AS size, max(n) AS scanned_at FROM s GROUP BY archive, doc_id""")
def incremental_catalog(spark, sf_dir):
    """Four scans, each a batch of the stream; every second batch makes a new base."""
    scans, state, checkpoint = (f"file://{scratch(spark)}" for _ in range(3))
    size = F.octet_length("text").cast("long")
    rows = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    for n in range(4):
        scan = rows.where(F.col("doc_id") % (2 + n) == 0) if n else rows
        scan = scan.select(F.col("source").alias("archive"), F.col("doc_id").cast("string").alias("path"), (size + n).alias("size"), F.lit(n).cast("long").alias("scanned_at"))
        scan.write.mode("append").parquet(scans)
        incremental.keep_catalog(spark, scans, scan.schema, state, checkpoint, every=2).awaitTermination()
    return incremental.current(spark, state)

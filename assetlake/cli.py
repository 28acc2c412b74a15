"""Commands: ``python -m assetlake.cli COMMAND ...``. Exit codes: 0 done, 1 a FAIL, 2 a refused request."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import inventory, probing, raster, states
from .plans.containers import ContainerProject
from .plans.rasters import RasterProject, palette_bytes, saved
from .plans.session import CatalogSession
from .sources import media, packages, stack
from .sources.catalog import file_catalog

COMMANDS: dict[str, tuple[list[str], Callable]] = {}


def command(*arguments: str) -> Callable:
    """Arguments end in ? if they are optional."""

    def add(f: Callable) -> Callable:
        COMMANDS[f.__name__.replace("_", "-")] = (list(arguments), f)
        return f

    return add


def session(spark: SparkSession, a: argparse.Namespace) -> CatalogSession:
    return CatalogSession(spark, a.packs, getattr(a, "workspace", None), bytes.fromhex(a.key) if a.key else None)


def shown(df: DataFrame, a: argparse.Namespace) -> int:
    """Writes rows to --output as JSON lines, or prints the first of them. FAIL rows make the exit code."""
    if a.output:
        df.write.json(a.output)
        df = df.sparkSession.read.schema(df.schema).json(a.output)
    else:
        df.show(a.rows, truncate=False)
    bad = [c for c in ("error", "failure", "problem") if c in df.columns]
    failing = F.lit(False)
    for c in bad:
        failing = failing | F.col(c).isNotNull()
    if "status" in df.columns:
        failing = failing | F.col("status").isin("FAIL", "FAILED")
    return 1 if not df.where(failing).isEmpty() else 0


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    return file_catalog(spark, folder, content=True).select("path", "content")


def rasters(spark: SparkSession, folder: str) -> DataFrame:
    return raster.decoded(pictures(spark, folder).where(F.lower("path").endswith(".cmap"))).withColumnRenamed("path", "name")


@command("packs")
def inspect(spark, a):
    return shown(session(spark, a).archives(digest=True).drop("location", "footer"), a)


@command("packs", "workspace")
def scan_assets(spark, a):
    return shown(session(spark, a).assets(), a)


@command("packs", "workspace")
def summarize_assets(spark, a):
    return shown(session(spark, a).summary(), a)


@command("packs", "workspace")
def unknown_assets(spark, a):
    return shown(session(spark, a).assets().where("detected_format = 'UNKNOWN'"), a)


@command("packs")
def read_index(spark, a):
    return shown(session(spark, a).index().drop("header", "trailer", "location"), a)


@command("packs")
def verify(spark, a):
    return shown(stack.payloads(session(spark, a).index(), with_content=False).drop("content"), a)


@command("packs", "workspace")
def unpack_all(spark, a):
    return shown(session(spark, a).unpack(), a)


@command("packs", "workspace", "folder")
def repack_all(spark, a):
    return shown(session(spark, a).repack(a.folder, None, a.mode, a.allow_unknown), a)


@command("packs", "workspace")
def refresh(spark, a):
    return shown(session(spark, a).refresh(), a)


@command("packs", "workspace", "baseline")
def asset_baseline(spark, a):
    session(spark, a).baseline().write.parquet(a.baseline)
    return shown(spark.read.parquet(a.baseline), a)


@command("packs", "workspace", "baseline")
def asset_validate(spark, a):
    rows = session(spark, a).validate(spark.read.parquet(a.baseline), a.allow_unknown)
    states.validation_counts(rows).show(truncate=False)
    return shown(rows.where("status != 'UNCHANGED'"), a)


@command("left", "right")
def compare(spark, a):
    sides = [file_catalog(spark, f, content=True).select("path", F.col("content").alias(n)) for f, n in ((a.left, "left"), (a.right, "right"))]
    both = sides[0].join(sides[1], "path", "full_outer")
    empty = F.to_binary(F.lit(""), F.lit("hex"))
    both = both.select("path", F.coalesce("left", empty).alias("left"), F.coalesce("right", empty).alias("right"))
    return shown(probing.first_difference(both).select("path", "identical", "first_difference"), a)


@command("folder")
def verify_cmap(spark, a):
    rows = rasters(spark, a.folder)
    raster.summary(raster.histogram(raster.pixels(rows))).show(a.rows, truncate=False)
    return shown(rows.select("name", "width", "height", "error"), a)


@command("folder", "target")
def cmap_to_png(spark, a):
    return _files(media.raster_to_png(rasters(spark, a.folder)), "png", ".png", a)


@command("folder", "target")
def cmap_to_color(spark, a):
    table = b"".join(bytes([r.red, r.green, r.blue]) for r in raster.palette(spark).orderBy("id").collect())  # 256 rows
    return _files(media.raster_to_png(rasters(spark, a.folder), table), "png", ".png", a)


@command("folder", "target")
def png_to_cmap(spark, a):
    rows = media.png_to_raster(pictures(spark, a.folder).where(F.lower("path").endswith(".png")))
    little = lambda c: F.to_binary(F.concat(*[F.substring(F.lpad(F.hex(c), 8, "0"), k, 2) for k in (7, 5, 3, 1)]), F.lit("hex"))
    return _files(rows.where("error is null").select("name", F.concat(little("width"), little("height"), "pixels").alias("cmap")), "cmap", ".cmap", a)


def _files(rows: DataFrame, column: str, suffix: str, a: argparse.Namespace) -> int:
    """Writes one new file for each row."""
    import os

    from .sources.arrow import flat_map

    folder = a.target

    def write(name: str, data: bytes):
        path = os.path.join(folder, os.path.splitext(name)[0] + suffix)
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.{os.getpid()}.part", "wb") as f:
                f.write(data)
            stack.publish(f.name, path)
            yield name, path, None
        except OSError as e:
            yield name, path, str(e)

    return shown(flat_map(rows.select("name", column), write, "name string, path string, error string"), a)


@command("packs", "workspace", "package", "identity", "version")
def mod_build(spark, a):
    digest = session(spark, a).package(a.package, {"id": a.identity, "version": a.version, "name": a.identity}, None, a.mode, a.allow_unknown)
    print(digest)
    return 0


@command("package")
def mod_inspect(spark, a):
    row = spark.createDataFrame([(a.package, a.package)], "path string, location string")
    packages.manifests(row).show(a.rows, truncate=False)
    return shown(packages.inspected(row), a)


@command("packs", "workspace", "package")
def mod_apply(spark, a):
    print(*session(spark, a).install(a.package), sep="\n")
    return 0


@command("packs", "workspace")
def mod_remove(spark, a):
    print(*session(spark, a).uninstall(), sep="\n")
    return 0


@command("folder")
def containers(spark, a):
    return shown(CatalogSession(spark, a.folder).objects(), a)


@command("packs", "workspace")
def duplicates(spark, a):
    rows = inventory.numbered(session(spark, a).assets())
    return shown(inventory.duplicates(rows, F.lower("path")), a)


@command("packs", "workspace")
def unpack_report(spark, a):
    return shown(session(spark, a).unpack_all(), a)


@command("packs", "workspace", "folder")
def repack_report(spark, a):
    return shown(session(spark, a).repack_all(a.folder, a.mode, a.allow_unknown), a)


@command("packs", "workspace", "archive", "path")
def extract(spark, a):
    """One entry, or with a path that ends in a slash a folder."""
    s = session(spark, a)
    one = spark.createDataFrame([(a.archive, a.path)], "archive string, path string")
    out = s.extract(folders=[(a.archive, a.path)]) if a.path.endswith("/") else s.extract(one)
    print(out)
    return 1 if out["failed"] else 0


@command("packs", "workspace")
def asset_preflight(spark, a):
    s = session(spark, a)
    s.preflight(None, a.mode, a.allow_unknown)
    print(s.last_validation.asDict())
    return 0


@command("folder", "pictures", "project")
def cmap_project_export(spark, a):
    return shown(RasterProject(spark, a.folder, a.project).export(a.pictures), a)


@command("project", "target")
def cmap_project_build(spark, a):
    return shown(RasterProject(spark, "", a.project).build(a.target), a)


@command("folder", "target")
def color_to_cmap(spark, a):
    """Pictures in the palette's colours back to region rasters."""
    return shown(saved(media.colours_to_raster(pictures(spark, a.folder).where(F.lower("path").endswith(".png")), palette_bytes(spark)), a.target, ".cmap"), a)


@command("folder", "project")
def container_build(spark, a):
    return shown(ContainerProject(spark, a.folder, a.project).build(), a)


@command("folder", "project")
def container_validate(spark, a):
    rows = ContainerProject(spark, a.folder, a.project).validate()
    return shown(rows, a) if not rows.where("severity = 'error'").isEmpty() else 0


@command("folder", "project", "target")
def container_repack(spark, a):
    return shown(ContainerProject(spark, a.folder, a.project).repack(a.target), a)


@command("folder")
def find_key(spark, a):
    """Which of the keys in use each file holds, and where."""
    return shown(probing.find_bytes(pictures(spark, a.folder), stack.KEYS), a)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="assetlake", description=__doc__)
    subs = parser.add_subparsers(dest="command", required=True)
    for name, (wanted, _) in COMMANDS.items():
        sub = subs.add_parser(name)
        for w in wanted:
            sub.add_argument(w)
        sub.add_argument("--key", help="archive key in hex")
        sub.add_argument("--output", help="write rows there as JSON lines")
        sub.add_argument("--rows", type=int, default=50)
        sub.add_argument("--allow-unknown", action="store_true")
        sub.add_argument("--mode", choices=("strict", "experimental"), default="strict")
    a = parser.parse_args(arguments)
    try:
        return COMMANDS[a.command][1](spark or SparkSession.builder.getOrCreate(), a)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

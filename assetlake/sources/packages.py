"""Packages: ZIP files with a manifest and the files that it names.

Listing and digests are rows, one task a member; building, applying and removing are plans, DataFrames that say
for every file what is to be done or which check fails, and a commit that runs only where no check does.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..functions import paths
from ..operators import rules
from .arrow import flat_map, spread
from .catalog import digest
from .cuts import written

BLOCK = 1 << 20
#: Bytes of the longest file that is packed as one row.
MOST_PACKED = 1 << 25
MOST_MANIFEST = 1 << 20
#: Bytes that a manifest may have for each member of its package, beyond MOST_MANIFEST.
MEMBER_MANIFEST = 1 << 14
#: The manifest's name, where files lie, and extensions that are stored as they are.
MANIFEST, FILES = "mod.json", "files/"
STORED = (".png", ".ogg", ".wmv", ".zip", ".jpg")
FILE = "struct<archive:string,path:string,member:string,size_bytes:long,original_sha256:string,modified_sha256:string>"


def members(packages: DataFrame) -> DataFrame:
    """package, member, size, sha256, error of every member of packages (path, location)."""

    def names(path: str, location: str) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(location) as z:
                for n, i in enumerate(z.infolist()):
                    if not i.is_dir():
                        yield path, location, n, i.filename, i.file_size, None
        except (OSError, zipfile.BadZipFile) as e:
            yield path, location, None, None, None, str(e)

    held: dict[str, zipfile.ZipFile] = {}  # each task has its own

    def hashed(path: str, location: str, member: str, size: int, error: str) -> Iterator[tuple]:
        if error:
            yield path, member, size, None, error
            return
        h = hashlib.sha256()
        try:
            with _held(held, location).open(member) as f:
                while block := f.read(BLOCK):
                    h.update(block)
            yield path, member, size, h.hexdigest(), None
        except (OSError, zipfile.BadZipFile) as e:
            yield path, member, size, None, str(e)

    listed = flat_map(packages.select("path", "location"), names, "path string, location string, place long, member string, size long, error string")
    dealt = spread(listed, "location", "place").sortWithinPartitions("location", "place")
    return flat_map(dealt.drop("place"), hashed, "package string, member string, size long, sha256 string, error string")


def _held(held: dict[str, zipfile.ZipFile], location: str) -> zipfile.ZipFile:
    """The package that a task has open: its list of members is read once, not once a member."""
    if location not in held:
        while held:
            held.popitem()[1].close()
        held[location] = zipfile.ZipFile(location)
    return held[location]


def manifests(packages: DataFrame) -> DataFrame:
    """package, id, version, name, files (exploded: archive, path, member, size_bytes, original_sha256, modified_sha256)."""

    def read(path: str, location: str) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(location) as z:
                if z.getinfo(MANIFEST).file_size > MOST_MANIFEST + MEMBER_MANIFEST * len(z.infolist()):
                    raise ValueError("the manifest is too large")
                yield path, z.read(MANIFEST).decode("utf-8"), None
        except (OSError, KeyError, ValueError, zipfile.BadZipFile) as e:
            yield path, None, str(e)

    text = flat_map(packages.select("path", "location"), read, "package string, text string, error string")
    parsed = F.from_json("text", f"id string, version string, name string, files array<{FILE}>").alias("m")
    return text.select("package", parsed, "error").select("package", "m.id", "m.version", "m.name", F.explode_outer("m.files").alias("f"), "error").select("package", "id", "version", "name", "f.*", "error")


def inspected(packages: DataFrame) -> DataFrame:
    """package, problem of every package: none for a sound one. Members against the manifest, sizes and digests."""
    found, told = written(members(packages)), written(manifests(packages))
    m = told.where("error is null and member is not null").select("package", "member", "size_bytes", "modified_sha256")
    f = found.where("error is null").where(F.col("member") != MANIFEST)
    both = m.join(f.select("package", "member", "size", "sha256", F.lit(True).alias("there")), ["package", "member"], "full_outer")
    problem = (
        F.when(F.col("there").isNull(), F.concat(F.lit("missing: "), "member")).when(F.col("size_bytes").isNull(), F.concat(F.lit("extra: "), "member"))
        .when(F.col("size") != F.col("size_bytes"), F.concat(F.lit("size differs: "), "member")).when(F.col("sha256") != F.col("modified_sha256"), F.concat(F.lit("digest differs: "), "member"))
    )
    errors = found.where("error is not null").select("package", F.col("error").alias("problem")).unionByName(told.where("error is not null").select("package", F.col("error").alias("problem")))
    return both.select("package", problem.alias("problem")).where("problem is not null").unionByName(errors).distinct()


def edited(recorded: DataFrame, workspace: DataFrame) -> DataFrame:
    """Files of a package: what the workspace has changed. archive, path, member, size_bytes, original_sha256, modified_sha256, location."""
    w = workspace.select("archive", "path", "size", "sha256", "location")
    out = recorded.where(F.coalesce("extracted", F.lit(True))).select("archive", "path", "extracted_sha256").join(w, ["archive", "path"]).where("sha256 != extracted_sha256")
    member = F.concat(F.lit(FILES), "archive", F.lit("/"), "path")
    return out.select("archive", "path", member.alias("member"), F.col("size").alias("size_bytes"), F.col("extracted_sha256").alias("original_sha256"), F.col("sha256").alias("modified_sha256"), "location")


def totals(files: DataFrame) -> DataFrame:
    """archive, files, bytes of a package's rows, and one row for all of them, whose archive is null."""
    return files.rollup("archive").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))


def plan_digest(files: DataFrame) -> str:
    """A digest of what a package is to hold, whatever the order of its rows: of 4,096 groups of rows, then of the groups."""
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("archive", "path", "member", "size_bytes", "original_sha256", "modified_sha256")]), 256)
    rows = files.select(line.alias("line")).withColumn("group", F.substring("line", 1, 3))
    fold = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    return rows.groupBy("group").agg(fold("line").alias("line")).agg(fold("line").alias("line")).first().line


def refused(files: DataFrame, identity: dict) -> list[str]:
    """What keeps a package from being built or installed: its identity, and the rules of ``rules.manifest_violations``."""
    named = files.sparkSession.range(1).select(
        F.when(~F.coalesce(paths.is_identity(F.lit(identity.get("id"))), F.lit(False)), "the id is not valid").alias("a"), F.when(~F.coalesce(paths.is_version(F.lit(identity.get("version"))), F.lit(False)), "the version is not valid").alias("b"),
        F.when(F.trim(F.coalesce(F.lit(identity.get("name")), F.lit(""))) == "", "the name is empty").alias("c"),
    ).first()
    broken = rules.manifest_violations(files, files.select(F.col("archive").alias("name"))).collect()  # one row a rule
    return [x for x in named if x] + [f"{r.rule}: {r.n} files" for r in broken]


def _kind(path: str) -> int:
    return zipfile.ZIP_STORED if path.lower().endswith(STORED) else zipfile.ZIP_DEFLATED


def _packed(rows: DataFrame) -> DataFrame:
    """Adds packed, crc, packed_sha256: files of no more than MOST_PACKED bytes as they will lie in the ZIP, deflated where
    their rows are; longer ones, and those whose size has changed, are left to the writer, which streams them."""
    names = rows.columns
    kind = StructType([*rows.schema.fields, StructField("packed", BinaryType()), StructField("crc", LongType()), StructField("packed_sha256", StringType())])

    def pack(*row) -> Iterator[tuple]:
        r = dict(zip(names, row, strict=True))
        if r["size_bytes"] > MOST_PACKED or os.path.getsize(r["location"]) != r["size_bytes"]:
            yield (*row, None, None, None)
            return
        with open(r["location"], "rb") as f:
            data = f.read()
        packed = data
        if _kind(r["path"]) == zipfile.ZIP_DEFLATED:
            z = zlib.compressobj(wbits=-zlib.MAX_WBITS)
            packed = z.compress(data) + z.flush()
        yield (*row, packed, zlib.crc32(data), hashlib.sha256(data).hexdigest())

    return flat_map(spread(rows, "archive", "path"), pack, kind, block=16)


def _placed(z: zipfile.ZipFile, info: zipfile.ZipInfo, packed: bytes, crc: int, size: int) -> None:
    """Puts a member whose bytes are ready at the end of a ZIP that is being written."""
    z.fp.seek(z.start_dir)
    info.header_offset, info.CRC, info.compress_size, info.file_size = z.fp.tell(), crc, len(packed), size
    z.fp.write(info.FileHeader())
    z.fp.write(packed)
    z.start_dir = z.fp.tell()
    z.filelist.append(info)
    z.NameToInfo[info.filename] = info


def _streamed(z: zipfile.ZipFile, info: zipfile.ZipInfo, location: str) -> str:
    """Packs a file of any length block by block, and returns its digest."""
    h = hashlib.sha256()
    with open(location, "rb") as src, z.open(info, "w", force_zip64=True) as dst:
        while block := src.read(BLOCK):
            h.update(block)
            dst.write(block)
    return h.hexdigest()


def build(files: DataFrame, target: str, identity: dict, expected: str | None = None) -> str:
    """Writes a package and returns its plan's digest. Files are read and deflated by all tasks; one task puts them one after
    another, as a ZIP must be.

    expected: the digest of a plan that was looked at before; a plan that has changed since is not written. The task
    writes under a name of its own; the driver gives the whole file its name.
    """
    rows = written(files.select("archive", "path", "member", "size_bytes", "original_sha256", "modified_sha256", "location"))
    if rows.isEmpty():
        raise ValueError("nothing has changed")
    digest = plan_digest(rows)
    if expected is not None and digest != expected:
        raise ValueError("the workspace has changed since the plan was made")
    if problems := refused(rows, identity):
        raise ValueError("; ".join(problems))
    if os.path.exists(target):
        raise FileExistsError(target)

    head = json.dumps({**{k: v for k, v in identity.items() if k != "files"}, "files": []}, ensure_ascii=False)[:-2]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, error = f"{target}.{TaskContext.get().taskAttemptId()}.part", 0, None
        with zipfile.ZipFile(part, "w") as z, tempfile.TemporaryFile() as told:
            told.write(head.encode())
            for batch in batches:
                for r in batch.to_pylist():
                    location, packed, crc, sha = (r.pop(k) for k in ("location", "packed", "crc", "packed_sha256"))
                    info = zipfile.ZipInfo(r["member"])  # dated 1980, so that equal contents give equal packages
                    info.compress_type = _kind(r["path"])
                    if packed is None:
                        sha = _streamed(z, info, location)
                    else:
                        _placed(z, info, packed, crc, r["size_bytes"])
                    if sha != r["modified_sha256"]:
                        error = error or f"{r['path']} changed while it was packed"
                    told.write((",\n" if n else "\n").encode() + json.dumps(r, ensure_ascii=False).encode())
                    n += 1
            told.write(b"]}")
            told.seek(0)
            info = zipfile.ZipInfo(MANIFEST)
            info.compress_type = zipfile.ZIP_DEFLATED
            with z.open(info, "w", force_zip64=True) as dst:
                shutil.copyfileobj(told, dst, BLOCK)
        yield pa.record_batch([pa.array([part]), pa.array([error], pa.string())], names=["part", "error"])

    ordered = _packed(rows).repartition(1).sortWithinPartitions(F.lower("archive"), F.lower("path"), "path")
    done = ordered.mapInArrow(write, "part string, error string").first()
    if done.error:
        os.remove(done.part)
        raise ValueError(done.error)
    os.replace(done.part, target)
    return digest


def _each(rows: DataFrame, work: Callable[..., None]) -> DataFrame:
    """Runs work on each row, in its task: target, error; written, so that it is done once."""

    def run(*row) -> Iterator[tuple]:
        try:
            work(*row)
            yield row[0], None
        except (OSError, KeyError, ValueError, zipfile.BadZipFile) as e:
            yield row[0], str(e)

    return written(flat_map(spread(rows, "target"), run, "target string, error string"))


def _copied(source: str, target: str) -> None:
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{TaskContext.get().taskAttemptId()}.part"
    shutil.copyfile(source, part)
    os.replace(part, target)


def _moved(source: str, target: str) -> None:
    """A file goes to another place of its disk without being read; of a link the content is copied."""
    if os.path.islink(source):
        _copied(source, target)
        return
    os.makedirs(os.path.dirname(target), exist_ok=True)
    os.rename(source, target)


def apply(package: str, manifest: DataFrame, plan: DataFrame, workspace: str, backups: str) -> list[str]:
    """Puts a package's files into a workspace, if every check of the plan (``states.apply_plan``) holds.

    Tasks stage the new files beside the originals; only when all are there and whole do originals move to their backups and
    the new files take their places. If anything fails, what was done is undone. Returns the paths.
    """
    failed = plan.where("failure is not null").select("path", "failure").limit(5).collect()
    if failed:
        raise ValueError("; ".join(f"{r.path}: {r.failure}" for r in failed))
    at = lambda root: F.concat_ws("/", F.lit(root), "archive", "path")
    rows = written(manifest.select(at(workspace).alias("target"), at(backups).alias("backup"), "member", "modified_sha256"))

    held: dict[str, zipfile.ZipFile] = {}  # each task has its own

    def stage(target: str, member: str, digest_: str) -> None:
        h, part = hashlib.sha256(), f"{target}.{TaskContext.get().taskAttemptId()}.part"
        with _held(held, package).open(member) as src, open(part, "wb") as dst:
            while block := src.read(BLOCK):
                h.update(block)
                dst.write(block)
        if h.hexdigest() != digest_:
            os.remove(part)
            raise ValueError("the package is damaged")
        os.replace(part, f"{target}.staged")

    def publish(target: str, backup: str, digest_: str) -> None:
        if os.path.exists(f"{target}.staged"):
            if not os.path.exists(backup):
                _moved(target, backup)
            os.replace(f"{target}.staged", target)
        elif digest(target) != digest_:
            raise ValueError("the staged file is gone")

    def undo(target: str, backup: str) -> None:
        if os.path.exists(f"{target}.staged"):
            os.remove(f"{target}.staged")
        if os.path.exists(backup):
            _copied(backup, target)

    done = _each(rows.select("target", "member", "modified_sha256"), stage)
    if done.where("error is not null").isEmpty():
        done = _each(rows.select("target", "backup", "modified_sha256"), publish)
    bad = done.where("error is not null").limit(5).collect()
    if bad:
        _each(rows.select("target", "backup"), undo)
        raise ValueError("; ".join(f"{r.target}: {r.error}" for r in bad))
    return sorted(r.target for r in rows.select("target").collect())  # names


def remove(plan: DataFrame, workspace: str, backups: str) -> list[str]:
    """Restores the originals of an installed package in tasks, if the plan (``states.remove_plan``) has no conflict."""
    plan = written(plan)  # files are digested once
    bad = plan.where("conflict is not null").select("path", "conflict").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.path}: {r.conflict}" for r in bad))
    at = lambda root: F.concat_ws("/", F.lit(root), "archive", "path")
    rows = written(plan.where("needs_restore").select(at(workspace).alias("target"), at(backups).alias("backup")))
    failed = _each(rows, lambda target, backup: _copied(backup, target)).where("error is not null").limit(5).collect()
    if failed:
        raise OSError("; ".join(f"{r.target}: {r.error}" for r in failed))
    return sorted(r.target for r in rows.select("target").collect())  # names

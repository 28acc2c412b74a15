"""Sources and sinks over the test tables: archives, containers, packages and media are made of ``documents`` in the shared
folder, read back, and held against SQL over the table they were made of."""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, paths
from ..operators import raster, rules
from ..sources import container, media, packages, stack
from ..sources.arrow import flat_map
from ..sources.catalog import file_catalog
from ..sources.cuts import forget_later, shared_dir, written
from ..sources.stack_new import created
from .catalogue import query, table

KEY = b"a key of 17 bytes"
ASCII = "octet_length(encode(text)) = length(text) AND length(text) >= 64"


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, as a path that tasks open."""
    root = shared_dir(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError("archives are files: the shared folder must be mounted")
    path = os.path.join(root.removeprefix("file://"), f"made-{uuid.uuid4().hex}")
    forget_later(f"file://{path}")
    return path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    return d.select(F.col("source").alias("archive"), F.col("doc_id").alias("ordinal"), F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), (F.col("doc_id") % 3 != 0).alias("packed"))


def archives(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch(spark)
    failed = created(documents(spark, sf_dir), folder, KEY).where("error is not null").count()
    if failed:
        raise RuntimeError(f"{failed} archives were not written")
    return folder


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return stack.stack_index(file_catalog(spark, folder, partition=1 << 15).where(F.col("path").endswith(".gpk")), KEY)


DOCS = "d AS (SELECT source || '.gpk' AS archive, doc_id, coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"


@query(f"WITH {DOCS} SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY doc_id) AS ordinal, path, CASE WHEN doc_id % 3 != 0 AND size > 0 THEN size ELSE 0 END AS unpacked_size, 'given' AS key_name FROM d")
def archive_index_read(spark, sf_dir):
    return entries(spark, archives(spark, sf_dir)).select("archive", "ordinal", "path", "unpacked_size", "key_name")


@query(f"WITH {DOCS} SELECT archive, path, size AS content_size, sha256 FROM d")
def archive_payloads_verified(spark, sf_dir):
    return stack.payloads(entries(spark, archives(spark, sf_dir)), with_content=False).where("error is null").select("archive", "path", "content_size", "sha256")


@query("SELECT source || '.gpk' AS archive, true AS valid, 'STKFile0PIDX' AS index_signature FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source")
def archive_footers(spark, sf_dir):
    f = formats.footer(F.col("footer"), F.col("size"))
    return file_catalog(spark, archives(spark, sf_dir)).select(F.col("path").alias("archive"), f.alias("f")).select("archive", "f.valid", "f.index_signature")


@query(f"WITH {DOCS} SELECT replace(archive, '.gpk', '') || '/' || path AS path, size, sha256 FROM d")
def archive_extraction(spark, sf_dir):
    target = scratch(spark)
    failed = stack.extracted(entries(spark, archives(spark, sf_dir)), target).where("error is not null").count()
    if failed:
        raise RuntimeError(f"{failed} entries were not extracted")
    return file_catalog(spark, target, digest=True).select("path", "size", "sha256")


@query(f"WITH {DOCS} SELECT archive, path, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256 END AS sha256 FROM d")
def archive_rebuild(spark, sf_dir):
    """Every seventh entry is replaced by a longer file."""
    folder, ws, out = archives(spark, sf_dir), scratch(spark), scratch(spark)
    index = entries(spark, folder)
    edits = documents(spark, sf_dir).where("ordinal % 7 = 0").select(F.concat("archive", F.lit(".gpk")).alias("archive"), "path", F.concat("content", F.lit(b"!")).alias("content"))
    made = _saved(edits.withColumn("file", F.concat_ws("/", "archive", "path")), ws)
    stack.rebuilt(index, made.select("archive", "path", "source"), out).where("error is not null").count()
    return stack.payloads(entries(spark, out), with_content=False).select("archive", "path", "sha256")


def _saved(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``content`` of rows (archive, path, file, content) and adds source."""

    def write(archive: str, path: str, file: str, content: bytes) -> Iterator[tuple]:
        target = os.path.join(folder, file)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(f"{target}.{os.getpid()}.part", "wb") as f:
            f.write(content)
        os.replace(f.name, target)
        yield archive, path, target

    return written(flat_map(rows.select("archive", "path", "file", "content"), write, "archive string, path string, source string"))


# ---- containers: a folder for each language, an object for each document


def containers(spark: SparkSession, sf_dir: str) -> str:
    """One container a source: a folder object with no payload of its own, then its documents in order."""
    folder = scratch(spark)
    d = documents(spark, sf_dir).where("ordinal % 5 = 1")
    grouped = d.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("rows"))  # a fifth of a test table

    def write(archive: str, rows: list) -> Iterator[tuple]:
        names = [b"docs", *(str(r["ordinal"]).encode() for r in rows)]
        blobs = [b"", *(r["content"] for r in rows)]
        start = 20 + sum(1 + len(n) + 3 + 2 + 10 for n in names) + 15
        out, at = [bytes.fromhex(formats.CONTAINER), struct.pack("<H", 1)], start
        for k, (name, blob) in enumerate(zip(names, blobs, strict=True)):
            n = len(blob)
            size = (0xE7B5D9F8 + (((n << 13) | (n >> 19)) & 0xFFFFFFFF) + (n & 0xFFF)) & 0xFFFFFFFF
            kind = struct.pack("<HHH", 0xFFFF, 1, 11) + b"CAutoFolder" if k == 0 else struct.pack("<H", 0)
            out.append(bytes([len(name)]) + name + b"\x08\xc0\x00" + kind + struct.pack("<IIH", (at + 0xA2FB6AD1) & 0xFFFFFFFF, size, len(rows) if k == 0 else 0))
            at += n
        os.makedirs(folder, exist_ok=True)
        target = os.path.join(folder, f"{archive}.bin")
        with open(f"{target}.{os.getpid()}.part", "wb") as f:
            f.write(b"".join(out + blobs))
        os.replace(f.name, target)
        yield (target,)

    flat_map(grouped, write, "path string", block=1).count()
    return folder


def laid(spark: SparkSession, folder: str) -> DataFrame:
    return container.laid_out(container.objects(file_catalog(spark, folder)))


OBJECTS = "o AS (SELECT source || '.bin' AS container, doc_id, octet_length(encode(text)) AS size, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id % 5 = 1)"


@query(f"WITH {OBJECTS} SELECT container, 'docs/' || doc_id AS path, row_number() OVER (PARTITION BY container ORDER BY doc_id) AS index, 0 AS parent_index, 1 AS depth, size AS payload_size, CAST(NULL AS VARCHAR) AS problem FROM o UNION ALL SELECT DISTINCT container, 'docs', 0, NULL, 0, 0, NULL FROM o")
def container_objects(spark, sf_dir):
    return laid(spark, containers(spark, sf_dir)).select("container", "path", "index", "parent_index", "depth", "payload_size", "problem")


@query(f"WITH {OBJECTS} SELECT container, 'docs/' || doc_id AS path, CASE WHEN starts_with(text, 'BM') THEN 'BMP' ELSE 'UNKNOWN' END AS payload_type, sha256(text) AS payload_sha256, 'tree' AS storage_kind FROM o UNION ALL SELECT DISTINCT container, 'docs', 'FOLDER', sha256(''), 'object' FROM o")
def container_payload_types(spark, sf_dir):
    return container.tree_paths(container.typed(laid(spark, containers(spark, sf_dir)))).select("container", "path", "payload_type", "payload_sha256", "storage_kind")


@query(f"WITH {OBJECTS} SELECT container, 'docs/' || doc_id AS path, sha256(CASE WHEN doc_id % 2 = 0 THEN 'in place of ' || doc_id ELSE text END) AS payload_sha256 FROM o UNION ALL SELECT DISTINCT container, 'docs', sha256('') FROM o")
def container_rebuild(spark, sf_dir):
    plan, out = laid(spark, containers(spark, sf_dir)), scratch(spark)
    edits = plan.where("depth = 1").withColumn("id", paths.name(F.col("path"))).where(F.col("id").cast("long") % 2 == 0)
    rows = edits.select(F.col("container").alias("archive"), F.col("index").cast("string").alias("path"), F.concat_ws("/", "container", "id").alias("file"), F.concat(F.lit("in place of "), "id").cast("binary").alias("content"))
    made = _saved(rows, scratch(spark)).select(F.col("archive").alias("container"), F.col("path").cast("long").alias("index"), "source")
    container.rebuilt(plan, made, out).where("error is not null").count()
    return container.typed(laid(spark, out)).select("container", "path", "payload_sha256")


# ---- media: pictures, rasters, sound, film and text made of ids and first letters


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and an 8 x 8 picture whose samples are the first 64 bytes of the text."""
    d = table(spark, sf_dir, "documents").where(F.expr("octet_length(text) = length(text) and length(text) >= 64"))
    return d.select(F.col("doc_id").cast("string").alias("name"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.substring(F.col("text").cast("binary"), 1, 64).alias("pixels"))


def whole_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a picture of every text, one without text too: all its bytes in lines of 64, the last one filled with spaces."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    lines = F.greatest(F.ceil(F.octet_length(text) / 64), F.lit(1))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), lines.alias("height"), text.alias("text"))
    return rows.select("name", F.lit(64).alias("width"), "height", F.expr("rpad(text, cast(64 * height as int), X'20')").alias("pixels"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS name, 8 AS width, 8 AS height, sha256(substr(text, 1, 64)) AS pixels_sha256 FROM documents WHERE {ASCII}")
def png_round_trip(spark, sf_dir):
    made = media.raster_to_png(pictures(spark, sf_dir)).select(F.col("name").alias("path"), F.col("png").alias("content"))
    return media.png_to_raster(made).where("error is null").select("name", "width", "height", F.sha2("pixels", 256).alias("pixels_sha256"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 8 END AS width, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 8 END AS bit_depth, doc_id % 4 = 0 AS damaged FROM documents WHERE {ASCII}")
def png_properties(spark, sf_dir):
    """Every fourth picture has lost its last byte."""
    made = media.raster_to_png(pictures(spark, sf_dir))
    cut = F.when(F.col("name").cast("long") % 4 == 0, F.expr("substring(png, 1, octet_length(png) - 1)")).otherwise(F.col("png"))
    out = media.png_checked(made.select(F.col("name").alias("path"), cut.alias("content")))
    return out.select("path", "width", "bit_depth", F.col("error").isNotNull().alias("damaged"))


@query(f"WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS name, ascii(unnest(string_split(substr(text, 1, 64), ''))) AS v FROM documents WHERE {ASCII}) SELECT name, min(v) AS min_value, max(v) AS max_value, count(DISTINCT v) AS distinct_values FROM c GROUP BY name")
def raster_files(spark, sf_dir):
    content = F.concat(F.unhex(F.lit("0800000008000000")), F.col("pixels"))
    rows = raster.decoded(pictures(spark, sf_dir).select("name", content.alias("content")))
    return raster.summary(raster.histogram(raster.pixels(rows))).select("name", "min_value", "max_value", "distinct_values")


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, 'Vorbis' AS codec, 1 + doc_id % 2 AS channels, 8000 * (1 + doc_id % 5) AS sample_rate, 3 AS page_count, CAST(1 + doc_id % 10 AS DOUBLE) AS duration_seconds,
  CASE WHEN doc_id % 6 = 0 THEN 'a page is missing' END AS error FROM documents""")
def ogg_properties(spark, sf_dir):
    def make(doc_id: int) -> Iterator[tuple]:
        rate = 8000 * (1 + doc_id % 5)
        first = b"\x01vorbis" + struct.pack("<IBIiii", 0, 1 + doc_id % 2, rate, 0, 64_000, 0) + b"\xb8\x01"
        pages = b""
        for k, (body, granule) in enumerate([(first, 0), (b"more" * 20, rate), (b"end", rate * (1 + doc_id % 10))]):
            number = k + (k == 2 and doc_id % 6 == 0)
            head = b"OggS" + struct.pack("<BBQII", 0, 0, granule, 77, number)
            tail = bytes([1, len(body)]) + body
            pages += head + struct.pack("<I", media.ogg_crc(head + bytes(4) + tail)) + tail
        yield str(doc_id), pages

    made = flat_map(table(spark, sf_dir, "documents").select("doc_id"), make, "path string, content binary")
    return media.ogg_properties(media.ogg_pages(made)).select("path", "codec", "channels", "sample_rate", "page_count", "duration_seconds", "error")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CAST(doc_id % 100 AS DOUBLE) AS duration_seconds, 1 AS streams, 640 + doc_id % 3 AS width, 'WMV3' AS codec FROM documents")
def asf_properties(spark, sf_dir):
    def make(doc_id: int) -> Iterator[tuple]:
        def element(kind: bytes, body: bytes) -> bytes:
            return kind + struct.pack("<Q", 24 + len(body)) + body

        picture = struct.pack("<IIBH", 640 + doc_id % 3, 480, 2, 40) + struct.pack("<IiiHH4s", 40, 640, 480, 1, 24, b"WMV3")
        stream = media._VIDEO + bytes(16) + bytes(8) + struct.pack("<IIH", len(picture), 0, 1) + bytes(4) + picture
        about = bytes(16) + struct.pack("<QQQQQQIIII", 0, 0, 0, (doc_id % 100) * 10_000_000, 0, 0, 0, 0, 0, 9)
        parts = element(media._FILE, about) + element(media._STREAM, stream)
        yield str(doc_id), media._ASF + struct.pack("<QIBB", 30 + len(parts), 2, 1, 2) + parts

    made = flat_map(table(spark, sf_dir, "documents").select("doc_id"), make, "path string, content binary")
    one = F.col("streams")[0]
    return media.asf_properties(made).where("error is null").select("path", "duration_seconds", F.size("streams").alias("streams"), one["width"].alias("width"), one["codec"].alias("codec"))


@query("""WITH t AS (SELECT doc_id, replace(replace(doc_id || '|' || o.source, '|', chr(10)), 'src', CASE WHEN doc_id % 2 = 0 THEN 'é' ELSE 'e' END) AS body FROM documents o WHERE o.source IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 3 WHEN 0 THEN 'UTF-16' WHEN 1 THEN 'UTF-8-SIG' ELSE 'UTF-8' END AS encoding, len(string_split(body, chr(10))) AS line_count, 'LF' AS newlines, sha256(body) AS text_sha256 FROM t""")
def text_encodings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null")
    body = F.regexp_replace(F.concat_ws("\n", F.col("doc_id").cast("string"), "source"), "src", "é")
    body = F.when(F.col("doc_id") % 2 == 0, body).otherwise(F.regexp_replace(F.concat_ws("\n", F.col("doc_id").cast("string"), "source"), "src", "e"))
    k = F.col("doc_id") % 3
    content = F.when(k == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(body, "UTF-16LE"))).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(body, "UTF-8"))).otherwise(F.encode(body, "UTF-8"))
    out = media.text_properties(d.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))
    return out.where("error is null").select("path", "encoding", "line_count", "newlines", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {DOCS} SELECT 'all.zip' AS package, 'files/' || doc_id || '.txt' AS member, size, sha256 FROM d WHERE doc_id % 11 = 0")
def zip_members(spark, sf_dir):
    folder = scratch(spark)
    rows = documents(spark, sf_dir).where("ordinal % 11 = 0").select(F.lit("all.zip").alias("name"), "ordinal", "content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        os.makedirs(folder, exist_ok=True)
        name = first.column("name")[0].as_py()
        target = os.path.join(folder, name)
        part = f"{target}.{TaskContext.get().taskAttemptId()}.part"
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in itertools.chain([first], batches):
                for ordinal, content in zip(batch.column("ordinal"), batch.column("content"), strict=True):
                    z.writestr(f"files/{ordinal}.txt", content.as_py())
        os.replace(part, target)
        yield pa.record_batch([pa.array([name]), pa.array([target])], names=["path", "location"])

    made = rows.repartition(1).sortWithinPartitions("ordinal").mapInArrow(write, "path string, location string")
    return packages.members(made).where("error is null").select("package", "member", "size", "sha256")


@query("""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'payload is missing' WHEN doc_id % 7 = 0 THEN 'payload type changed' WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'dimensions changed'
  WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'bytes after the image' WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 'folder payload changed' END AS failure FROM documents""")
def payload_rules(spark, sf_dir):
    o, kind = F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, "PNG").otherwise("FOLDER")
    make = lambda size, type_, width, trailing, sha: F.struct(size.alias("size"), type_.alias("payload_type"), width.alias("width"), F.lit(1).alias("height"), trailing.alias("trailing_bytes"), sha.alias("sha256"))
    nothing, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    old = make(one, kind, F.lit(4), nothing, F.lit("a"))
    new = make(F.when(o % 13 != 0, one), F.when(o % 7 == 0, "OGG").otherwise(kind), F.when(o % 5 == 0, 5).otherwise(4), F.when(o % 3 == 0, one).otherwise(nothing), F.when(o % 3 == 0, "b").otherwise(F.lit("a")))
    return table(spark, sf_dir, "documents").select("doc_id", rules.payload_failure(old, new).alias("failure"))

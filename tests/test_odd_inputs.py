"""Repeated places, pictures that turning leaves as they are, and packages and archives of many small files."""

import hashlib
import json
import zipfile

import duckdb
from pyspark.sql import functions as F

from assetlake.operators import states
from assetlake.plans import catalogue, dataflows  # noqa: F401 - registers its queries
from assetlake.sources import packages, stack
from assetlake.sources.catalog import file_catalog
from assetlake.sources.stack_new import created


def against_sql(spark, name, folder, documents):
    """A query's rows and its SQL's, over a table of documents (doc_id, source, lang, text)."""
    spark.createDataFrame(documents, "doc_id long, source string, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    df = catalogue.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    got = con.execute(f"select {', '.join(df.columns)} from ({catalogue.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(got, key=repr)


def test_identity_of_repeated_places(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "k long, a string, b long")
    old = table((1, "x", 1), (1, "y", 2), (2, "x", None), (2, "x", None), (3, "x", 1), (4, "x", 1), (4, "x", 1))
    new = table((1, "y", 2), (1, "x", 1), (2, "x", None), (2, "x", None), (4, "x", 1), (5, "z", 0), (5, "z", 0))
    got = states.identity_violations(old, new, ["k"], ["a", "b"]).collect()
    assert sorted(map(tuple, got)) == [(3, "missing"), (4, "differs"), (5, "extra")]
    assert states.identity_violations(old, old.repartition(5), ["k"], ["a", "b"]).count() == 0


def test_pictures_of_one_pattern(spark, tmp_path):
    texts = ["And " * 20, "a" * 70, "".join(chr(33 + k) for k in range(80)), "ab" * 32]
    got, want = against_sql(spark, "raster_project_build", tmp_path, [(10 * k, "s", "en", texts[k % 4]) for k in range(24)])
    assert got == want and {r[1] for r in got} == {"UNCHANGED", "MODIFIED", "FAIL"}


def test_members_are_dealt(spark, tmp_path):
    rows = []
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            for n in range(300):
                z.writestr(f"files/{n}", f"{k} {n}")
        rows.append((f"{k}.zip", str(tmp_path / f"{k}.zip")))
    found = packages.members(spark.createDataFrame(rows, "path string, location string").coalesce(1))
    own = found.withColumn("task", F.spark_partition_id()).collect()
    assert {(r.package, r.member): r.sha256 for r in own} == {(f"{k}.zip", f"files/{n}"): hashlib.sha256(f"{k} {n}".encode()).hexdigest() for k in range(2) for n in range(300)}
    assert len({r.task for r in own}) > 4


def test_manifest_of_many_files(spark, tmp_path):
    files = [{"archive": "a", "path": f"{n:0200d}", "member": f"files/a/{n:0200d}", "size_bytes": 1, "original_sha256": "0" * 64, "modified_sha256": "1" * 64} for n in range(2000)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.writestr(f["member"], "x")
        z.writestr(packages.MANIFEST, json.dumps({"id": "a", "version": "1", "name": "n", "files": files}))
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(packages.MANIFEST, " " * (packages.MOST_MANIFEST + packages.MEMBER_MANIFEST + 1))
    rows = spark.createDataFrame([(f"{p}.zip", str(tmp_path / f"{p}.zip")) for p in "ab"], "path string, location string")
    got = packages.manifests(rows).groupBy("package", "error").count().collect()
    assert sorted(map(tuple, got)) == [("a.zip", None, 2000), ("b.zip", "the manifest is too large", 1)]


def test_entries_of_one_archive_are_dealt(spark, tmp_path):
    rows = spark.range(500).select(F.lit("one").alias("archive"), F.col("id").alias("ordinal"), F.format_string("d/%d", "id").alias("path"), F.encode(F.format_string("text %d", "id"), "UTF-8").alias("content"), (F.col("id") % 2 == 0).alias("packed"))
    assert created(rows, str(tmp_path / "packs"), b"key").where("error is not null").count() == 0
    entries = stack.stack_index(file_catalog(spark, str(tmp_path / "packs")), b"key")
    assert [r.path for r in entries.orderBy("ordinal").collect()] == [f"d/{n}" for n in range(500)]
    want = {f"d/{n}": hashlib.sha256(f"text {n}".encode()).hexdigest() for n in range(500)}
    for made, sha in ((stack.payloads(entries), "sha256"), (stack.extracted(entries, str(tmp_path / "out")), "extracted_sha256")):
        got = made.withColumn("task", F.spark_partition_id()).collect()
        assert {r.path: r[sha] for r in got} == want and len({r.task for r in got}) > 4
    assert {r.path: r.sha256 for r in file_catalog(spark, str(tmp_path / "out"), digest=True).collect()} == {f"one/{p}": s for p, s in want.items()}

"""Column expressions, rules and selections over the test tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import binary, formats, paths
from ..operators import inventory, rules, selection, states
from ..sources import container, packages
from ..streaming import incremental
from .catalogue import FILES, REFRESHED, SHORT, URLS, VERSIONS, files, labelled, query, recorded, refreshed_rows, table, urls, workspace
from .reports import unknown


def pick(values: Sequence, at: Column) -> Column:
    """The value at ``at`` modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (1 + at % len(values)).cast("int"))


def said(values: Sequence, at: str) -> str:
    """``pick`` in SQL."""
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][1 + {at} % {len(values)}]"


# ---- formats and payloads

ENDINGS = (".png", ".OGG", ".wmv", ".asf", ".cmap", ".ors", ".ini", ".Txt", ".dat", ".other")
BY_ENDING = ("PNG", "Ogg", "ASF/WMV", "ASF/WMV", "CMAP", "ORS", "INI", "TXT", "DAT/UNKNOWN", "UNKNOWN")


@query(f"SELECT doc_id, {said(BY_ENDING, 'doc_id')} AS format FROM documents")
def formats_by_extension(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", formats.by_extension(pick(ENDINGS, F.col("doc_id"))).alias("format"))


SAMPLES = ("89504E470D0A1A0A", "4F676753", formats.ASF, "52494646", "424D", "44445320", "FFD8FF", "504B0304", formats.CONTAINER, "00", "00", "00")
DECLARED = ("CSprite", None, None, None, None, None, None, None, None, "CAutoFolder", "CSprite", None)
TYPES = ("PNG", "OGG", "WMV_ASF", "RIFF", "BMP", "DDS", "JPEG", "ZIP", "CRIO", "FOLDER", "CSprite", "UNKNOWN")


@query(f"SELECT doc_id, {said(TYPES, 'doc_id')} AS payload_type, doc_id % 12 = 8 AS is_container FROM documents")
def payload_types(spark, sf_dir):
    k = F.col("doc_id")
    sample = F.concat(F.unhex(pick(SAMPLES, k)), F.substring(F.col("text").cast("binary"), 1, 16))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", formats.payload_type(sample, pick(DECLARED, k)).alias("payload_type"), formats.is_container(sample).alias("is_container"))


@query("""SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 5 = 0 THEN 'does not exist' END, CASE WHEN doc_id % 5 != 0 AND doc_id % 7 = 0 THEN 'is not a file' END, CASE WHEN doc_id % 5 = 1 THEN 'is empty' END, CASE WHEN doc_id % 3 != 0 THEN 'has another extension' END) AS errors FROM documents""")
def basic_archive_errors(spark, sf_dir):
    k = F.col("doc_id")
    errors = rules.basic_errors(F.when(k % 5 == 1, 0).when(k % 5 != 0, 10), F.when(k % 3 == 0, "a.GPK").otherwise("a.bin"), k % 7 != 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(errors, "; ").alias("errors"))


# ---- paths and texts

ODD = ("a/../b", "/abs", "a\\b", "..", "C:x", "dir/f.txt", "a//b", ".", "", "x..y/z", "\\\\host", "d/..", "..\\up")


@query(rf"""WITH p AS (SELECT doc_id, {said(ODD, 'doc_id')} AS path FROM documents), q AS (SELECT *, replace(path, '\', '/') AS slashed FROM p)
SELECT doc_id, path != '' AND NOT regexp_matches(slashed, '^/|^[A-Za-z]:') AND NOT regexp_matches(slashed, '(^|/)\.\.(/|$)') AS inside, path NOT IN ('', '.', '..') AND NOT contains(slashed, '/') AS archive_name FROM q""")
def path_predicates(spark, sf_dir):
    p = pick(ODD, F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", paths.is_inside(p).alias("inside"), paths.is_archive_name(p).alias("archive_name"))


NAMED = ("abc", "ab", "Abc", "a.b-c_d", "a b", "-abc", "a" * 64, "a" * 65, "1.0+x", "0" * 64, "A" * 64, "abc\n", "")


@query(f"""WITH p AS (SELECT doc_id, replace({said([n.replace(chr(10), '@') for n in NAMED], 'doc_id')}, '@', chr(10)) AS x FROM documents)
SELECT doc_id, regexp_full_match(x, '[a-z0-9][a-z0-9._-]{{2,63}}') AS identity, regexp_full_match(x, '[0-9A-Za-z][0-9A-Za-z._+-]{{0,31}}') AS version, regexp_full_match(x, '[0-9a-f]{{64}}') AS digest FROM p""")
def identity_patterns(spark, sf_dir):
    x = pick(NAMED, F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", paths.is_identity(x).alias("identity"), paths.is_version(x).alias("version"), paths.is_digest(x).alias("digest"))


@query("""WITH p AS (SELECT doc_id, 'p/' || doc_id % 4 AS a, 'p/' || doc_id % 4 || ['', '/', '/sub', 'x'][1 + doc_id % 4] AS b FROM documents)
SELECT doc_id, doc_id % 4 != 3 AS overlap FROM p""")
def path_overlaps(spark, sf_dir):
    k = F.col("doc_id")
    a = F.concat(F.lit("p/"), (k % 4).cast("string"))
    b = F.concat(a, pick(("", "/", "/sub", "x"), k))
    swap = F.floor(k / 4) % 2 == 0
    return table(spark, sf_dir, "documents").select("doc_id", paths.overlap(F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)).alias("overlap"))


FILE_NAMES = ("a.txt", ".hidden", "A.TAR.GZ", "none", "x.", "dir.d/file", ".a.b", "ü.PNG")


@query(f"SELECT doc_id, {said(('.txt', '', '.gz', '', '', '', '.b', '.png'), 'doc_id')} AS suffix, {said(('a', '.hidden', 'A.TAR', 'none', 'x.', 'file', '.a', 'ü'), 'doc_id')} AS stem, {said(('.txt', '[no extension]', '.gz', '[no extension]', '[no extension]', '[no extension]', '.b', '.png'), 'doc_id')} AS extension FROM documents")
def suffix_and_stem(spark, sf_dir):
    p = F.concat(F.lit("top/"), pick(FILE_NAMES, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", paths.suffix(p).alias("suffix"), paths.stem(p).alias("stem"), paths.extension(p).alias("extension"))


@query(r"""WITH p AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '?a=<1>' WHEN 1 THEN '%|*' WHEN 2 THEN '.' ELSE '' END AS name FROM pages)
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '%5Fcon.txt' ELSE regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(name, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '<', '%3C'), '>', '%3E'), '|', '%7C'), '*', '%2A'), '\.$', '%2E') END AS file FROM p""")
def safe_components(spark, sf_dir):
    k = F.col("page_id")
    name = F.when(k % 7 == 0, "con.txt").otherwise(F.concat("url", pick(("?a=<1>", "%|*", ".", ""), k)))
    return table(spark, sf_dir, "pages").select("page_id", container.safe_name(name).alias("file"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '' ELSE upper(substr(sha256(text), 1, 6)) END AS hex FROM documents")
def hex_to_bytes(spark, sf_dir):
    h, k = F.sha2(F.col("text").cast("binary"), 256), F.col("doc_id") % 4
    text = F.when(k == 0, "zz").when(k == 2, F.concat_ws(" ", F.substring(h, 1, 2), F.substring(h, 3, 2), F.substring(h, 5, 2))).when(k == 3, F.concat(F.lit("\t"), F.substring(h, 1, 6), F.lit("\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(binary.from_hex(text)).alias("hex"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents)
SELECT doc_id, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS le4, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS be4, CAST('0x' || substr(h, 11, 2) || substr(h, 9, 2) AS BIGINT) AS le2, CAST(NULL AS BIGINT) AS beyond FROM h""")
def endian_numbers(spark, sf_dir):
    b = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    return table(spark, sf_dir, "documents").select("doc_id", binary.uint_le(b, 0, 4).alias("le4"), binary.uint_be(b, 0, 4).alias("be4"), binary.uint_le(b, 4, 2).alias("le2"), binary.uint_le(b, 30, 4).alias("beyond"))


# ---- rules of formats


def _judged(rows, rule, key: str):
    out = rules.compared(rows, rule)
    return out.select(key, F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 5 = 0 THEN 'codec changed' END, CASE WHEN p_partkey % 7 = 0 THEN 'channels changed' END, CASE WHEN p_partkey % 11 = 0 THEN 'sample_rate changed' END) AS errors,
  CASE WHEN p_partkey % 3 = 0 THEN 'nominal_bitrate changed' ELSE '' END AS warnings FROM part""")
def ogg_rules(spark, sf_dir):
    k = F.col("p_partkey")
    make = lambda codec, channels, rate, bits: F.struct(codec.alias("codec"), channels.alias("channels"), rate.alias("sample_rate"), bits.alias("nominal_bitrate"))
    old = make(F.lit("Vorbis"), F.lit(2), F.lit(44100), F.lit(64000))
    new = make(F.when(k % 5 != 0, "Vorbis"), F.when(k % 7 == 0, 1).otherwise(2), F.when(k % 11 == 0, 8000).otherwise(44100), F.when(k % 3 == 0, 1).otherwise(64000))
    return _judged(table(spark, sf_dir, "part").select(k, old.alias("old"), new.alias("new")), rules.ogg, "p_partkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'number of streams changed' ELSE concat_ws('; ', CASE WHEN p_partkey % 5 = 0 THEN 'stream 1 width changed' END, CASE WHEN p_partkey % 3 = 0 THEN 'stream 1 codec changed' END,
  CASE WHEN p_partkey % 7 = 0 THEN 'stream 2 type changed' WHEN p_partkey % 2 = 0 THEN 'stream 2 channels changed' END) END AS errors, CASE WHEN p_partkey % 11 != 0 AND p_partkey % 13 = 0 THEN 'duration changed' ELSE '' END AS warnings FROM part""")
def asf_rules(spark, sf_dir):
    k = F.col("p_partkey")
    stream = lambda kind, width, codec, channels: F.struct(kind.alias("type"), width.alias("width"), F.lit(480).alias("height"), codec.alias("codec"), F.lit(1).alias("format_tag"), channels.alias("channels"), F.lit(8000).alias("sample_rate"))
    film = stream(F.lit("video"), F.lit(640), F.lit("WMV3"), F.lit(0))
    sound = stream(F.lit("audio"), F.lit(0), F.lit(""), F.lit(2))
    film_now = stream(F.lit("video"), F.when(k % 5 == 0, 320).otherwise(640), F.when(k % 3 == 0, "WMV2").otherwise("WMV3"), F.lit(0))
    sound_now = stream(F.when(k % 7 == 0, "other").otherwise("audio"), F.lit(0), F.lit(""), F.when(k % 2 == 0, 1).otherwise(2))
    old = F.struct(F.array(film, sound).alias("streams"), F.lit(1.5).alias("duration_seconds"))
    new = F.struct(F.when(k % 11 == 0, F.array(film_now)).otherwise(F.array(film_now, sound_now)).alias("streams"), F.when(k % 13 == 0, 2.5).otherwise(1.5).alias("duration_seconds"))
    return _judged(table(spark, sf_dir, "part").select(k, old.alias("old"), new.alias("new")), rules.asf, "p_partkey")


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 5 = 0 THEN 'dimensions changed from ' || p_size || 'x2 to ' || p_size + 1 || 'x2' END, CASE WHEN p_partkey % 3 = 0 THEN 'new region IDs: 7, 9' END) AS errors, '' AS warnings FROM part""")
def region_raster_rules(spark, sf_dir):
    k = F.col("p_partkey")
    make = lambda width, ids: F.struct(width.alias("width"), F.lit(2).alias("height"), ids.alias("region_ids"))
    ids = lambda *x: F.array(*[F.lit(v) for v in x])
    new = make(F.col("p_size") + F.when(k % 5 == 0, 1).otherwise(0), F.when(k % 3 == 0, ids(9, 2, 7)).otherwise(ids(3, 1)))
    return _judged(table(spark, sf_dir, "part").select(k, make(F.col("p_size"), ids(1, 2, 3)).alias("old"), new.alias("new")), rules.raster, "p_partkey")


@query("""WITH t AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS plain, ['UTF-8', 'UTF-8-SIG', 'UTF-16'][1 + p_partkey % 3] AS now FROM part)
SELECT k AS p_partkey, concat_ws('; ', CASE WHEN now != 'UTF-8' AND NOT (plain AND now = 'UTF-8-SIG') THEN 'text encoding changed' END, CASE WHEN NOT plain AND k % 5 = 0 THEN 'text structure changed: sections' END, CASE WHEN k % 7 = 0 THEN 'text structure changed: keys' END) AS errors,
  CASE WHEN k % 4 = 0 THEN 'text newline convention changed' ELSE '' END AS warnings FROM t""")
def text_rules(spark, sf_dir):
    k = F.col("p_partkey")
    words = lambda *x: F.array(*[F.lit(v) for v in x])
    make = lambda encoding, sections, keys, newlines: F.struct(encoding.alias("encoding"), sections.alias("sections"), keys.alias("keys"), newlines.alias("newlines"))
    sections = F.when(k % 2 != 0, words("one", "two"))
    old = make(F.lit("UTF-8"), sections, words("a", "b"), F.lit("LF"))
    new = make(pick(("UTF-8", "UTF-8-SIG", "UTF-16"), k), F.when(k % 5 == 0, words("one")).otherwise(sections), F.when(k % 7 == 0, words("b", "a")).otherwise(words("a", "b")), F.when(k % 4 == 0, "CRLF").otherwise("LF"))
    return _judged(table(spark, sf_dir, "part").select(k, old.alias("old"), new.alias("new")), rules.text, "p_partkey")


# ---- selections, orders and listings


@query(f"WITH {URLS}, m AS (SELECT max(archive) AS hi FROM urls) SELECT page_id FROM urls, m WHERE (archive, path) IN (SELECT (archive, path) FROM urls WHERE page_id % 7 = 0) OR archive = hi")
def select_files_and_folders(spark, sf_dir):
    u = urls(spark, sf_dir)
    last = u.agg(F.max("archive")).first()[0]
    return selection.select_rows(u, u.where("page_id % 7 = 0"), [(last, "")]).select("page_id")


@query(f"""WITH {URLS}, m AS (SELECT max(archive) AS hi FROM urls) SELECT 'marks' AS meant, page_id FROM urls WHERE (archive, path) IN (SELECT (archive, path) FROM urls WHERE page_id % 11 = 0)
UNION ALL SELECT 'picked', page_id FROM urls WHERE (archive, path) IN (SELECT (archive, path) FROM urls WHERE page_id % 13 = 0) UNION ALL SELECT 'tree', page_id FROM urls, m WHERE archive = hi""")
def selection_precedence(spark, sf_dir):
    """Marks go before picked rows, these before the tree; stale marks count for nothing."""
    u = urls(spark, sf_dir)
    tree = [(u.agg(F.max("archive")).first()[0], "")]
    marks, picked, stale = u.where("page_id % 11 = 0"), u.where("page_id % 13 = 0"), u.select(F.lit("gone").alias("archive"), "path")
    meant = {"marks": selection.preferred(u, marks, picked, folders=tree), "picked": selection.preferred(u, stale, picked, folders=tree), "tree": selection.preferred(u, stale, None, folders=tree)}
    first, *rest = [rows.select(F.lit(name).alias("meant"), "page_id") for name, rows in meant.items()]
    for rows in rest:
        first = first.unionByName(rows)
    return first


@query("SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1")
def distinct_in_order(spark, sf_dir):
    return selection.choices_in_order(table(spark, sf_dir, "events"), "event_type", "event_id")


@query(REFRESHED + """, o AS (SELECT s.archive, s.path, f.ordinal, f.ordinal IS NULL AS is_extra FROM s LEFT JOIN files f ON f.archive = s.archive AND f.path = s.path)
SELECT archive, path, row_number() OVER (ORDER BY lower(archive), archive, is_extra, ordinal, lower(path), path) AS row FROM o""")
def natural_order(spark, sf_dir):
    rows = refreshed_rows(spark, sf_dir).join(files(spark, sf_dir).select("archive", "path", "ordinal"), ["archive", "path"], "left")
    return selection.natural(rows.withColumn("is_extra", F.col("ordinal").isNull())).select("archive", "path", "row")


@query(REFRESHED + " SELECT archive, path, state FROM s WHERE state NOT IN ('original', 'não extraído')")
def nontrivial_rows(spark, sf_dir):
    return states.nontrivial(refreshed_rows(spark, sf_dir)).select("archive", "path", "state")


@query(f"WITH {VERSIONS} SELECT 'TXT' AS format, CASE WHEN w.path IS NOT NULL AND w.sha256 = r.extracted_sha256 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS file_count FROM recorded r LEFT JOIN workspace w USING (archive, path) WHERE coalesce(r.extracted, true) GROUP BY ALL")
def baseline_formats(spark, sf_dir):
    out = states.baseline(recorded(spark, sf_dir), workspace(spark, sf_dir))
    return inventory.counts_by(out.withColumn("format", formats.by_extension(paths.extension(F.col("path")))), "format", "status")


@query(f"WITH {FILES} SELECT lpad(CAST(row_number() OVER (ORDER BY lower(path), path) AS VARCHAR), 6, ' ') || '  UNKNOWN  ' || size || '  ' || path AS line FROM files WHERE {SHORT} = 'UNKNOWN'")
def unknown_listing(spark, sf_dir):
    return unknown(labelled(spark, sf_dir).drop("ordinal").withColumnRenamed("format", "detected_format"))


@query("""WITH n AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'Pack' WHEN 1 THEN 'PACK' ELSE 'pack' END || p_partkey // 2 || CASE WHEN p_partkey % 5 = 0 THEN '.zip' WHEN p_partkey % 2 = 0 THEN '.gpk' ELSE '.GPK' END AS name FROM part),
s AS (SELECT lower(left(name, length(name) - 4)) AS stem FROM n WHERE k % 7 != 0 AND k % 5 != 0) SELECT stem, 'two archives have this name' AS problem FROM s GROUP BY stem HAVING count(*) > 1""")
def archive_name_clashes(spark, sf_dir):
    k = F.col("p_partkey")
    ending = F.when(k % 5 == 0, ".zip").when(k % 2 == 0, ".gpk").otherwise(".GPK")
    name = F.concat(pick(("Pack", "PACK", "pack"), k), F.floor(k / 2).cast("string"), ending)
    return inventory.archive_problems(table(spark, sf_dir, "part").select(F.when(k % 7 == 0, F.concat(F.lit("below/"), name)).otherwise(name).alias("path")))


@query(f"""WITH {VERSIONS}, e AS (SELECT r.archive, w.size FROM recorded r JOIN workspace w USING (archive, path) WHERE coalesce(r.extracted, true) AND w.sha256 != r.extracted_sha256)
SELECT archive, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM e GROUP BY archive UNION ALL SELECT NULL, count(*), CAST(coalesce(sum(size), 0) AS BIGINT) FROM e""")
def package_totals(spark, sf_dir):
    return packages.totals(packages.edited(recorded(spark, sf_dir), workspace(spark, sf_dir).withColumn("location", F.lit(None).cast("string"))))


@query("SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) % 3600 AS into_hour, count(DISTINCT date_trunc('hour', ts)) AS hours, count(*) AS events FROM events GROUP BY 1, 2")
def activity_windows(spark, sf_dir):
    w = incremental.activity(table(spark, sf_dir, "events"))
    start = F.unix_timestamp(F.col("window.start").cast("timestamp"))
    return w.groupBy("event_type", (start % 3600).alias("into_hour")).agg(F.countDistinct("window.start").alias("hours"), F.sum("n").alias("events"))

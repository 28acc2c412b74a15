"""Every operator applied to the test tables, which stand for file catalogs, with the same in SQL.

``documents`` is a catalog (archive = source, path = lang/doc_id.txt, content = text); edits of a
workspace are derived from ids, so that each state occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, formats, paths
from ..operators import inventory, layout, probing, raster, rules, selection, states

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(F.col("source").alias("archive"), F.col("doc_id").alias("ordinal"), path.alias("path"), F.concat(F.lit("."), F.col("lang")).alias("extension"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content"), "text")


FILES = "files AS (SELECT source AS archive, doc_id AS ordinal, lang || '/' || doc_id || '.txt' AS path, '.' || lang AS extension, octet_length(encode(text)) AS size, text FROM documents)"


def short_format(header: Column) -> Column:
    return F.when(F.startswith(header, F.lit("3C")), "markup").when(header.rlike("^(4[1-9A-F]|5[0-9A])"), "upper").otherwise(formats.UNKNOWN)


SHORT = "CASE WHEN starts_with(hex(encode(text)), '3C') THEN 'markup' WHEN regexp_matches(hex(encode(text)), '^(4[1-9A-F]|5[0-9A])') THEN 'upper' ELSE 'UNKNOWN' END"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumn("format", short_format(F.hex("content")))


# ---- scans and summaries


@query(f"WITH {FILES} SELECT count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM files")
def scan_inventory_totals(spark, sf_dir):
    return inventory.totals(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT extension, count(*) AS file_count FROM files GROUP BY ALL")
def ext_counts(spark, sf_dir):
    return inventory.counts_by(files(spark, sf_dir), "extension")


@query(f"WITH {FILES} SELECT {SHORT} AS format, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM files GROUP BY ALL")
def format_counts(spark, sf_dir):
    return inventory.counts_by(labelled(spark, sf_dir), "format", size="size")


@query("""
WITH h AS (SELECT html AS t, hex(encode(html)) AS h, '.html' AS ext FROM pages UNION ALL SELECT text, hex(encode(text)), CASE WHEN doc_id % 3 = 0 THEN '.txt' WHEN doc_id % 3 = 1 THEN '.ini' ELSE '.ors' END FROM documents)
SELECT label, count(*) AS n FROM (SELECT CASE
  WHEN ext = '.ors' AND regexp_matches(substr(h, 1, 64), '^(20|09|0A|0B|0C|0D)*5B') THEN 'ORS script'
  WHEN ext = '.ini' AND starts_with(regexp_replace(h, '^EFBBBF', ''), '5B') THEN 'INI text'
  WHEN ext = '.txt' THEN 'UTF-8 text'
  WHEN starts_with(h, '424D') THEN 'BMP' WHEN starts_with(h, '4D5A') THEN 'Windows executable' WHEN starts_with(h, '494433') THEN 'MP3 with ID3'
  ELSE 'UNKNOWN' END AS label FROM h) GROUP BY label""")
def format_detect_case(spark, sf_dir):
    ext = F.when(F.col("doc_id") % 3 == 0, ".txt").when(F.col("doc_id") % 3 == 1, ".ini").otherwise(".ors")
    d = table(spark, sf_dir, "documents").select(F.col("text").alias("t"), ext.alias("ext"))
    both = table(spark, sf_dir, "pages").select(F.col("html").alias("t"), F.lit(".html").alias("ext")).unionByName(d)
    header = F.substring(F.col("t").cast("binary"), 1, 32)
    return both.select(formats.detect(header, F.col("ext")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""
WITH {FILES}, c AS (SELECT extension, substr(hex(encode(text)), 1, 32) AS header_hex, count(*) AS file_count, min(ordinal) AS first_seen FROM files GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY extension ORDER BY file_count DESC, first_seen) AS rank FROM c)
SELECT extension, header_hex, file_count, first_seen, rank FROM r WHERE rank <= 10""")
def header_top10_per_ext(spark, sf_dir):
    return inventory.top_headers(files(spark, sf_dir).withColumn("header_hex", F.hex(F.substring("content", 1, 16))))


@query(f"""
WITH {FILES}, f AS (SELECT *, {SHORT} AS format FROM files)
SELECT 'total' AS level, CAST(NULL AS VARCHAR) AS archive, CAST(NULL AS VARCHAR) AS key, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM f
UNION ALL SELECT 'extension', NULL, extension, count(*), CAST(sum(size) AS BIGINT) FROM f GROUP BY extension
UNION ALL SELECT 'format', NULL, format, count(*), CAST(sum(size) AS BIGINT) FROM f GROUP BY format
UNION ALL SELECT 'archive', archive, NULL, count(*), CAST(sum(size) AS BIGINT) FROM f GROUP BY archive
UNION ALL SELECT 'archive_extension', archive, extension, count(*), CAST(sum(size) AS BIGINT) FROM f GROUP BY archive, extension
UNION ALL SELECT 'archive_format', archive, format, count(*), CAST(sum(size) AS BIGINT) FROM f GROUP BY archive, format""")
def summary_grouping_sets(spark, sf_dir):
    return inventory.summary(labelled(spark, sf_dir))


@query(f"WITH {FILES} SELECT ordinal, path FROM files WHERE {SHORT} = 'UNKNOWN'")
def unknown_only(spark, sf_dir):
    return labelled(spark, sf_dir).where(F.col("format") == formats.UNKNOWN).select("ordinal", "path")


@query("SELECT sha256(lower(text)) AS key, count(*) AS n_rows, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_case_insensitive(spark, sf_dir):
    return inventory.duplicates(files(spark, sf_dir), F.sha2(F.lower("text"), 256))


@query("SELECT string_agg(p_type, ';' ORDER BY lower(p_type), p_type) AS types FROM (SELECT DISTINCT p_type FROM part)")
def distinct_sorted_ci(spark, sf_dir):
    return inventory.distinct_ignoring_case(table(spark, sf_dir, "part"), "p_type").select(F.array_join("values", ";").alias("types"))


@query("SELECT l_returnflag, count_if(l_quantity >= 25) AS packed, count_if(l_quantity < 25) AS unpacked FROM lineitem GROUP BY 1")
def conditional_counts(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(q >= 25).alias("packed"), F.count_if(q < 25).alias("unpacked"))


@query("SELECT *, estimate + greatest(16777216, estimate // 100) AS required FROM (SELECT l_linestatus, CAST(sum(CASE WHEN l_quantity >= 25 THEN l_partkey ELSE l_suppkey END) AS BIGINT) AS estimate FROM lineitem GROUP BY 1)")
def space_estimate(spark, sf_dir):
    size = F.sum(F.when(F.col("l_quantity") >= 25, F.col("l_partkey")).otherwise(F.col("l_suppkey"))).alias("estimate")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(size).withColumn("required", binary.space_needed(F.col("estimate")))


@query("SELECT l_orderkey, bool_and(l_quantity > 5) AS every, bool_or(l_quantity > 45) AS some FROM lineitem GROUP BY 1")
def bool_folds(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(q > 5).alias("every"), F.bool_or(q > 45).alias("some"))


@query("SELECT user_id, count_if(value >= 50) AS passed, count_if(value < 50) AS failed, CASE WHEN count_if(value < 50) = 0 THEN 'PASS' ELSE 'PARTIAL' END AS status FROM events GROUP BY 1")
def status_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("value") >= 50, "PASS").when(F.col("value") < 50, "FAIL").alias("status"))
    return states.status_fold(e, "user_id")


# ---- selection


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_brand || '/' || p_name), '1') AND contains(lower(p_brand || '/' || p_name), 'brand') AND p_type = (SELECT min(p_type) FROM part)")
def filter_rows_words(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = p.agg(F.min("p_type")).first()[0]
    rows = p.select("p_partkey", "p_name", F.col("p_brand").alias("archive"), F.col("p_name").alias("path"), F.col("p_type").alias("format"))
    return selection.filter_rows(rows, "1 BRAND", format_name=first).select("p_partkey", "p_name")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("ordinal"), paths.first_segment(bare).alias("archive"), F.regexp_replace(bare, "^[^/]*/?", "").alias("path"))


URLS = "urls AS (SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS archive, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '^[^/]*/?', '') AS path FROM pages)"


@query(f"WITH {URLS}, a AS (SELECT min(archive) AS lo, max(archive) AS hi, min(split_part(path, '/', 1)) AS folder FROM urls) SELECT page_id, archive, path FROM urls, a WHERE archive = lo OR (archive = hi AND starts_with(path, folder || '/'))")
def filter_scope_prefix(spark, sf_dir):
    u = urls(spark, sf_dir)
    a = u.agg(F.min("archive").alias("lo"), F.max("archive").alias("hi"), F.min(paths.first_segment(F.col("path"))).alias("folder")).first()
    return selection.filter_rows(u, scope=[(a.lo, ""), (a.hi, a.folder)]).select("page_id", "archive", "path")


@query(f"WITH {URLS} SELECT archive, count(*) AS n, string_agg(path, ';' ORDER BY page_id, path) AS paths FROM urls WHERE page_id % 7 = 0 OR archive = (SELECT max(archive) FROM urls) GROUP BY archive")
def select_union_group(spark, sf_dir):
    u = urls(spark, sf_dir)
    last = u.agg(F.max("archive")).first()[0]
    named = u.where("page_id % 7 = 0")
    picked = selection.select_rows(u.join(named.select("page_id"), "page_id", "left_semi"), everything=True).unionByName(selection.select_rows(u.where("page_id % 7 != 0"), folders=[(last, "")]))
    return selection.by_archive(picked).select("archive", F.size("paths").cast("long").alias("n"), F.array_join("paths", ";").alias("paths"))


@query("SELECT o_orderkey, (n - 1) // 500 AS page, (n - 1) % 500 AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)")
def paginate(spark, sf_dir):
    out = selection.page_numbers(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")
    return out.select("o_orderkey", F.col("page").cast("long").alias("page"), F.col("place").cast("long").alias("place"))


@query(f"WITH {URLS}, p AS (SELECT archive, string_split(path, '/') AS parts FROM urls), e AS (SELECT archive, parts, unnest(range(1, len(parts))) AS k FROM p) SELECT archive, array_to_string(parts[1:k], '/') AS folder, max(k) AS depth, count(*) AS file_count FROM e GROUP BY 1, 2")
def path_ancestors(spark, sf_dir):
    return selection.folders(urls(spark, sf_dir)).withColumn("depth", F.col("depth").cast("long"))


@query("SELECT split_part(url, '/', 3) AS host, count(*) AS n FROM pages GROUP BY 1")
def first_segment(spark, sf_dir):
    host = paths.first_segment(F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS archive, 'x' AS path FROM customer WHERE c_nationkey < 5 INTERSECT SELECT o_custkey, 'x' FROM orders")
def stale_marks(spark, sf_dir):
    marks = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("archive"), F.lit("x").alias("path"))
    return selection.still_there(marks, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), F.lit("x").alias("path")))


@query("SELECT DISTINCT p_type AS choice FROM part")
def filter_choices(spark, sf_dir):
    return selection.choices(table(spark, sf_dir, "part"), "p_type").withColumnRenamed("p_type", "choice")


# ---- joins of catalog versions


@query("SELECT c.c_custkey AS name, CASE WHEN o.k IS NULL THEN 'FAILED' ELSE 'FOUND' END AS status, CASE WHEN o.k IS NULL THEN 'Matching reference archive not found' END AS error FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON k = c_custkey")
def ref_left_join_unmatched(spark, sf_dir):
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"))
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stem")).distinct()
    return states.matched_references(w, r).select("name", "status", "error")


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction records: ids that 13 divides have none; ids that 5 divides were not extracted, those that 3 divides do not say."""
    f = files(spark, sf_dir).where("ordinal % 13 != 0")
    return f.select("archive", "path", F.when(F.col("ordinal") % 5 == 0, False).when(F.col("ordinal") % 3 == 0, None).otherwise(True).alias("extracted"), F.sha2("content", 256).alias("extracted_sha256"))


def workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that 7 divides are edited, by 11 missing, by 49 broken, by 10 not there as they were never extracted; some are new."""
    f = files(spark, sf_dir).where("ordinal % 11 != 0 and ordinal % 10 != 0")
    edited = F.col("ordinal") % 7 == 0
    content = F.when(edited, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))
    broken = F.when(F.col("ordinal") % 49 == 0, F.array(F.lit("dimensions changed"), F.lit("bit depth changed")))
    advice = F.when(edited & (F.col("ordinal") % 2 == 0), F.array(F.lit("duration changed")))
    path = F.when(F.col("ordinal") % 17 == 0, F.concat(F.lit("new/"), F.col("path"))).otherwise(F.col("path"))
    return f.select("archive", path.alias("path"), F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"), broken.alias("errors"), advice.alias("warnings"), "ordinal")


RECORDED = "recorded AS (SELECT archive, path, CASE WHEN ordinal % 5 = 0 THEN false WHEN ordinal % 3 = 0 THEN NULL ELSE true END AS extracted, sha256(text) AS extracted_sha256 FROM files WHERE ordinal % 13 != 0)"
WORKSPACE = """workspace AS (SELECT archive, CASE WHEN ordinal % 17 = 0 THEN 'new/' || path ELSE path END AS path, ordinal,
  octet_length(encode(CASE WHEN ordinal % 7 = 0 THEN text || '!' ELSE text END)) AS size, sha256(CASE WHEN ordinal % 7 = 0 THEN text || '!' ELSE text END) AS sha256,
  ordinal % 49 = 0 AS broken, ordinal % 14 = 0 AS advice FROM files WHERE ordinal % 11 != 0 AND ordinal % 10 != 0)"""
VERSIONS = f"{FILES}, {RECORDED}, {WORKSPACE}"


@query(f"WITH {VERSIONS} SELECT f.archive, f.path, CASE WHEN r.path IS NULL OR r.extracted = false THEN 'não extraído' ELSE 'não verificado' END AS state FROM files f LEFT JOIN recorded r USING (archive, path)")
def catalog_state(spark, sf_dir):
    return states.catalog(files(spark, sf_dir), recorded(spark, sf_dir)).select("archive", "path", "state")


REFRESHED = f"""WITH {VERSIONS}, j AS (
  SELECT coalesce(f.archive, w.archive) AS archive, coalesce(f.path, w.path) AS path, f.path IS NOT NULL AS indexed, w.path IS NOT NULL AS present,
         r.path IS NOT NULL AND coalesce(r.extracted, true) AS taken, w.sha256, r.extracted_sha256, coalesce(w.size, f.size) AS size, w.broken, w.advice
  FROM files f LEFT JOIN recorded r USING (archive, path) FULL JOIN workspace w ON w.archive = f.archive AND w.path = f.path),
s AS (SELECT *, CASE WHEN NOT indexed THEN 'novo' WHEN NOT taken AND present THEN 'novo' WHEN NOT taken THEN 'não extraído' WHEN NOT present THEN 'ausente'
  WHEN sha256 IS NOT DISTINCT FROM extracted_sha256 THEN 'original' WHEN broken THEN 'inválido' ELSE 'modificado' END AS state FROM j)"""


def refreshed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.refreshed(files(spark, sf_dir), recorded(spark, sf_dir), workspace(spark, sf_dir))


@query(REFRESHED + " SELECT archive, path, state, size FROM s")
def six_state_refresh(spark, sf_dir):
    return refreshed_rows(spark, sf_dir).select("archive", "path", "state", "size")


@query(REFRESHED + " SELECT state, count(*) AS n FROM s GROUP BY 1")
def six_state_counts(spark, sf_dir):
    return refreshed_rows(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


BASE = f"""WITH {VERSIONS}, b AS (SELECT r.archive, r.path, w.sha256, CASE WHEN w.path IS NULL THEN 'Asset is missing from workspace' WHEN w.sha256 IS DISTINCT FROM r.extracted_sha256 THEN 'Workspace is not clean' END AS error
  FROM recorded r LEFT JOIN workspace w USING (archive, path) WHERE coalesce(r.extracted, true))"""


@query(BASE + " SELECT archive, path, sha256, CASE WHEN error IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, error FROM b")
def baseline_build(spark, sf_dir):
    return states.baseline(recorded(spark, sf_dir), workspace(spark, sf_dir))


@query(BASE + " SELECT count_if(error IS NULL) AS passed, count_if(error IS NOT NULL) AS failed, CASE WHEN count_if(error IS NOT NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM b")
def baseline_status(spark, sf_dir):
    return states.status_fold(states.baseline(recorded(spark, sf_dir), workspace(spark, sf_dir)), otherwise="FAIL")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("ordinal % 19 != 0").select("archive", "path", F.when(F.col("ordinal") % 4 == 0, "UNKNOWN").otherwise("TXT").alias("format"), F.sha2("content", 256).alias("sha256"))


VALIDATED = f"""WITH {VERSIONS}, base AS (SELECT archive, path, CASE WHEN ordinal % 4 = 0 THEN 'UNKNOWN' ELSE 'TXT' END AS format, sha256(text) AS original FROM files WHERE ordinal % 19 != 0),
j AS (SELECT coalesce(b.archive, w.archive) AS archive, coalesce(b.path, w.path) AS path, b.path IS NOT NULL AS expected, w.path IS NOT NULL AS present, b.format, w.broken, w.advice,
  b.path IS NOT NULL AND w.path IS NOT NULL AND w.sha256 != b.original AS modified FROM base b FULL JOIN workspace w ON b.archive = w.archive AND b.path = w.path),
e AS (SELECT *, CASE WHEN NOT expected THEN 'Extra entries are unsupported' WHEN NOT present THEN 'Asset is missing from workspace'
  WHEN modified AND format = 'UNKNOWN' THEN 'Modified unknown format requires permission' WHEN modified AND broken THEN 'dimensions changed; bit depth changed' END AS error FROM j),
v AS (SELECT archive, path, CASE WHEN expected THEN format ELSE 'EXTRA' END AS format, CASE WHEN error IS NOT NULL THEN 'FAIL' WHEN modified THEN 'PASS' ELSE 'UNCHANGED' END AS status,
  modified, NOT expected AS extra, error, CASE WHEN error IS NULL AND modified AND advice THEN 1 ELSE 0 END AS warning_count FROM e)"""


@query(VALIDATED + " SELECT archive, path, format, status, modified, extra, error, warning_count FROM v")
def validate_modified(spark, sf_dir):
    return states.validated(base(spark, sf_dir), workspace(spark, sf_dir))


@query(VALIDATED + " SELECT count_if(modified) AS modified, count_if(status = 'UNCHANGED') AS unchanged, count_if(extra) AS extra, count_if(status = 'FAIL') AS failed, CAST(sum(warning_count) AS BIGINT) AS warnings, CASE WHEN count_if(status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v")
def validate_counters(spark, sf_dir):
    return states.validation_counts(states.validated(base(spark, sf_dir), workspace(spark, sf_dir)))


PREVIEW = f"""WITH {VERSIONS}, p AS (SELECT coalesce(f.archive || '/' || f.path, w.archive || '/' || w.path) AS path, CASE WHEN f.path IS NULL THEN 'novo — não incluído' WHEN w.path IS NULL THEN 'manter referência'
  WHEN w.sha256 = sha256(f.text) THEN 'igual' ELSE 'substituir' END AS state FROM files f FULL JOIN workspace w ON f.archive = w.archive AND f.path = w.path)"""


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat_ws("/", "archive", "path").alias("path")
    return states.folder_preview(files(spark, sf_dir).select(whole, F.sha2("content", 256).alias("sha256")), workspace(spark, sf_dir).select(whole, "sha256"))


@query(PREVIEW + " SELECT path, state FROM p")
def folder_preview(spark, sf_dir):
    return preview(spark, sf_dir)


@query(PREVIEW + " SELECT count_if(state = 'substituir') AS replacements, count_if(state = 'igual') AS unchanged, count_if(state = 'manter referência') AS retained, count_if(state = 'novo — não incluído') AS extras FROM p")
def preview_counters(spark, sf_dir):
    return states.preview_counts(preview(spark, sf_dir))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def extras_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return states.extras(o, table(spark, sf_dir, "customer").where("c_nationkey < 20"), ["c_custkey"]).select("o_orderkey")


@query("(SELECT name, 'missing' AS problem FROM (SELECT o_orderkey AS name FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem)) UNION ALL (SELECT name, 'extra' FROM (SELECT l_orderkey AS name FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders))")
def zip_member_mismatch(spark, sf_dir):
    return states.name_mismatch(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name")))


@query(f"""WITH {FILES}, p AS (SELECT archive, path, ordinal, sha256(text) AS h FROM files WHERE ordinal % 3 = 0)
SELECT archive, path, CASE WHEN archive = 'src3' THEN 'workspace not found' WHEN ordinal % 4 = 0 THEN 'entry not in the archive' WHEN ordinal % 5 = 0 THEN 'package was built for another original'
  WHEN ordinal % 7 = 0 THEN 'file is missing' WHEN ordinal % 11 = 0 THEN 'file was edited' WHEN ordinal % 13 = 0 THEN 'backup differs from the original' END AS failure FROM p""")
def apply_first_failure(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("h", F.sha2("content", 256))
    o = F.col("ordinal")
    package = f.where("ordinal % 3 = 0").select(F.upper("archive").alias("archive"), "path", F.col("h").alias("original_sha256"))
    w = f.where("archive != 'src3'").select("archive").distinct()
    e = f.where("ordinal % 4 != 0").select("archive", "path", F.when(o % 5 == 0, "x").otherwise(F.col("h")).alias("extracted_sha256"))
    c = f.where("ordinal % 7 != 0").select("archive", "path", F.when(o % 11 == 0, "x").otherwise(F.col("h")).alias("sha256"))
    b = f.where("ordinal % 13 = 0").select("archive", "path", F.lit("x").alias("sha256"))
    return states.apply_plan(package, w, e, c, b).withColumn("archive", F.lower("archive"))


@query(f"""WITH {FILES} SELECT archive, path, CASE WHEN ordinal % 7 = 0 THEN NULL WHEN ordinal % 11 = 0 THEN NULL WHEN ordinal % 2 = 0 THEN false WHEN ordinal % 3 = 0 THEN NULL ELSE true END AS needs_restore,
  CASE WHEN ordinal % 7 = 0 THEN 'file is missing' WHEN ordinal % 11 = 0 THEN 'file was edited later' WHEN ordinal % 2 = 0 THEN NULL WHEN ordinal % 3 = 0 THEN 'backup is missing or damaged' END AS conflict FROM files""")
def remove_needs_restore(spark, sf_dir):
    f, o = files(spark, sf_dir), F.col("ordinal")
    installed = f.select("archive", "path", F.lit("a").alias("original_sha256"), F.lit("b").alias("modified_sha256"))
    c = f.where("ordinal % 7 != 0").select("archive", "path", F.when(o % 11 == 0, "c").when(o % 2 == 0, "a").otherwise("b").alias("sha256"))
    return states.remove_plan(installed, c, f.where("ordinal % 3 != 0").select("archive", "path", F.lit("a").alias("sha256")))


@query("SELECT r_regionkey AS ordinal, lower(r_name) AS name, n.n_name AS workspace, n.n_name IS NULL AS missing FROM region LEFT JOIN nation n ON lower(n_name) = lower(r_name) UNION ALL SELECT 100 + n_nationkey, lower(n_name), n_name, false FROM nation")
def requested_order_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ordinal"), F.lower("r_name").alias("name")).unionByName(n.select((F.col("n_nationkey") + 100).alias("ordinal"), F.lower("n_name").alias("name")))
    return states.requested(names, n.select(F.col("n_name").alias("name")))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey FROM lineitem WHERE l_orderkey % 7 != 0)
SELECT l_orderkey, l_linenumber, min(problem) AS problem FROM (SELECT a.l_orderkey, a.l_linenumber, CASE WHEN a.l_orderkey % 7 = 0 THEN 'missing' WHEN a.l_orderkey % 10 = 0 THEN 'differs' END AS problem FROM a) WHERE problem IS NOT NULL GROUP BY 1, 2""")
def positional_identity(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    b = a.where("l_orderkey % 7 != 0").withColumn("l_suppkey", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_suppkey")))
    return states.identity_violations(a, b, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


ISSUES = {mode: f"""SELECT '{mode}' AS mode, count(*) AS checked, count_if(state IN ('modificado', 'inválido')) AS modified, count_if(state = 'inválido') AS invalid, count_if(state = 'não extraído') AS not_extracted,
  CAST(sum(blocked{soft}) AS BIGINT) AS blocking, CAST(sum(w + {also}) AS BIGINT) AS warnings, CASE WHEN sum(blocked{soft}) > 0 THEN 'FAIL' WHEN sum(w + {also}) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM i""" for mode, soft, also in (("strict", " + bad", "0"), ("experimental", "", "bad"))}  # fmt: skip


@query(REFRESHED + f""", i AS (SELECT state, CASE WHEN state IN ('ausente', 'novo', 'não verificado') THEN 1 ELSE 0 END AS blocked,
  CASE WHEN state = 'inválido' THEN 2 ELSE 0 END + CASE WHEN state IN ('modificado', 'inválido') AND length(path) % 2 = 0 THEN 1 ELSE 0 END AS bad, CASE WHEN length(path) % 3 = 0 THEN 1 ELSE 0 END AS w FROM s) {ISSUES['strict']} UNION ALL {ISSUES['experimental']}""")
def validation_summary_modes(spark, sf_dir):
    rows = states.refreshed(files(spark, sf_dir), recorded(spark, sf_dir), workspace(spark, sf_dir))
    rows = rows.withColumn("format", F.when(F.length("path") % 2 == 0, "UNKNOWN").otherwise("TXT")).withColumn("warnings", F.when(F.length("path") % 3 == 0, F.array(F.lit("duration changed"))))
    return states.issue_summaries(rows)


@query(f"WITH {FILES} SELECT archive, path, size FROM files WHERE archive NOT IN ('src1', 'src2') UNION ALL SELECT archive, path, size + 1 FROM files WHERE archive IN ('src1', 'src2')")
def partial_replace(spark, sf_dir):
    f = files(spark, sf_dir).select("archive", "path", "size")
    return states.replaced(f, f.where("archive in ('src1', 'src2')").withColumn("size", F.col("size") + 1))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def pending_batch(spark, sf_dir):
    return states.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(f"WITH {FILES} SELECT count_if(ordinal % 3 != 0) AS newly, count_if(ordinal % 3 = 0 AND ordinal % 2 != 0) AS already, count_if(ordinal % 6 = 0) AS restored FROM files")
def extract_tallies(spark, sf_dir):
    f = files(spark, sf_dir)
    return states.extraction_tallies(f, f.where("ordinal % 3 = 0"), f.where("ordinal % 2 = 0"))


@query("SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'")
def set_difference_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id").subtract(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"))


# ---- layout


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("archive"), F.col("turn").alias("ordinal"), F.octet_length("text").cast("long").alias("size"))


TURNS = "t AS (SELECT conv_id AS archive, turn AS ordinal, octet_length(encode(text)) AS size FROM conversations), o AS (SELECT *, 64 + coalesce(CAST(sum(size) OVER (PARTITION BY archive ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS \"offset\" FROM t)"


@query(f'WITH {TURNS} SELECT archive, ordinal, size, "offset" FROM o')
def running_offsets(spark, sf_dir):
    return layout.running_offsets(turns(spark, sf_dir), F.lit(64))


@query(f'WITH {TURNS} SELECT archive, ordinal, coalesce(lead("offset") OVER (PARTITION BY archive ORDER BY ordinal), 100000) - "offset" AS payload_size FROM o')
def lead_sizes(spark, sf_dir):
    return layout.sizes_from_offsets(layout.running_offsets(turns(spark, sf_dir), F.lit(64)), F.lit(100000)).select("archive", "ordinal", "payload_size")


@query(f'WITH {TURNS}, p AS (SELECT archive, ordinal, coalesce(lead("offset") OVER (PARTITION BY archive ORDER BY ordinal), 100000) - "offset" AS physical, size + 4 - CASE WHEN ordinal % 2 = 0 THEN 4 ELSE 8 END AS expected FROM o) SELECT * FROM p WHERE physical != expected')
def layout_mismatch(spark, sf_dir):
    e = layout.running_offsets(turns(spark, sf_dir), F.lit(64))
    e = e.withColumn("stored_size", F.col("size") + 4).withColumn("header_size", F.when(F.col("ordinal") % 2 == 0, 4).otherwise(8))
    return layout.body_mismatches(e, F.lit(100000)).select("archive", "ordinal", "physical", "expected")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE value < b")
def monotonic_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return layout.out_of_order(e, "user_id", "at", "value").select("event_id", "user_id")


@query("SELECT archive, ordinal FROM (SELECT conv_id AS archive, turn AS ordinal, turn * 2 // 3 AS s, lag(turn * 2 // 3) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL AND s != b + 1")
def sequence_gaps(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("sequence", F.floor(F.col("ordinal") * 2 / 3))
    return layout.sequence_gaps(t, "archive", "ordinal").select("archive", "ordinal")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_wins_dedup(spark, sf_dir):
    return layout.first_wins(files(spark, sf_dir), F.sha2(F.lower("text"), 256)).select(F.col("ordinal").alias("doc_id"))


@query("SELECT l_orderkey, count(*) AS entries, sha256(sha256(string_agg(sha256(l_linenumber || '|' || l_partkey || '|' || l_suppkey), chr(10) ORDER BY l_linenumber, sha256(l_linenumber || '|' || l_partkey || '|' || l_suppkey)))) AS identity_sha256 FROM lineitem GROUP BY 1")
def ordered_hash_identity(spark, sf_dir):
    return layout.identity(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_partkey", "l_suppkey"], "l_orderkey", "l_linenumber")


@query("""SELECT 'r' || r_regionkey AS id, 0 AS depth, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c' || c_custkey, 2, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def tree_lineage(spark, sf_dir):
    make = lambda t, k, key, up, parent, name: table(spark, sf_dir, t).select(F.concat(F.lit(k), F.col(key)).alias("id"), (F.concat(F.lit(up), F.col(parent)) if up else F.lit(None).cast("string")).alias("parent"), F.col(name).alias("name"))
    nodes = make("region", "r", "r_regionkey", "", "", "r_name").unionByName(make("nation", "n", "n_nationkey", "r", "n_regionkey", "n_name")).unionByName(make("customer", "c", "c_custkey", "n", "c_nationkey", "c_name"))
    return layout.lineage(nodes)


# ---- rasters


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("name"), F.explode("embedding").alias("x"))
    return e.select("name", F.pmod(F.floor(F.col("x").cast("double") * 8), F.lit(256)).cast("int").alias("value"))


CELLS = "c AS (SELECT CAST(label AS VARCHAR) AS name, CAST(((CAST(floor(CAST(x AS DOUBLE) * 8) AS BIGINT) % 256) + 256) % 256 AS INTEGER) AS value FROM (SELECT label, unnest(embedding) AS x FROM embeddings))"


@query(f"WITH {CELLS} SELECT name, value, count(*) AS pixel_count FROM c GROUP BY 1, 2 UNION ALL SELECT NULL, value, count(*) FROM c GROUP BY value")
def value_histogram(spark, sf_dir):
    return raster.histogram(cells(spark, sf_dir))


@query(f"WITH {CELLS}, h AS (SELECT name, value, count(*) AS n FROM c GROUP BY 1, 2) SELECT name, min(value) AS min_value, max(value) AS max_value, count(*) AS distinct_values, string_agg(value || ':' || n, ',' ORDER BY value) AS histogram FROM h GROUP BY name")
def raster_summary(spark, sf_dir):
    out = raster.summary(raster.histogram(cells(spark, sf_dir)))
    return out.withColumn("histogram", F.array_join(F.transform("histogram", lambda x: F.concat_ws(":", x.value, x["count"])), ","))


@query("""WITH v AS (SELECT event_id, ascii(event_type) AS value FROM events), h AS (SELECT *, value * 0.618033988749895::DOUBLE - floor(value * 0.618033988749895::DOUBLE) AS hue FROM v),
s AS (SELECT *, floor(hue * 6) AS sector, hue * 6 - floor(hue * 6) AS f FROM h)
SELECT event_id, value, CAST(round_even(255 * CASE sector WHEN 0 THEN 1 WHEN 1 THEN 1 - 0.78::DOUBLE * f WHEN 2 THEN 1 - 0.78::DOUBLE WHEN 3 THEN 1 - 0.78::DOUBLE WHEN 4 THEN 1 - 0.78::DOUBLE * (1 - f) ELSE 1 END, 0) AS INTEGER) AS red FROM s""")
def palette_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.ascii("event_type").alias("value"))
    return raster.coloured(e, raster.palette(spark)).select("event_id", "value", "red")


@query("SELECT p_partkey, least(p_size - 1, (p_partkey % 100) * p_size // 100) AS source FROM part")
def nearest_resize_index(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", raster.nearest(F.col("p_partkey") % 100, F.col("p_size"), 100).alias("source"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_size ELSE ((p_partkey % 256) * 115 + p_size * 141 + 128) >> 8 END AS blend, (p_size * (p_partkey % 256) + 32 * (255 - p_partkey % 256) + 127) // 255 AS grey FROM part")
def overlay_blend(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("long"), F.col("p_partkey") % 256
    return p.select("p_partkey", raster.blended(size, key, size % 5, 0.45).alias("blend"), raster.over_grey(size, key).alias("grey"))


@query("""WITH a AS (SELECT source AS name, array_agg(DISTINCT lang) AS x FROM documents GROUP BY 1), b AS (SELECT source AS name, array_agg(DISTINCT lang) AS y FROM documents WHERE doc_id % 20 = 1 OR lang = 'en' GROUP BY 1)
SELECT name, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS new_ids FROM a JOIN b USING (name) WHERE len(list_filter(x, lambda v: NOT list_contains(y, v))) > 0""")
def new_region_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), "lang", "doc_id")
    ids = lambda x: x.groupBy("name").agg(F.collect_set("lang").alias("region_ids"))
    return raster.new_regions(ids(d), ids(d.where("doc_id % 20 = 1 or lang = 'en'"))).withColumn("new_ids", F.array_join("new_ids", ","))


@query("""WITH r AS (SELECT p_brand AS folder, p_partkey || CASE p_partkey % 4 WHEN 0 THEN '_WIDE_FULL' WHEN 1 THEN '_h' WHEN 2 THEN '' ELSE '_NOTE' END AS stem, p_partkey % 4 AS k, p_partkey AS key FROM part),
p AS (SELECT folder, lower(stem) AS low, 0 AS pr FROM r WHERE key % 3 = 0 UNION ALL SELECT folder, CAST(key AS VARCHAR), 1 FROM r WHERE key % 5 = 0)
SELECT DISTINCT r.folder, r.stem, CASE WHEN key % 3 = 0 OR (k = 2 AND key % 5 = 0) THEN 0 ELSE 1 END AS priority FROM r WHERE key % 3 = 0 OR key % 5 = 0""")
def companion_priority(spark, sf_dir):
    k = F.col("p_partkey") % 4
    ending = F.when(k == 0, "_WIDE_FULL").when(k == 1, "_h").when(k == 2, "").otherwise("_NOTE")
    r = table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), F.concat(F.col("p_partkey"), ending).alias("stem"), "p_partkey")
    own = r.where("p_partkey % 3 = 0").select("folder", "stem", F.concat("stem", F.lit(".png")).alias("path"))
    bare = r.where("p_partkey % 5 = 0").select("folder", F.col("p_partkey").cast("string").alias("stem"), F.concat("p_partkey", F.lit(".PNG")).alias("path"))
    return raster.companions(r, own.unionByName(bare)).select("folder", "stem", "priority")


# ---- probing and comparing


@query("""WITH k AS (SELECT item_id AS priority, substr(text, 1, 40) AS literal FROM benchmark), h AS (SELECT doc_id, priority, position(literal IN text) AS place, row_number() OVER (PARTITION BY doc_id ORDER BY priority) AS n FROM documents, k WHERE contains(text, literal))
SELECT doc_id, priority, place FROM h WHERE n = 1""")
def cross_key_probe(spark, sf_dir):
    keys = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("priority"), F.substring("text", 1, 40).alias("literal"))
    return probing.first_key(table(spark, sf_dir, "documents"), keys, "doc_id", "text").withColumn("place", F.col("place").cast("long"))


@query("""WITH p AS (SELECT doc_id, hex(encode(text)) AS a, hex(encode(CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN text || 'x' WHEN doc_id % 4 = 2 THEN replace(text, 'q', 'k') ELSE substr(text, 1, 5) END)) AS b FROM documents),
l AS (SELECT *, least(length(a), length(b)) // 2 AS n FROM p),
d AS (SELECT *, CASE WHEN substr(a, 1, 2 * n) = substr(b, 1, 2 * n) THEN NULL ELSE list_filter(range(0, n), lambda i: substr(a, 2 * i + 1, 2) != substr(b, 2 * i + 1, 2))[1] END AS pos FROM l)
SELECT doc_id, coalesce(pos, CASE WHEN length(a) != length(b) THEN n END) AS first_difference, a = b AS identical FROM d""")
def binary_compare_first_diff(spark, sf_dir):
    k = F.col("doc_id") % 4
    other = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit("x"))).when(k == 2, F.replace("text", F.lit("q"), F.lit("k"))).otherwise(F.substring("text", 1, 5))
    return probing.first_difference(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("left"), other.alias("right"))).select("doc_id", "first_difference", "identical")


# ---- scalar functions


@query("SELECT doc_id, rtrim(regexp_replace(substr(hex(encode(text)), 1, 32), '(..)', '\\1 ', 'g')) AS header_hex FROM documents")
def hex_ascii_render(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", binary.hex_text(F.substring(F.col("text").cast("binary"), 1, 16)).alias("header_hex"))


@query("SELECT item_id, regexp_replace(text, '[^ -~]', '.', 'g') AS shown FROM benchmark WHERE octet_length(encode(text)) = length(text)")
def printable_text(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where(F.octet_length("text") == F.length("text"))
    return b.select("item_id", binary.printable(F.col("text").cast("binary")).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey + 2734385873) & 4294967295 AS stored_offset, (3887454712 + (((l_orderkey << 13) & 4294967295) | (l_orderkey >> 19)) + (l_orderkey & 4095)) & 4294967295 AS stored_size FROM lineitem")
def size_codec(spark, sf_dir):
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", binary.encode_offset(k).alias("stored_offset"), binary.encode_size(k).alias("stored_size"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)^\\s*\\[([^\\]\\r\\n]+)\\]', 1)) AS sections, len(regexp_extract_all(text, '(?m)^\\s*([^\\s=\\[\\];#][^=\\r\\n]*?)\\s*=', 1)) AS keys FROM documents")
def text_sections_keys(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(formats.sections(t)).cast("long").alias("sections"), F.size(formats.keys(t)).cast("long").alias("keys"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_manifest_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""WITH s AS (SELECT doc_id, octet_length(encode(text)) * (1 + doc_id % 7 * 1000) AS size FROM documents)
SELECT doc_id, size, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.2f KiB', round_even(size / 1024.0::DOUBLE, 2)) WHEN size < 1073741824 THEN printf('%.2f MiB', round_even(size / 1048576.0::DOUBLE, 2)) ELSE printf('%.2f GiB', round_even(size / 1073741824.0::DOUBLE, 2)) END AS shown FROM s""")
def human_bytes(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text") * (1 + F.col("doc_id") % 7 * 1000)).cast("long").alias("size"))
    return s.withColumn("shown", binary.human_size(F.col("size")))


@query("""WITH p AS (SELECT page_id, url AS path FROM pages UNION ALL SELECT -1 - doc_id, CASE doc_id % 6 WHEN 0 THEN 'a/../b' WHEN 1 THEN '/abs' WHEN 2 THEN 'a\\b' WHEN 3 THEN 'a//b' WHEN 4 THEN 'C:x' ELSE 'dir/f.txt' END FROM documents)
SELECT page_id, NOT (regexp_matches(path, '\\\\|^/|^[A-Za-z]:') OR regexp_matches(path, '(^|/)(\\.{1,2})?(/|$)')) AS relative FROM p""")
def path_safety(spark, sf_dir):
    k = F.col("doc_id") % 6
    odd = F.when(k == 0, "a/../b").when(k == 1, "/abs").when(k == 2, "a\\b").when(k == 3, "a//b").when(k == 4, "C:x").otherwise("dir/f.txt")
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path")).unionByName(table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("page_id"), odd.alias("path")))
    return p.select("page_id", paths.is_relative(F.col("path")).alias("relative"))


# ---- rules


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS w, p_partkey % 3 AS c FROM part), y AS (SELECT k, w, [0, 2, 4, 6][1 + k % 4] AS ct, CASE WHEN k % 5 = 0 THEN w + 1 ELSE w END AS nw, [4, 6, 0, 2][1 + (k + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) % 4] AS nct, CASE WHEN k % 11 = 0 THEN 16 ELSE 8 END AS nb FROM x)
SELECT k AS p_partkey, concat_ws('; ', CASE WHEN nw != w THEN 'dimensions changed' END, CASE WHEN nb != 8 THEN 'bit depth changed' END, CASE WHEN nct != ct AND abs(nct - ct) != 4 THEN 'color type changed' END) AS errors, CASE WHEN nct != ct AND abs(nct - ct) = 4 THEN 'alpha channel changed' ELSE '' END AS warnings FROM y""")
def compat_rules(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + at % 4).cast("int"))
    make = lambda w, b, c: F.struct(w.alias("width"), F.lit(1).alias("height"), b.alias("bit_depth"), F.lit(0).alias("interlace"), c.alias("color_type"))
    rows = table(spark, sf_dir, "part").select(
        k, make(F.col("p_size"), F.lit(8), pick((0, 2, 4, 6), k)).alias("old"),
        make(F.col("p_size") + F.when(k % 5 == 0, 1).otherwise(0), F.when(k % 11 == 0, 16).otherwise(8), pick((4, 6, 0, 2), k + F.when(k % 7 == 0, 1).otherwise(0))).alias("new"),
    )
    out = rules.compared(rows, rules.png)
    return out.select("p_partkey", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query("""SELECT * FROM (SELECT 'archive not declared' AS rule, count_if(source = 'src5') AS n FROM documents UNION ALL SELECT 'path', count_if(doc_id % 9 = 0) FROM documents UNION ALL SELECT 'member', count_if(doc_id % 8 = 0 OR doc_id % 9 = 0) FROM documents
UNION ALL SELECT 'size', count_if(doc_id % 10 = 0) FROM documents UNION ALL SELECT 'modified digest', count_if(doc_id % 12 = 0) FROM documents UNION ALL SELECT 'unchanged file', count_if(doc_id % 15 = 0 AND doc_id % 12 != 0) FROM documents) WHERE n > 0""")
def manifest_violations(spark, sf_dir):
    o = F.col("ordinal")
    f = files(spark, sf_dir)
    h = F.sha2("content", 256)
    package = f.select(
        "archive", F.when(o % 9 == 0, F.concat(F.lit("../"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        F.when((o % 8 == 0) | (o % 9 == 0), F.lit("elsewhere")).otherwise(F.concat_ws("/", F.lit("files"), "archive", "path")).alias("member"),
        F.when(o % 10 == 0, -1).otherwise(F.col("size")).alias("size_bytes"), h.alias("original_sha256"),
        F.when(o % 12 == 0, "none").when(o % 15 == 0, h).otherwise(F.sha2(F.concat("content", F.lit(b"!")), 256)).alias("modified_sha256"),
    )
    return rules.manifest_violations(package, f.where("archive != 'src5'").select(F.upper("archive").alias("name")).distinct())

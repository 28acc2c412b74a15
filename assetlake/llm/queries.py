"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import chat_format
from .decontamination import contamination
from .exact_dedup import exact_dedup
from .language_id import language_id
from .lm_scoring import cross_entropy_difference
from .mixing import mix
from .ngram_join import ngram_components
from .substring_dedup import substring_dedup
from .token_output import materialised, records
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format(table(spark, sf_dir, "conversations").select(own.columns).unionByName(own), streamed=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("offending")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(materialised(table(spark, sf_dir, "documents")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_output": op6_token_output,
    "op7_ngram_join": op7_ngram_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

ORACLES: dict[str, str] = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, CAST(least(10, len(w)) AS BIGINT) AS n FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bp),
dn AS (SELECT doc_id, w, n FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dn),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM dp),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op3_chat_format": r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_extract_all(text, '[<\[]\\*(<SYS>>|</SYS>>|\|start\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])')) AS escapes FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(9 + length(role) + 1 + length(text) + escapes + 7 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op7_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
n AS (SELECT doc_id, w, CAST(least(5, len(w)) AS BIGINT) AS k FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM n),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM p),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * c >= 75 * (zx.n + zy.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS doc_id, x AS b FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.b),
m AS (SELECT doc_id, min(b) AS component_id FROM r GROUP BY doc_id),
c AS (SELECT sg, min(doc_id) AS class_id FROM (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS sg FROM s GROUP BY doc_id) GROUP BY sg),
k AS (SELECT doc_id, class_id FROM (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS sg FROM s GROUP BY doc_id) JOIN c USING (sg))
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(k.class_id, d.doc_id) AS class_id
FROM d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op8_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
p AS (SELECT doc_id, list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' ')) AS v FROM d WHERE len(w) >= 20),
q AS (SELECT doc_id, unnest(v) AS win, unnest(range(1, len(v) + 1)) AS i FROM p),
x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM q),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM x WHERE n > 1),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT u.doc_id, u.i, word FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.i = u.i WHERE g.i IS NULL),
t AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(kept, 0) AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM d""",
    "op9_mixing": r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY key),
l AS (SELECT *, source_size * 3 AS cap, source_size * 3 / weight AS level FROM s),
f AS (
  SELECT *,
         sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY level, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM l),
c AS (SELECT *, cap <= weight * CAST(free AS DOUBLE) / open AS capped FROM f),
r AS (SELECT CAST(free AS DOUBLE) / open AS rate FROM c WHERE NOT capped ORDER BY level, key LIMIT 1),
t AS (
  SELECT key, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * rate END AS target
  FROM c LEFT JOIN r ON true),
x AS (SELECT key, CAST(length(bin(size)) AS BIGINT) AS class, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY 1, 2),
y AS (
  SELECT key, class, words, source_size, target,
         target - coalesce(CAST(sum(words) OVER down AS BIGINT), 0) * 3 AS free,
         sum(CAST(class AS DOUBLE) * words) OVER (PARTITION BY key) - coalesce(sum(CAST(class AS DOUBLE) * words) OVER down, 0) AS open
  FROM x JOIN t USING (key) WINDOW down AS (PARTITION BY key ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CASE WHEN open > 0 THEN free / open END AS rate, coalesce(class * CASE WHEN open > 0 THEN free / open END >= 3, false) AS full_ FROM y),
o AS (SELECT *, max_by(rate, class) FILTER (WHERE NOT full_) OVER (PARTITION BY key) AS level FROM v),
p AS (SELECT *, CASE WHEN full_ THEN 3.0::DOUBLE ELSE coalesce(class * level, 0) END AS times FROM o),
q AS (
  SELECT key, class, source_size, target, floor(times) AS whole, times - floor(times) AS part,
         target - sum(floor(times) * words) OVER (PARTITION BY key) AS need FROM p),
u AS (
  SELECT doc_id, sized.key AS key, size, source_size, target, whole, part, need,
         (CAST(('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN q ON q.key = sized.key AND q.class = length(bin(size))),
k AS (
  SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS rank FROM u),
w AS (SELECT *, sum(size) OVER (PARTITION BY key ORDER BY rank, doc_id) AS upto FROM k),
a AS (SELECT *, part > 0 AND upto <= need AS first_ FROM w),
b AS (SELECT *, need - coalesce(sum(size) FILTER (WHERE first_) OVER (PARTITION BY key), 0) AS gap1 FROM a),
e AS (SELECT *, part > 0 AND NOT first_ AND size <= gap1 AS fits FROM b),
h AS (SELECT *, sum(size) FILTER (WHERE fits) OVER (PARTITION BY key ORDER BY rank, doc_id) AS upto2 FROM e),
d AS (SELECT *, first_ OR (fits AND upto2 <= gap1) AS drawn FROM h),
g AS (SELECT *, gap1 - coalesce(sum(size) FILTER (WHERE drawn AND NOT first_) OVER (PARTITION BY key), 0) AS gap FROM d),
z AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY
    CASE WHEN part > 0 AND NOT drawn AND abs(gap - size) < gap THEN 0 ELSE 1 END, abs(gap - size), rank, doc_id) AS n
  FROM g)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN drawn OR (n = 1 AND part > 0 AND NOT drawn AND abs(gap - size) < gap) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM z""",
}

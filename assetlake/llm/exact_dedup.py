"""Exact deduplication by a heavy-hitter split.

Texts are compared by the SHA-256 of their text with each run of ASCII white
space replaced by one space. A Misra-Gries sketch (Spark's ``approx_top_k``,
a frequent-items summary of that family) names digests that may be frequent;
an exact count of just those digests, combined on the map side, verifies them (those of
no more than 1 / ``counters`` of all rows are put back) and finds their winners. The winners, ``heavy`` rows at most, are broadcast and
their copies are settled without a shuffle. All other digests are rare by the
sketch's guarantee (at most 3.5 / ``counters`` of all rows each) and take an
ordinary shuffle by digest.

Only DataFrame functions are used. The texts are read once: digests are written
to the shared folder and every later step works on ids and digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written

SPACE = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256); a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"))


def frequent(keys: DataFrame, heavy: int, counters: int) -> DataFrame:
    """At most ``heavy`` digests of ``keys`` that the sketch finds most frequent."""
    top = keys.agg(F.expr(f"approx_top_k(text_sha256, {int(heavy)}, {int(counters)})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1024, counters: int = 16384
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; of rows that repeat that id
    too, exactly one. Null ids sort last, so such a row stays only where its text
    has no other; null and empty texts form one group with each other only. An
    empty table gives no rows. Other columns are ignored.
    """
    keys = written(digests(docs, id_col, text_col).withColumn("at", F.monotonically_increasing_id()))
    least = max(1.0, keys.count() / counters)
    # the row that stays: of those with the smallest id any one, where all are nameless any one
    at = F.coalesce(F.min_by("at", "doc_id"), F.min("at")).alias("first")
    winners = written(
        keys.join(F.broadcast(frequent(keys, heavy, counters)), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), at)
        .where(F.col("group_size") > least)
    )
    first = Window.partitionBy("text_sha256").orderBy(F.col("doc_id").asc_nulls_last(), "at")
    whole = Window.partitionBy("text_sha256")

    settled = keys.join(F.broadcast(winners), "text_sha256").withColumn("kept", F.col("at") == F.col("first"))
    rest = (
        keys.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
        .withColumn("keep_id", F.min("doc_id").over(whole))
        .withColumn("group_size", F.count("*").over(whole))
        .withColumn("kept", F.row_number().over(first) == 1)
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return rest.select(columns).unionByName(settled.select(columns))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one of each text.

    Rows are told apart by id and text, so ids may repeat or be null; of rows equal in both that with the smallest
    hash of all columns stays.
    """
    found = exact_dedup(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
    marks = written(found.agg(F.max("kept").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))
    marked = own.join(marks, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    repeated = marked.where("stays").groupBy("_id", "_digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return marked.where("stays is null").select("row.*").unionByName(repeated.select("row.*"))

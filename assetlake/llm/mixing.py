"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words by its weight; a target stops at
``most`` times the source's size and the excess goes to the others by weight
(water filling). Within a source documents are wanted unequally: the expected
copies of a document are ``rate`` times the bit length of its size (long documents
are favoured, mildly; ``tilt`` is the power of that), and stop at ``most``; the rate is such
that the expected words meet the target (water filling again, over the classes of one
bit length, at most 64 a source).

Of its expected copies a document gets the whole ones for certain; the rest is the
inclusion probability of one more. That draw is Pareto order sampling: documents are
ranked by random odds divided by their own inclusion odds and taken in rank order while
the words stay within the target (a sample of fixed size, counted in words). Where a long document ends that
run early, the run goes on with those that are no larger than the words still missing; one
last document whose size is nearest to what is missing then closes the gap.

The random number is a hash of seed and id, so reruns agree. The rank at which a
source's target is met comes from two levels of histograms over (source, rank
bin), pre-aggregated on the map side, and a window over the rows of one last
bin, so that a source with a third of all rows never meets in one task. The
outcome is a plan of one row per source and class, applied to documents without a shuffle.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written

WORD = r"[^\x20\x09-\x0D]+"
#: Plans of at most this many rows are broadcast, larger ones joined by shuffle.
BROADCAST_ROWS = 20_000
BINS = 4096


def size_of(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and joins null with null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on seed and id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[float], most: int, tilt: float) -> DataFrame:
    """(key, class, source_size, target, whole, part, need): one row per source and class.

    The windows run over the summaries of one row per source, or class.
    """
    n = len(weights)
    order = Window.orderBy("key")
    by_level = Window.orderBy("level", "key")
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    one = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    classes = written(sizes.groupBy("key", "class").agg(F.sum("size").alias("words")))
    s = (
        classes.groupBy("key")
        .agg(F.sum("words").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("free", F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(below), F.lit(0)))
        .withColumn("open", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
        .withColumn("share", F.col("weight") * F.col("free") / F.col("open"))
        .withColumn("capped", F.col("cap") <= F.col("share"))
        # shares rise with each source that is capped; the first that is not sets the level of the rest
        .withColumn("rate", F.min(F.when(~F.col("capped"), F.struct("level", "key", (F.col("free") / F.col("open")).alias("rate")))).over(one)["rate"])
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rate")))
    ).select("key", "source_size", "target")
    mine, down = Window.partitionBy("key"), Window.partitionBy("key").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.pow(F.col("class").cast("double"), F.lit(float(tilt)))
    c = (
        classes.join(s, "key")
        .withColumn("wanted", wanted)
        .withColumn("mass", F.col("wanted") * F.col("words"))
        .withColumn("free", F.col("target") - F.coalesce(F.sum("words").over(down), F.lit(0)) * F.lit(most))
        .withColumn("open", F.sum("mass").over(mine) - F.coalesce(F.sum("mass").over(down), F.lit(0.0)))
        .withColumn("rate", F.when(F.col("open") > 0, F.col("free") / F.col("open")))
        .withColumn("capped", F.coalesce(F.col("wanted") * F.col("rate") >= F.lit(float(most)), F.lit(False)))
        .withColumn("rate", F.max(F.when(~F.col("capped"), F.struct("class", "rate"))).over(mine)["rate"])
        .withColumn("times", F.when(F.col("capped"), F.lit(float(most))).otherwise(F.coalesce(F.col("wanted") * F.col("rate"), F.lit(0.0))))
        .withColumn("whole", F.floor("times"))
        .withColumn("part", F.col("times") - F.col("whole"))
        .withColumn("need", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(mine))
    )
    return c.select("key", "class", "source_size", "target", "whole", "part", "need")


def _joined(rows: DataFrame, plan: DataFrame, small: bool, *on: str) -> DataFrame:
    return rows.join(F.broadcast(plan) if small else plan, list(on))


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds rank, random odds divided by the document's inclusion odds, and its bins."""
    u, p = F.col("u"), F.col("part")
    rows = rows.withColumn("rank", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))
    place = F.col("rank") / (1 + F.col("rank"))
    return rows.withColumn("bin1", F.floor(place * BINS)).withColumn("bin2", F.floor(place * BINS * BINS))


def _crossing(bins: DataFrame, more: str) -> DataFrame:
    """For each source the bin in which the words pass what it needs."""
    up = Window.partitionBy("key").orderBy("bin")
    hit = bins.withColumn("upto", F.sum("words").over(up)).where(F.col("upto") > F.col("need"))
    return hit.groupBy("key").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("b")).select("key", F.col("b.bin").alias(more), F.col("b.before").alias(f"before_{more}"))


def sized(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *more: str) -> DataFrame:
    """doc_id, key (of the source), size, class (bit length of the size) and the draw u of each document."""
    size = size_of(F.col(text_col)).alias("size")
    rows = docs.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("key"), size, *more)
    return rows.withColumn("class", F.length(F.bin("size")).cast("long")).withColumn("u", draw(F.col("doc_id"), seed))


def mix_plan(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, tilt: float = 1.0) -> DataFrame:
    """One row per source and class of ``sized`` documents: key, class, source_size, target, whole, part, and per source where the two
    runs end (``_prefix``), the gap between them, closing (id of the document that closes the last gap)."""
    plan = written(targets(sizes, weights, most, tilt))
    small = plan.count() <= BROADCAST_ROWS
    drawn = _ranked(_joined(sizes, plan, small, "key", "class").where("part > 0")).select("key", "doc_id", "size", "rank", "bin1", "bin2", "need")
    one = _prefix(drawn, "a", small)
    cut = written(plan.groupBy("key").agg(F.first("need").alias("need")).join(one, "key", "left").withColumn("gap", F.col("need") - F.coalesce("words_a", F.lit(0))).drop("words_a"))
    # the same once more with the rest, less what is larger than the words still missing
    rest = _joined(drawn.drop("need"), cut, small, "key").where(~_inside("a") & (F.col("size") <= F.col("gap")))
    two = _prefix(rest.withColumn("need", F.col("gap")), "b", small)
    cut = written(cut.join(two, "key", "left").withColumn("last", F.col("gap") - F.coalesce("words_b", F.lit(0))).drop("words_b", "need"))
    state = _joined(drawn.drop("need"), cut, small, "key")
    off = F.abs(F.col("last") - F.col("size"))
    closing = state.where(~_is_drawn() & (off < F.col("last"))).groupBy("key").agg(F.min(F.struct(off.alias("off"), "rank", "doc_id"))["doc_id"].alias("closing"))
    return written(plan.drop("need").join(cut.drop("last").join(closing, "key", "left"), "key", "left"))


def _prefix(rows: DataFrame, name: str, small: bool) -> DataFrame:
    """The longest run of each source's rows in the order of their rank that needs no more words than ``need``: the bins
    in which the words pass it, rank and id of the last row within, and the words of all. One row a source that has rows."""
    at1, at2 = f"at1_{name}", f"at2_{name}"

    def bins(rows: DataFrame, by: str) -> DataFrame:
        return rows.groupBy("key", F.col(by).alias("bin")).agg(F.sum("size").alias("words"), F.first("need").alias("need"))

    whole = written(bins(rows, "bin1"))
    first = _crossing(whole, at1)
    inside = _joined(rows, first, small, "key").where(F.col("bin1") == F.col(at1)).withColumn("need", F.col("need") - F.col(f"before_{at1}"))
    second = _crossing(bins(inside, "bin2"), at2)
    last_bin = _joined(inside, second, small, "key").where(F.col("bin2") == F.col(at2))
    upto = Window.partitionBy("key").orderBy("rank", "doc_id")  # a range: rows of one id go together
    taken = (
        last_bin.withColumn("upto", F.col(f"before_{at2}") + F.sum("size").over(upto))
        .where(F.col("upto") <= F.col("need"))
        .groupBy("key")
        .agg(F.max(F.struct("rank", "doc_id")).alias(f"within_{name}"), F.max("upto").alias("fits"))
    )
    all_ = whole.groupBy("key").agg(F.sum("words").alias("all"))
    words = F.when(F.col(at1).isNull(), F.col("all")).otherwise(F.col(f"before_{at1}") + F.coalesce("fits", F.col(f"before_{at2}"), F.lit(0)))
    return all_.join(first, "key", "left").join(second, "key", "left").join(taken, "key", "left").select("key", at1, at2, f"within_{name}", words.alias(f"words_{name}"))


def _inside(name: str) -> Column:
    """A row is in a run if its bin lies below the crossing one, or it fits inside that."""
    here, at1, at2 = F.struct("rank", "doc_id"), F.col(f"at1_{name}"), F.col(f"at2_{name}")
    return (
        F.when(at1.isNull(), F.lit(True))
        .when(F.col("bin1") != at1, F.col("bin1") < at1)
        .when(F.col("bin2") != at2, F.col("bin2") < at2)
        .otherwise(F.coalesce(here <= F.col(f"within_{name}"), F.lit(False)))
    )


def _is_drawn() -> Column:
    return _inside("a") | ((F.col("size") <= F.col("gap")) & _inside("b"))


def with_copies(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` documents with source_size, target and copies by the plan."""
    joined = _ranked(_joined(sizes, plan, plan.count() <= BROADCAST_ROWS, "key", "class"))
    closes = F.coalesce(F.col("doc_id") == F.col("closing"), F.lit(False))
    extra = F.when(F.col("part") > 0, (_is_drawn() | closes).cast("long")).otherwise(F.lit(0))
    return joined.withColumn("copies", F.col("whole") + extra)


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: str = "mix", tilt: float = 1.0) -> DataFrame:
    """The rows of the mix with the columns of ``docs`` (doc_id, text, source, ...), each as often as it is taken."""
    own = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    plan = mix_plan(written(sized(docs.select("doc_id", "text", "source"), seed)), weights, most, tilt)
    out = with_copies(sized(own, seed, "doc_id", "text", "source", "row"), plan)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return out.where("copies > 0").withColumn("copy", copies).select("row.*")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: str = "mix", tilt: float = 1.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted).

    Null texts have size 0; a null source is a source of its own, sorted last; rows
    that repeat an id share its draw; a null id draws like any other value. Sources
    without words have target 0. Other columns are ignored; an empty table gives no rows.
    """
    sizes = written(sized(docs.select("doc_id", "source", "text"), seed))  # texts are read once
    out = with_copies(sizes, mix_plan(sizes, weights, most, tilt))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

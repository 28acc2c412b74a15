"""Keys tried in order, and bytes compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cuts import written

#: Keys that a task holds at once.
KEYS_AT_ONCE = 10_000
#: Keys up to which each is looked for by itself.
FEW = 64
BLOCK = 1 << 20


def first_key(texts: DataFrame, keys: DataFrame, by: str, text: str, at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """(by, priority, place) of the first key in order (of priority, then literal) that each text holds; place from 1.

    keys: priority, literal. Up to ``at_once`` keys are held by tasks, as an automaton if they are many; more are tried in
    turns of as many, each with the texts that hold none of the keys before. A null key is in no text.
    """
    order = keys.where("literal is not null and priority is not null").select("priority", "literal").distinct()
    total = order.count()
    if total <= at_once:
        return _tried(texts.select(by, text), _sorted(order), by, text).select(by, "priority", "place")
    numbered = written(ordered(order, "priority", "literal"))
    rest, out = written(texts.select(by, text).where(F.col(text).isNotNull())), None
    for k in range(-(-total // at_once)):
        turn = written(_tried(rest, _sorted(numbered.where(F.floor((F.col("ordinal") - 1) / at_once) == k)), by, text, left=True))
        hit = turn.where("priority is not null").select(by, "priority", "place")
        out = hit if out is None else out.unionByName(hit)
        rest = turn.where("priority is null").select(by, text)
    return out


def _sorted(keys: DataFrame) -> list[tuple]:
    """At most ``at_once`` keys, which the caller has counted."""
    return sorted((r.priority, r.literal) for r in keys.collect())


def _tried(texts: DataFrame, keys: list[tuple], by: str, text: str, left: bool = False) -> DataFrame:
    kind = "struct<priority:long,place:long>"
    words = [w for _, w in keys]
    made: list = []

    def finder():
        if len(words) > FEW and "" not in words:
            try:
                import ahocorasick
            except ImportError:
                pass
            else:
                automaton = ahocorasick.Automaton()
                for rank, w in reversed(list(enumerate(words))):  # of equal keys the first stays
                    automaton.add_word(w, rank)
                automaton.make_automaton()
                return lambda t: min((rank for _, rank in automaton.iter(t)), default=None)
        return lambda t: next((rank for rank, w in enumerate(words) if w in t), None)

    def look(column: pa.Array) -> pa.Array:
        if not made:
            made.append(finder())
        out = []
        for t in column:
            rank = made[0](t.as_py()) if t.is_valid else None
            out.append(None if rank is None else {"priority": keys[rank][0], "place": t.as_py().find(words[rank]) + 1})
        return pa.array(out, pa.struct([("priority", pa.int64()), ("place", pa.int64())]))

    look.__annotations__ = {"column": pa.Array, "return": pa.Array}
    hit = F.arrow_udf(look, kind)(F.col(text)).alias("hit")
    rows = texts.select(by, text, hit)
    rows = rows if left else rows.where("hit is not null")
    return rows.select(by, text, "hit.priority", "hit.place")


def ordered(rows: DataFrame, *order, name: str = "ordinal") -> DataFrame:
    """Rows with their place from 1 in an order (names or columns), numbered by ranges.

    Rows are dealt by ranges of the order and written with their range; counts of the ranges, one row each,
    carry the numbers on, so that no task sees more than a range.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = written(rows.repartitionByRange(*columns).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*columns))
    out = ranged.join(F.broadcast(counts.select("_range", ahead.alias("_ahead"))), "_range")
    return out.withColumn(name, F.col("_ahead") + inside).select(*rows.columns, name)


def first_difference(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Adds identical and first_difference (from 0; the shorter length if one continues the other; null if equal or either is null).

    Values are compared as bytes, in blocks up to the first that differs.
    """
    kinds = dict(pairs.dtypes)
    sides = [F.encode(c, "UTF-8") if kinds[c] == "string" else F.col(c) for c in (left, right)]

    def place(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([_difference(x.as_buffer(), y.as_buffer()) if x.is_valid and y.is_valid else None for x, y in zip(a, b, strict=True)], pa.int64())

    place.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    out = pairs.withColumn("first_difference", F.arrow_udf(place, "long")(*sides))
    same = F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), F.col("first_difference").isNull())
    return out.withColumn("identical", same)


def _difference(a: pa.Buffer, b: pa.Buffer) -> int | None:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    for k in range(0, n, BLOCK):
        differs = x[k : min(n, k + BLOCK)] != y[k : min(n, k + BLOCK)]
        if differs.any():
            return k + int(differs.argmax())
    return None if len(x) == len(y) else n


def find_bytes(files: DataFrame, keys: list[tuple[str, bytes]], content: str = "content") -> DataFrame:
    """path, key, place (from 0): the first of a few byte strings, in their order, that each file holds.

    The search is on two hexadecimal digits and a space a byte, so that only whole bytes match.
    """
    spaced = F.regexp_replace(F.hex(content), "(..)", "$1 ")
    rows = files.select("path", spaced.alias("h"))
    out = None
    for name, raw in keys:
        at = F.instr("h", raw.hex(" ").upper() + " ")
        hit = F.struct(F.lit(name).alias("key"), ((at - 1) / 3).cast("long").alias("place"))
        out = F.when(at > 0, hit) if out is None else out.when(at > 0, hit)
    return rows.select("path", out.alias("hit")).where("hit is not null").select("path", "hit.key", "hit.place")

"""Benchmark decontamination: hits of normalised test n-grams in training texts.

Texts and items are lower-cased (A-Z) and cut into words at every ASCII character
that is no letter or digit. A window is ``n`` consecutive words of an item; an
item with fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit.

The windows of a benchmark whose number is checked against ``most_windows`` are
broadcast as a sorted table of 64-bit hashes; documents are scanned in one pass
without a shuffle, and each hash that matches is verified against the words
themselves. A larger benchmark is joined by a shuffle on the window instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, written
from .words import ALNUM, Words, chunks, grams, inside, per_batch, signed

#: Windows that are broadcast at most; a task's table of them takes about 500 bytes each.
MOST_WINDOWS = 250_000
_WINDOWS = "item_id string, n int, hash long, words binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.int64()))])


def windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct windows: item_id (as text), n, hash, words (joined by one space)."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_pylist()
        rows: list[tuple] = []
        for w in chunks(batch.column(1), ALNUM, lower=True):
            h = w.hashes()
            for k in range(len(w)):
                a, b = w.first[k], w.first[k + 1]
                size = min(n, b - a)
                if size:
                    rows += [(ids[w.row + k], int(size), int(x), w.said(a + i, size)) for i, x in enumerate(signed(grams(h[a:b], size)))]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["item_id", "n", "hash", "words"])

    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), text_col).mapInArrow(per_batch(make), _WINDOWS).distinct()


class _Table:
    """Windows by length and hash."""

    def __init__(self, rows: pa.Table):
        self.by_n: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items: dict[tuple[int, int], dict[bytes, list[str]]] = {}
        for item, n, h, words in zip(*(rows.column(c).to_pylist() for c in ("item_id", "n", "hash", "words")), strict=True):
            self.items.setdefault((n, h), {}).setdefault(words, []).append(item)
        for n in sorted({n for n, _ in self.items}):
            h = np.sort(np.array([h for m, h in self.items if m == n], np.int64).view(np.uint64))
            marks = np.zeros(1 << 16, bool)
            marks[h >> np.uint64(48)] = True
            self.by_n[n] = h, marks

    def hits(self, w: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of each verified occurrence."""
        h = w.hashes()
        for n, (known, marks) in self.by_n.items():
            g = grams(h, n)
            at = np.flatnonzero(marks[g >> np.uint64(48)])
            k = np.searchsorted(known, g[at])
            at = at[(k < len(known)) & (known[np.minimum(k, len(known) - 1)] == g[at])]
            at = at[inside(w, n)[at]] if len(at) else at
            for i, x in zip(at.tolist(), signed(g[at]).tolist(), strict=True):
                if items := self.items[n, x].get(w.said(i, n)):
                    yield i, n, items


def _found(ids: pa.Array, w: Words, hits: Iterator[tuple[int, int, list[str]]]) -> pa.RecordBatch:
    """One row per text of the chunk."""
    n = len(w)
    edge = np.zeros(len(w.start) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for first, length, found in hits:
        edge[first] += 1
        edge[first + length] -= 1
        items.setdefault(int(np.searchsorted(w.first, first, "right")) - 1, set()).update(found)
    hit = np.cumsum(edge[:-1]) > 0
    upto = np.concatenate([[0], np.cumsum(hit)])
    n_hit = upto[w.first[1:]] - upto[w.first[:-1]]
    spans: list[list[int]] = [[] for _ in range(n)]
    for k in items:
        a, b = w.first[k], w.first[k + 1]
        turn = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
        spans[k] = np.stack([w.start[a + turn[::2]], w.end[a + turn[1::2] - 1]], 1).ravel() - w.offs[k]
    named = [sorted(items.get(k, ())) for k in range(n)]
    return pa.record_batch(
        [ids.slice(w.row, n).cast(pa.int64()), pa.array(w.counts), pa.array(n_hit), pa.array([len(x) for x in named], pa.int64()),
         pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]), pa.array(n_hit > 0), pa.array(spans, pa.list_(pa.int64()))],
        schema=_FOUND,
    )


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_windows: int = MOST_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the ids of
    the items found, sorted as strings and joined by commas), contaminated, spans (begin and
    end of each hit run, in bytes of the UTF-8 text).

    A null or empty text has no words and no hits; null or repeated ids keep their own
    rows; an item id of null reads as ''. An empty benchmark hits nothing.
    """
    bounded_batches(docs.sparkSession)
    table = written(windows(benchmark, n))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if table.count() > most_windows:
        return _scan_by_join(own, table)
    known = own.sparkSession.sparkContext.broadcast(table.toArrow())
    cache: list[_Table] = []

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(_Table(known.value))
        for w in chunks(batch.column(1), ALNUM, lower=True):
            yield _found(batch.column(0), w, cache[0].hits(w))

    return own.mapInArrow(per_batch(find), _spark(_FOUND))


def _spark(schema: pa.Schema) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def _key() -> Column:
    """Names a text by id and a hash of itself, so that repeated ids stay apart and null ids meet."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2(F.coalesce("text", F.lit("")), 256))


def _hits_by_join(named: DataFrame, table: DataFrame) -> DataFrame:
    """(key, hits, items) of the texts (key, text) that are hit, when the windows are too many to broadcast: documents'
    windows meet the benchmark's in a shuffle join on hash; pre-aggregated, a hit is (text, place, length)."""
    lengths = [r.n for r in table.select("n").distinct().collect()]  # n values at most

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w in chunks(batch.column(1), ALNUM, lower=True):
            h, text = w.hashes(), w.text_of()
            for m in lengths:
                at = np.flatnonzero(inside(w, m))
                if len(at):
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array(w.row + text[at])), pa.array(at - w.first[text[at]]), pa.array(np.full(len(at), m, np.int32)), pa.array(signed(grams(h, m)[at])), pa.array([w.said(i, m) for i in at], pa.binary())],
                        names=["key", "place", "n", "hash", "words"],
                    )

    places = named.select("key", "text").mapInArrow(per_batch(make), "key string, place long, n int, hash long, words binary")
    return places.join(table, ["n", "hash", "words"]).groupBy("key").agg(F.collect_set(F.struct("place", "n")).alias("hits"), F.collect_set("item_id").alias("items"))


def _placed(w: Words, hit: list, item: list) -> Iterator[tuple[int, int, list[str]]]:
    """As ``_Table.hits``, from the hits and items of the rows of a batch."""
    return ((int(w.first[k]) + x["place"], x["n"], item[w.row + k]) for k in range(len(w)) for x in hit[w.row + k] or ())


def _scan_by_join(own: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of ``scan`` by a shuffle join."""
    named = own.withColumn("key", _key())

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hit, item = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for w in chunks(batch.column(1), ALNUM, lower=True):
            yield _found(batch.column(0), w, _placed(w, hit, item))

    return named.join(_hits_by_join(named, table), "key", "left").select("doc_id", "text", "hits", "items").mapInArrow(per_batch(place), _spark(_FOUND))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The report without spans."""
    return scan(docs, benchmark, **options).drop("spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = 10, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents, or (mode 'span') without the hit words.

    All columns stay. Each row is judged by its own text, whatever its id. One pass over the documents, or for
    more than ``most_windows`` windows a shuffle join with the same rows.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"mode is 'document' or 'span', not {mode!r}")
    bounded_batches(docs.sparkSession)
    table = written(windows(benchmark, n))
    at = docs.columns.index("text")
    if table.count() > most_windows:
        named = docs.select(F.struct("*").alias("row"), _key().alias("key"), "text")
        joined = named.select("row", "key").join(_hits_by_join(named, table), "key", "left").select("row", "hits", "items")

        def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            hit, item = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield from _cleaned(pa.RecordBatch.from_struct_array(batch.column(0)), at, mode, lambda w: _placed(w, hit, item))

        return joined.mapInArrow(per_batch(cut), docs.schema)
    known = docs.sparkSession.sparkContext.broadcast(table.toArrow())
    cache: list[_Table] = []

    def clean(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(_Table(known.value))
        yield from _cleaned(batch, at, mode, cache[0].hits)

    return docs.mapInArrow(per_batch(clean), docs.schema)


def _cleaned(batch: pa.RecordBatch, at: int, mode: str, hits: Callable[[Words], Iterator[tuple[int, int, list[str]]]]) -> Iterator[pa.RecordBatch]:
    blank = pa.array(np.zeros(batch.num_rows, np.int64))
    found = [_found(blank, w, hits(w)) for w in chunks(batch.column(at), ALNUM, lower=True)]
    if not found:
        return
    report = pa.Table.from_batches(found)
    if mode == "document":
        yield batch.filter(pa.compute.invert(report["contaminated"].combine_chunks()))
        return
    texts = batch.column(at).to_pylist()
    for k, spans in enumerate(report["spans"].to_pylist()):
        if spans:
            raw = texts[k].encode()
            keep = [0, *spans, len(raw)]
            texts[k] = b"".join(raw[a:b] for a, b in zip(keep[::2], keep[1::2], strict=True)).decode()
    yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

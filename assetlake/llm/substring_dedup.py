"""Removal of repeated passages by seed and extend.

A window is ``length`` consecutive words of one document. Every word is removed
that a window covers whose word sequence also starts earlier (in a document with a
smaller id, or earlier in the same one); windows are judged on the input.

1. Seeds. Of the hashes of ``length // 2`` consecutive words, winnowing keeps the
   least of every ``length - length // 2 + 1`` neighbours, so that each window holds
   one seed at least and equal windows hold equal seeds at equal places. Seeds are
   dealt by hash; those that occur once are dropped.
2. Extend. Documents meet their repeated seeds (a shuffle by document) and extend
   each both ways to all windows that hold it. Windows are dealt by 64 bits of hash
   and compared on 96; all but the earliest of each are repeats.
3. Keep. Documents meet their repeated windows; overlapping windows merge into
   maximal repeats, whose words go.

Before every shuffle a batch combines what it has: of equal seeds or windows only
the earliest travels to the bucket of its hash, the others are known to be repeats
and go on to their documents. So a passage in a third of all documents sends one
row a batch and no group of occurrences meets in one task. Hashes and places travel
as compressed blobs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bucket_of, by_bucket, range_of, runs, unpack
from .session import bounded_batches
from .words import SPACED, Words, chunks, grams, inside, mixed, per_batch

#: Bytes of text whose seeds a bucket holds, about, and a batch combines.
BUCKET = 4 << 20
PART = 8 << 20
_DEALT = "bucket long, known boolean, n long, a binary, b binary, docs binary, places binary"
_PLACES = "to long, n long, docs binary, places binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _slide(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over each n neighbours, by doubling."""
    size, out = 1, x
    while size * 2 <= n:
        out = f(out[: len(out) - size], out[size:])
        size *= 2
    return f(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1]) if len(x) >= n else x[:0]


def seeds(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the winnowed seeds of a chunk."""
    k = length // 2
    near = length - k + 1
    g = grams(w.hashes(), k) >> np.uint64(16)
    valid = inside(w, length)
    if not valid.any():
        return np.zeros(0, np.int64), g[:0]
    least = np.where(valid, _slide(g, near, np.minimum)[: len(valid)] + np.uint64(1), np.uint64(0))
    pad = np.zeros(near - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), near, np.maximum)[: len(g)]
    at = np.flatnonzero(most == g + np.uint64(1))
    return at, g[at]


def windows(w: Words, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, two hashes) of the windows that hold a seed at one of the places."""
    k = length // 2
    h = w.hashes()
    g = grams(h, length)
    mark = np.zeros(len(h) + 1, np.int32)
    np.add.at(mark, np.maximum(at - (length - k), 0), 1)
    np.add.at(mark, at + 1, -1)
    p = np.flatnonzero((np.cumsum(mark)[: len(g)] > 0) & inside(w, length))
    half = grams(h, k)
    return p, g[p], mixed(half[p] ^ mixed(half[p + length - k])) & np.uint64(0xFFFFFFFF)


def _combined(a: np.ndarray, b: np.ndarray, doc: np.ndarray, place: np.ndarray, buckets: int, seed: bool) -> Iterator[pa.RecordBatch]:
    """What a batch sends of its seeds or windows: the earliest of each by bucket, the others as known repeats."""
    order = np.lexsort((place, doc, b, a))
    a, b, doc, place = a[order], b[order], doc[order], place[order]
    at = runs(a, b)
    size = np.diff(np.append(at, len(a)))
    lead = np.repeat(at, size)
    other = (doc != doc[lead]) | (place != place[lead])
    if seed:  # the earliest of a repeated seed is a repeat too, but goes to its bucket as well
        again = np.add.reduceat(other, at) > 0 if len(at) else np.zeros(0, bool)
        known = other | np.repeat(again, size)
    else:
        known = other
    for rows, told in ((at, False), (np.flatnonzero(known), True)):
        if not len(rows):
            continue
        # buckets by the hash's upper bits, so that hashes ascend within one
        bucket = bucket_of(doc[rows], buckets) if told else range_of(a[rows] >> np.uint64(0 if seed else 16), buckets)
        sort = np.argsort(bucket, kind="stable")
        rows, bucket = rows[sort], bucket[sort]
        x = np.zeros(len(rows), np.uint64) if told else a[rows]
        y = np.zeros(len(rows), np.uint64) if told else b[rows]
        if not told:
            step = np.concatenate([x[:1], x[1:] - x[:-1]])
            first = runs(bucket)
            step[first] = x[first]
            x = step
        key, n, blobs = by_bucket(bucket, x, y, doc[rows].view(np.uint64), place[rows].astype(np.uint64))
        yield pa.record_batch([pa.array(key), pa.array(np.full(len(key), told)), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in blobs)], names=["bucket", "known", "n", "a", "b", "docs", "places"])


def _dealt_seeds(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(batch.column(0))
        have, size = [], 0
        for w in chunks(batch.column(1), SPACED, lower=False):
            at, g = seeds(w, length)
            text = np.searchsorted(w.first, at, "right") - 1
            have.append((g, ids[w.row + text], at - w.first[text]))
            size += len(w.buf)
            if size > PART:
                yield from send(have)
                have, size = [], 0
        yield from send(have)

    def send(have: list) -> Iterator[pa.RecordBatch]:
        if sum(len(x[0]) for x in have):
            g, doc, place = (np.concatenate(x) for x in zip(*have, strict=True))
            yield from _combined(g, np.zeros(len(g), np.uint64), doc, place, buckets, seed=True)

    return docs.mapInArrow(per_batch(deal), _DEALT)


def _repeats(dealt: DataFrame, buckets: int, seed: bool) -> DataFrame:
    """Places of repeats by the bucket of their document: all of a repeated seed, or all but
    the earliest of a repeated window."""

    def find(key: tuple, table: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        fresh = []
        for known, n, a, b, d, p in zip(*(table.column(c).to_pylist() for c in ("known", "n", "a", "b", "docs", "places")), strict=True):
            doc, place = unpack(d, n).view(np.int64), unpack(p, n)
            if known:
                out.append((doc, place))
            else:
                fresh.append((np.cumsum(unpack(a, n), dtype=np.uint64), unpack(b, n), doc, place))
        if fresh:
            a, b, doc, place = (np.concatenate(x) for x in zip(*fresh, strict=True))
            order = np.lexsort((place, doc, b, a))
            a, b, doc, place = a[order], b[order], doc[order], place[order]
            at = runs(a, b)
            size = np.diff(np.append(at, len(a)))
            lead = np.repeat(at, size)
            again = np.repeat(size, size) > 1 if seed else (doc != doc[lead]) | (place != place[lead])
            out.append((doc[again], place[again]))
        doc, place = (np.concatenate(x) for x in zip(*out, strict=True))
        to = bucket_of(doc, buckets)
        order = np.lexsort((place, doc, to))
        key_, n, (d, p) = by_bucket(to[order], doc[order].view(np.uint64), place[order])
        return pa.table([pa.array(key_), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(p, pa.binary())], names=["to", "n", "docs", "places"])

    return dealt.groupBy("bucket").applyInArrow(find, _PLACES)


class _Places:
    """Places by document, of the blobs of one bucket."""

    def __init__(self, table: pa.Table):
        parts = list(zip(*(table.column(c).to_pylist() for c in ("n", "docs", "places")), strict=True))
        doc = np.concatenate([unpack(d, n) for n, d, _ in parts]).view(np.int64) if parts else np.zeros(0, np.int64)
        place = np.concatenate([unpack(p, n) for n, _, p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        order = np.lexsort((place, doc))
        self.doc, self.place = doc[order], place[order]

    def of(self, ids: pa.Array, w: Words) -> np.ndarray:
        """Word indexes in the chunk; places beyond a text's words are none of its own."""
        own = ids.slice(w.row, len(w))
        doc = np.asarray(own.fill_null(0))
        a, b = np.searchsorted(self.doc, doc), np.searchsorted(self.doc, doc, "right")
        b = np.where(np.asarray(own.is_valid()), b, a)
        text = np.repeat(np.arange(len(w)), b - a)
        k = np.arange(len(text)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        at = self.place[k]
        own = at < w.counts[text]
        return w.first[text[own]] + at[own]


def _dealt_windows(placed: DataFrame, found: DataFrame, length: int, buckets: int) -> DataFrame:
    def extend(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        places, have = _Places(left), []
        ids = right.column("doc_id").combine_chunks() if right.num_rows else pa.array([], pa.int64())
        for w in chunks(right.column("text"), SPACED, lower=False) if right.num_rows else ():
            p, a, b = windows(w, length, places.of(ids, w))
            text = np.searchsorted(w.first, p, "right") - 1
            have.append((a, b, np.asarray(ids.fill_null(0))[w.row + text], p - w.first[text]))
        batches = []
        if sum(len(x[0]) for x in have):
            a, b, doc, place = (np.concatenate(x) for x in zip(*have, strict=True))
            batches = list(_combined(a, b, doc, place, buckets, seed=False))
        return pa.Table.from_batches(batches, _schema(_DEALT))

    return found.groupBy("to").cogroup(placed.groupBy("to")).applyInArrow(extend, _DEALT)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def kept_text(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of a chunk, each with a space before it, and where each text's begin and end."""
    start, end = w.start[keep], w.end[keep]
    size = end - start + 1
    stop = np.cumsum(size)
    at = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size) + np.repeat(start, size) - 1
    out = w.buf[np.maximum(at, 0)]
    out[stop - size] = 0x20
    upto = np.concatenate([[0], stop])
    edge = np.concatenate([[0], np.cumsum(keep)])[w.first]
    return out, upto[edge]


def _removed(placed: DataFrame, found: DataFrame, length: int) -> DataFrame:
    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        places, batches = _Places(left), []
        ids = right.column("doc_id").combine_chunks() if right.num_rows else pa.array([], pa.int64())
        for w in chunks(right.column("text"), SPACED, lower=False) if right.num_rows else ():
            at = places.of(ids, w)
            mark = np.zeros(len(w.start) + length + 1, np.int32)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + length, -1)
            keep = np.cumsum(mark)[: len(w.start)] == 0
            text, edge = kept_text(w, keep)
            raw = text.tobytes()
            upto = np.concatenate([[0], np.cumsum(~keep)])[w.first]
            digest = [hashlib.sha256(raw[a + 1 : b]).hexdigest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            batches.append(pa.record_batch([ids.slice(w.row, len(w)), pa.array(w.counts), pa.array(np.diff(upto)), pa.array(digest), pa.array([raw[a + 1 : b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]))
        return pa.Table.from_batches(batches, _schema(_RESULT + ", kept string"))

    return found.groupBy("to").cogroup(placed.groupBy("to")).applyInArrow(remove, _RESULT + ", kept string")


def _placed(own: DataFrame, buckets: int) -> DataFrame:
    """Documents with the bucket that their id has, as ``bucket_of`` gives it."""

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array(bucket_of(np.asarray(batch.column(0).fill_null(0)), buckets)), *batch.columns], names=["to", "doc_id", "text"])

    return own.mapInArrow(per_batch(place), "to long, doc_id long, text string")


def substring_dedup(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay,
    joined by one space).

    Words are runs without ASCII white space, unchanged; null has none. Rows that repeat an
    id and its text are one document and all get its result. A row with a null id comes
    before and after no other: it removes and loses nothing. Other columns are ignored; an
    empty table gives no rows.
    """
    if length < 4:
        raise ValueError("a window has four words at least")
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(32, -(-size // BUCKET))
    placed = _placed(own, buckets)
    found = _repeats(_dealt_seeds(own.where("doc_id is not null"), length, buckets), buckets, seed=True)
    again = _repeats(_dealt_windows(placed, found, length, buckets), buckets, seed=False)
    return _removed(placed, again, length)

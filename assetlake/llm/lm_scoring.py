"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target set and of all documents (background), are matched:
one vocabulary, one list of bigrams, one smoothing, and background counts scaled to the
target's size. A document's score is the mean over its words of target loss minus
background loss, in nats: below 0 it looks more like the target than the corpus does.

Every word and every bigram of the corpus counts, however rare. So the tables grow with the corpus, and
are never gathered: documents are cut into batches, and a batch sends each distinct key (of a word or bigram) once,
with its counts, to the bucket of the key. There the counts of all batches are summed and the sums sent back
to each batch that asked, which is scored with them. Keys are 64-bit hashes, of which one bit tells words from bigrams.
Batches and sums are written in between, so that a batch stays the same.

Loss of w after v: -log((c(v, w) + m * p(w)) / (c(v) + m)), where
p(w) = (c(w) + a) / (total + a * (size of vocabulary + 1)), with m = 32 and a = 0.5.
A document's first word follows nothing and has loss -log p(w).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import by_bucket, pack, runs, unpack
from .session import bounded_batches, written
from .words import ALNUM, Words, chunks, grams, inside

#: Target ids that are broadcast at most; more are joined by a shuffle.
MOST_IDS = 4_000_000
#: Words after which a batch ends with the text.
SUMS = 1 << 19
#: Bytes of text for each bucket of keys.
BUCKET = 1 << 24
_M, _A = 32.0, 0.5
_PAIR = np.uint64(1)
_BATCHES = "batch long, n long, target_n long, docs binary"
_SENT = "batch long, bucket long, n long, keys binary, target binary, total binary"
_BACK = "batch long, bucket long, n long, target binary, total binary, known long, known_target long, known_total long"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])


def _keys(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each word, index of the words that follow another of their text, key of each such pair)."""
    h = w.hashes()
    at = np.flatnonzero(inside(w, 2)) + 1
    return h & ~_PAIR, at, grams(h, 2)[at - 1] | _PAIR


def _summed(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    a = runs(key)
    return key[a], *(np.add.reduceat(c[order], a) if len(a) else c for c in counts)


def _batches(docs: DataFrame, sums: int) -> DataFrame:
    """Batches of whole documents (target, doc_id, text), as streams of chunks; of the n words target_n are in the target."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size, mine = [], 0, 0
        for batch in batches:
            flag = np.asarray(batch.column(0)).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
            for w in chunks(batch.column(2), ALNUM, lower=True):
                held.append(batch.slice(w.row, len(w)))
                size += len(w.start)
                mine += int((w.counts * flag[w.row : w.row + len(w)]).sum())
                if size >= sums:
                    yield whole(number, size, mine, held)
                    number, held, size, mine = number + 1, [], 0, 0
        if held:
            yield whole(number, size, mine, held)

    def whole(number: int, size: int, mine: int, held: list) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for x in held:
                out.write_batch(x)
        return pa.record_batch([pa.array([number]), pa.array([size]), pa.array([mine]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "n", "target_n", "docs"])

    return docs.select("target", "doc_id", "text").mapInArrow(cut, _BATCHES)


def _read(docs: bytes) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for b in pa.ipc.open_stream(docs):
        for w in chunks(b.column(2), ALNUM, lower=True):
            yield b, w


def _sent(texts: DataFrame, buckets: int) -> DataFrame:
    """For each batch and bucket n keys, ascending with the bucket, and their counts in the batch."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                have = []
                for b, w in _read(docs.as_py()):
                    one, at, two = _keys(w)
                    mine = np.asarray(b.column(0)).astype(np.int64)[w.row + w.text_of()]
                    have.append(_summed(np.concatenate([one, two]), np.concatenate([mine, mine[at]]), np.ones(len(one) + len(two), np.int64)))
                key, *counts = _summed(*(np.concatenate(x) for x in zip(*have, strict=True)))
                if len(key):
                    at, n, columns = by_bucket(((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), key, *counts)
                    yield pa.record_batch([pa.array([number] * len(n), pa.int64()), pa.array(at), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["batch", "bucket", "n", "keys", "target", "total"])

    return texts.select("batch", "docs").mapInArrow(send, _SENT)


def _answered(sent: DataFrame, least: float) -> DataFrame:
    """Sums over all batches for the keys each batch sent, in their order; a row of batch -1 for
    each bucket tells the number and the counts of its words that occur ``least`` times or more."""

    def meet(rows: pa.Table) -> pa.Table:
        n = rows["n"].to_pylist()
        key, mine, total = (np.concatenate([unpack(x, k) for x, k in zip(rows[c].to_pylist(), n, strict=True)]) for c in ("keys", "target", "total"))
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        a = runs(sorted_key)
        sums = [np.add.reduceat(c.view(np.int64)[order], a) for c in (mine, total)]
        size = np.diff(np.append(a, len(key)))
        each = np.empty((2, len(key)), np.int64)
        each[:, order] = np.repeat(np.stack(sums), size, axis=1)
        known = ((sorted_key[a] & _PAIR) == 0) & (sums[1] >= least)
        stop = np.cumsum(n)
        back = [[pack(c[q - k : q]) for q, k in zip(stop, n, strict=True)] for c in each]
        zero = [0] * len(n)
        columns = (
            [*rows["batch"].to_pylist(), -1], [*rows["bucket"].to_pylist(), 0], [*n, 0], [*back[0], None], [*back[1], None],
            [*zero, int(known.sum())], [*zero, int(sums[0][known].sum())], [*zero, int(sums[1][known].sum())],
        )
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["batch", "bucket", "n", "target", "total", "known", "known_target", "known_total"])

    return sent.groupBy("bucket").applyInArrow(meet, _BACK)


def flagged(docs: DataFrame, target_ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """(doc_id, target, text): target says whether the id is among ``target_ids``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    if ids.count() > most:
        return own.join(ids.withColumn("target", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")
    marks = F.broadcast(ids.withColumn("target", F.lit(True)))
    return own.join(marks, "doc_id", "left").select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, words: int | None = None, pairs: int | None = None, sums: int = SUMS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, target_loss, background_loss, score (means a word).

    Words are A-Z lower-cased runs of letters, digits and all beyond ASCII. Without words the
    losses and the score are 0. Without a target both models are the same but for size. A null
    id is in no target; other columns are ignored; an empty table gives no rows.

    All words and bigrams are known to the models. Only if a caller gives ``words`` (``pairs``) those that make up less
    than 1 / ``words`` (1 / ``pairs``) of all words are one unknown word (have no count).
    """
    bounded_batches(docs.sparkSession)
    own = flagged(docs, target_ids)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = written(_batches(own, sums))
    mine, all_ = texts.agg(F.coalesce(F.sum("target_n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = all_ / words if words else 1, all_ / pairs if pairs else 1
    back = written(_answered(_sent(texts, size // bucket + 1), least[0]))
    known, *kept = back.where("batch < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("known", "known_target", "known_total"))).first()
    scale = np.array([1.0, mine / all_ if all_ else 0.0])
    rest = np.maximum(np.array([mine, all_]) - np.array(kept), 0) * scale
    under = np.array([mine, all_]) * scale + _A * (known + 1)

    def score(batch: pa.Table, counts: pa.Table) -> pa.Table:
        n, order = counts["n"].to_pylist(), np.argsort(np.asarray(counts["bucket"].combine_chunks())) if counts.num_rows else []
        blobs = [counts[c].to_pylist() for c in ("target", "total")]
        found = np.stack([np.concatenate([unpack(b[k], n[k]) for k in order]) for b in blobs], 1).astype(float) if counts.num_rows else np.zeros((0, 2))
        parts = [(b, w, *_keys(w)) for x in batch["docs"].to_pylist() for b, w in _read(x)]
        keys, index = np.unique(np.concatenate([x for _, _, one, _, two in parts for x in (one, two)]), return_inverse=True)
        if len(keys) != len(found):
            raise RuntimeError(f"a batch asked for {len(found)} keys and has {len(keys)}")
        used, out = 0, []
        for b, w, one, at, two in parts:
            c, pair = found[index[used : used + len(one)]], found[index[used + len(one) : used + len(one) + len(two)]]
            used += len(one) + len(two)
            is_known = c[:, 1] >= least[0]
            c = np.where(is_known[:, None], c * scale, rest)
            p = (c + _A) / under
            seen = ((pair[:, 1] >= least[1]) & is_known[at] & is_known[at - 1])[:, None] * pair * scale
            p[at] = (seen + _M * p[at]) / (c[at - 1] + _M)
            total = np.concatenate([np.zeros((1, 2)), np.cumsum(-np.log(p), 0)])
            mean = (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(w.counts, 1)[:, None]
            out.append(pa.record_batch([b.column(1).slice(w.row, len(w)), pa.array(w.counts), pa.array(mean[:, 0]), pa.array(mean[:, 1]), pa.array(mean[:, 0] - mean[:, 1])], schema=_SCORES))
        return pa.Table.from_batches(out, _SCORES)

    counts = back.where("batch >= 0").select("batch", "bucket", "n", "target", "total").groupBy("batch")
    return texts.select("batch", "docs").groupBy("batch").cogroup(counts).applyInArrow(score, "doc_id long, n_words long, target_loss double, background_loss double, score double")

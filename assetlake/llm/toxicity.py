"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the
features it holds; the document's is their noisy-or, 1 - prod(1 - p): toxic if any
sentence is. Only documents are labelled; the gradient of the noisy-or likelihood
shares a document's label out to its sentences, so the fitted sentence scores also
say which sentences offend. A sentence without any kept feature has the fixed score ``CALM``,
so that the length of a clean document does not add up to toxicity.

Features are whole words and their beginnings of 3 to 6 bytes, lower-cased (A-Z). Spark
counts, over a bounded sample of labelled documents, in how many toxic and other
documents each occurs; those whose log odds of toxicity stand out are kept, ``most``
at most, and the sample's sentences, now a few numbers each, are fitted on the
driver. Scoring is one pass without a shuffle over whole texts with the kept features
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import runs
from .session import bounded_batches, written
from .words import ALNUM, Words, chunks, mixed, per_batch, signed

BEGINNINGS = (3, 4, 5, 6)
#: Score of a sentence without kept features.
CALM = 1e-8
#: A sentence ends at one of these bytes.
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x0D, *b".!?;|"]] = True


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, mod ``of``; a null id has remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(0))


def sentences(w: Words) -> np.ndarray:
    """For each word the number of its sentence in the chunk, from 0."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    stops = np.concatenate([[0], np.cumsum(_STOP[w.buf])])
    new = stops[w.start[1:]] != stops[w.end[:-1]]
    new |= np.diff(w.text_of()) > 0
    return np.concatenate([[0], np.cumsum(new)])


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) of all words of a chunk."""
    h = w.hashes()
    at, out = [np.arange(len(h))], [h]
    size = w.end - w.start
    for k in BEGINNINGS:
        long = np.flatnonzero(size >= k)
        x = np.zeros(len(long), np.uint64)
        for j in range(k):
            x = (x << np.uint64(8)) | w.buf[w.start[long] + j]
        at.append(long)
        out.append(mixed(x * np.uint64(8) + np.uint64(k)))
    return np.concatenate(at), np.concatenate(out)


class Model:
    """Weights of kept features (sorted by feature) and the weight of any sentence."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, base: float):
        self.keys, self.weights, self.base = keys, weights, base
        self.marks = np.zeros(1 << 20, bool)
        self.marks[keys >> np.uint64(44)] = True

    def found(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence of each word, then distinct pairs of sentence and kept feature)."""
        sentence = sentences(w)
        at, x = features(w)
        near = self.marks[x >> np.uint64(44)]
        at, x = at[near], x[near]
        k = np.searchsorted(self.keys, x)
        hit = (k < len(self.keys)) & (self.keys[np.minimum(k, max(0, len(self.keys) - 1))] == x) if len(self.keys) else np.zeros(len(x), bool)
        s, k = sentence[at[hit]], k[hit]
        order = np.lexsort((k, s))
        s, k = s[order], k[order]
        new = runs(s, k)
        return sentence, s[new], k[new]

    def scores(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each text, sentence of each word, score of each sentence)."""
        sentence, s, k = self.found(w)
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        z = self.base + np.bincount(s, self.weights[k], n)
        p = np.where(np.bincount(s, minlength=n) > 0, 1 / (1 + np.exp(-z)), CALM)
        text = np.zeros(n, np.int64)
        text[sentence] = w.text_of()
        return -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), len(w))), sentence, p


def fitted(bags: list[tuple[int, int, list[list[int]]]], n: int, start: np.ndarray, steps: int = 300, rate: float = 0.05, shrink: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights by Adam on the noisy-or likelihood.

    bags: (label, sentences without kept features, kept features of each other sentence).
    """
    y = np.array([b[0] for b in bags], float)
    empty = np.array([b[1] for b in bags], float)
    bag = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    inner = [s for b in bags for s in b[2]]
    owner = np.repeat(np.arange(len(inner)), [len(s) for s in inner])
    k = np.array([f for s in inner for f in s], np.int64)
    x = np.concatenate([start * 0.5, [-3.0]])
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = x[n] + np.bincount(owner, x[k], len(inner))
        calm = np.bincount(bag, np.logaddexp(0, z), len(bags)) + empty * CALM
        p = np.clip(-np.expm1(-calm), 1e-9, 1)
        pull = np.where(y > 0, (1 - p) / p, -1.0)
        dz = pull[bag] / (1 + np.exp(-z))
        d = np.concatenate([np.bincount(k, dz[owner], n), [dz.sum()]])
        d[:n] -= shrink * x[:n] * len(bags) ** 0.5
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        x = x + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        x[n] = min(x[n], -1.0)
    return x[:n], float(x[n])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most: int = 20_000, least: int = 3, sure: float = 3.0) -> Model:
    """Fits on at most ``sample`` labelled documents, those with the least hash of their id.

    docs (doc_id, text); labels (doc_id, toxic). Of several labels of an id the largest
    counts; null ids or labels count for nothing. Kept are features of ``least`` toxic documents at least
    whose log odds lie ``sure`` standard errors above 0, ``most`` at most.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"))

    def present(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        toxic = np.asarray(batch.column(0)).astype(np.int64)
        for w in chunks(batch.column(1), ALNUM, lower=True):
            at, x = features(w)
            text = w.text_of()[at]
            order = np.lexsort((text, x))
            x, text = x[order], text[order]
            new = runs(x, text)
            x, y = x[new], toxic[w.row + text[new]]
            a = runs(x)
            if len(a):
                n = np.diff(np.append(a, len(x)))
                yield pa.record_batch([pa.array(signed(x[a])), pa.array(n), pa.array(np.add.reduceat(y, a))], names=["feature", "n", "bad"])

    counts = rows.select("toxic", "text").mapInArrow(per_batch(present), "feature long, n long, bad long")
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    b, g = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5
    rest_b, rest_g = total.bad - F.col("bad") + 0.5, (total.n - total.bad) - (F.col("n") - F.col("bad")) + 0.5
    odds = F.log(b) - F.log(rest_b) - F.log(g) + F.log(rest_g)
    z = odds / F.sqrt(1 / b + 1 / g + 1 / rest_b + 1 / rest_g)
    kept = counts.where(F.col("bad") >= least).select("feature", odds.alias("odds"), z.alias("z")).where(F.col("z") >= sure)
    kept = kept.orderBy(F.desc("z"), "feature").limit(most).toArrow()  # most rows at most
    keys = np.asarray(kept["feature"].combine_chunks()).view(np.uint64) if kept.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    odds = np.asarray(kept["odds"].combine_chunks(), dtype=float)[order] if kept.num_rows else np.zeros(0)
    model = Model(keys[order], odds, -20.0)
    if not len(keys):
        return model
    known = docs.sparkSession.sparkContext.broadcast(model)

    def bags(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        toxic = batch.column(0).to_pylist()
        for w in chunks(batch.column(1), ALNUM, lower=True):
            sentence, s, k = known.value.found(w)
            text = w.text_of()
            n = np.bincount(text[runs(sentence)], minlength=len(w)) if len(sentence) else np.zeros(len(w), int)
            a = runs(s)
            first = np.searchsorted(sentence, s[a])
            per: list[list[list[int]]] = [[] for _ in range(len(w))]
            for t, lo, hi in zip(text[first], a, np.append(a, len(s))[1:], strict=True):
                per[t].append(k[lo:hi].tolist())
            empty = [int(m) - len(p) for m, p in zip(n, per, strict=True)]
            yield pa.record_batch([pa.array(toxic[w.row : w.row + len(w)], pa.int32()), pa.array(empty, pa.int64()), pa.array(per, pa.list_(pa.list_(pa.int64())))], names=["toxic", "empty", "inner"])

    # sample rows at most, a few numbers each
    got = rows.orderBy("doc_id", "toxic").select("toxic", "text").mapInArrow(per_batch(bags), "toxic int, empty long, inner array<array<long>>").toArrow()
    weights, base = fitted([(int(t > 0), e, i) for t, e, i in zip(got["toxic"].to_pylist(), got["empty"].to_pylist(), got["inner"].to_pylist(), strict=True)], len(keys), odds)
    return Model(model.keys, weights, base)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, offending): offending has begin and end, in bytes, of each sentence that scores 0.5
    or more. Null, empty and wordless texts score 0."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w in chunks(batch.column(1), ALNUM, lower=True):
            total, sentence, p = known.value.scores(w)
            spans: list[list[int]] = [[] for _ in range(len(w))]
            for s in np.flatnonzero(p >= 0.5):
                a, b = np.searchsorted(sentence, s), np.searchsorted(sentence, s, "right")
                t = int(np.searchsorted(w.first, a, "right")) - 1
                spans[t] += [int(w.start[a] - w.offs[t]), int(w.end[b - 1] - w.offs[t])]
            yield pa.record_batch([batch.column(0).slice(w.row, len(w)), pa.array(np.clip(total, 0, 1)), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "score", "offending"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(per_batch(score), "doc_id long, score double, offending array<long>")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, offending.

    Ids whose crc32 mod ``folds`` is 0 (and null ids) are held out of training. Without
    toxic labels every score is near 0. Other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learned = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    model = train(own.where("doc_id is not null"), learned.where(remainder(F.col("doc_id"), folds) != 0), **options)
    out = scored(own, model)
    held = (remainder(F.col("doc_id"), folds) == 0).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")

"""Language identification by a linear-chain conditional random field.

Every word gets a label, so code-switched text is labelled word by word. The score
of a label sums weights of the word's features (lexicon: the word itself; affixes:
its first and last two and three bytes; n-grams: each three bytes in it, with one
space before and after) and of learned transitions between neighbouring labels.
Marginals come from forward-backward over each sentence. A document's language has
the largest sum of marginals over its words; its score is their mean.

The field is fitted on the driver by gradient steps on its conditional likelihood,
on a bounded sample of ``per_language`` documents of each language on average (fewer where languages are many). Words
take their document's language as label; sentences of different languages are chained, so
that transitions learn to switch. Fitted weights are hashed into a table of fixed size and
broadcast; labelling is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import bounded_batches
from .toxicity import _STOP, remainder
from .words import Words, chunks, mixed, per_batch

#: Bytes of words: ASCII letters and all of non-ASCII letters.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: Rows of the table of weights.
TABLE = 1 << 16
_A_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def _row(x: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(x * np.uint64(8) + np.uint64(kind)) >> np.uint64(48)).astype(np.int64)


def _bytes(w: Words) -> np.ndarray:
    """The chunk's bytes with a space for each that is in no word, and one before and after."""
    out = np.full(len(w.buf) + 2, 0x20, np.uint8)
    word = LETTERS[w.buf]
    out[1:-1][word] = w.buf[word]
    return out


def word_features(w: Words) -> list[np.ndarray]:
    """Rows of the table for each word: lexicon and affixes."""
    h = w.hashes()
    size = w.end - w.start
    b = _bytes(w).astype(np.uint64)
    at, last = w.start + 1, w.end  # positions in b of a word's first and last byte
    eight, none = np.uint64(8), np.uint64(0)
    first2 = (b[at] << eight) | np.where(size > 1, b[np.minimum(at + 1, last)], none)
    first3 = (first2 << eight) | np.where(size > 2, b[np.minimum(at + 2, last)], none)
    last2 = (b[last] << eight) | np.where(size > 1, b[np.maximum(last - 1, at)], none)
    last3 = (last2 << eight) | np.where(size > 2, b[np.maximum(last - 2, at)], none)
    return [_row(h, 0), *(_row(x, k) for k, x in enumerate((first2, first3, last2, last3), 1))]


def trigrams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table row of three bytes around each byte; begin and end of the bytes of each word)."""
    b = _bytes(w).astype(np.uint64)
    before, after = b[:-2].copy(), b[2:].copy()
    before[w.start], after[w.end - 1] = 0x20, 0x20  # the neighbour in the chunk may be another text
    x = (before << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | after
    return _row(x, 6), w.start, w.end


def emissions(w: Words, table: np.ndarray) -> np.ndarray:
    """(words, labels) scores."""
    out = np.zeros((len(w.start), table.shape[1]), np.float32)
    if not len(out):
        return out
    for rows in word_features(w):
        out += table[rows]
    rows, a, b = trigrams(w)
    inside = np.stack([a, np.minimum(b, len(rows) - 1)], 1).ravel()
    each = np.add.reduceat(table[rows], inside, axis=0)[::2]
    ends = b >= len(rows)  # a word that ends the chunk: reduceat stopped one byte early
    if ends.any():
        each[ends] = [table[rows[x:]].sum(0) for x in a[ends]]
    return out + each


def chain_starts(w: Words) -> np.ndarray:
    """Index of the first word of each sentence, and the number of words."""
    if not len(w.start):
        return np.zeros(1, np.int64)
    stops = np.concatenate([[0], np.cumsum(_STOP[w.buf])])
    new = (stops[w.start[1:]] != stops[w.end[:-1]]) | (np.diff(w.text_of()) > 0)
    return np.append(np.flatnonzero(np.concatenate([[True], new])), len(w.start))


def forward_backward(e: np.ndarray, starts: np.ndarray, move: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each word, expected transitions and log of the partition function.

    e: scores of all words; starts: of chains, and the end; move: transition scores.
    All chains advance together, longest first, so that a step is one array operation.
    """
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    first, size = starts[:-1][order], size[order]
    peak = e.max(1, keepdims=True)
    weight = np.exp(e - peak)
    step = np.exp(move)
    alpha, scale = np.empty_like(weight), np.empty(len(e), weight.dtype)
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")  # chains longer than t
    for t in range(longest):
        at = first[: alive[t]] + t
        a = weight[at] if t == 0 else (alpha[at - 1] @ step) * weight[at]
        scale[at] = s = a.sum(1)
        alpha[at] = a / s[:, None]
    beta = np.ones_like(weight)
    total = np.zeros_like(step)
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        ahead = weight[at + 1] * beta[at + 1] / scale[at + 1, None]
        if pairs:
            total += (alpha[at].T @ ahead) * step
        beta[at] = ahead @ step.T
    out = alpha * beta
    return out / out.sum(1, keepdims=True), total, float(np.log(scale).sum() + peak.sum())


class Model:
    def __init__(self, names: list[str], table: np.ndarray, move: np.ndarray):
        self.names, self.table, self.move = names, table, move


def fit(texts: list[str], labels: list[str], steps: int = 25, rate: float = 0.15, shrink: float = 1e-3, seed: int = 7) -> Model:
    """A field for the languages of the labels, by Adam on the conditional likelihood."""
    names = sorted(set(labels))
    n = len(names)
    if not n:
        return Model([], np.zeros((TABLE, 0), np.float32), np.zeros((0, 0)))
    known = {x: i for i, x in enumerate(names)}
    y = np.array([known[x] for x in labels])
    rows, owner, gold, sentence = [], [], [], []
    words = 0
    for w in chunks(pa.array(texts, pa.string()), LETTERS, lower=True):
        m = len(w.start)
        at, a, b = trigrams(w)
        size = b - a
        rows += [x.astype(np.int32) for x in (*word_features(w), at[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())])]
        owner += [x.astype(np.int32) for x in (*[np.arange(m) + words] * 5, np.repeat(np.arange(m), size) + words)]
        gold.append(y[w.row + w.text_of()])
        sentence += [(words + p, words + q) for p, q in zip(chain_starts(w)[:-1], chain_starts(w)[1:], strict=True)]
        words += m
    if not words:
        return Model(names, np.zeros((TABLE, n), np.float32), np.zeros((n, n)))
    row, own, gold = np.concatenate(rows), np.concatenate(owner), np.concatenate(gold)
    # three sentences make a chain, in an order that mixes languages
    rng = np.random.default_rng(seed)
    mix = [sentence[k] for k in rng.permutation(len(sentence))]
    place = np.concatenate([np.arange(p, q) for p, q in mix])
    starts = np.append(np.concatenate([[0], np.cumsum([q - p for p, q in mix])[:-1]])[::3], words)
    gold_at = gold[place]
    link = np.ones(words, bool)
    link[starts[:-1]] = False
    want_move = np.bincount(gold_at[:-1][link[1:]] * n + gold_at[1:][link[1:]], minlength=n * n).reshape(n, n)
    del rows, owner
    seen = np.bincount(row, minlength=TABLE)
    used = np.flatnonzero(seen)
    row = (np.cumsum(seen > 0) - 1).astype(np.int32)[row]  # numbers of the rows in use
    want = np.stack([np.bincount(row, gold[own] == k, len(used)) for k in range(n)], 1)
    seen = seen[used][:, None]
    x, move = np.zeros((len(used), n)), np.zeros((n, n))
    state = [np.zeros_like(x), np.zeros_like(x), np.zeros_like(move), np.zeros_like(move)]
    for t in range(1, steps + 1):
        e = np.stack([np.bincount(own, x[row, k], words) for k in range(n)], 1)
        marginal = np.empty_like(e)
        m, got_move, _ = forward_backward(e[place], starts, move, pairs=True)
        marginal[place] = m
        got = np.stack([np.bincount(row, marginal[own, k], len(used)) for k in range(n)], 1)
        grads = ((want - got) / (seen + 5) - shrink * x, (want_move - got_move) / words)
        for i, (p, d) in enumerate(((x, grads[0]), (move, grads[1]))):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * d
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * d * d
            p += rate * (state[2 * i] / (1 - 0.9**t)) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**t)) + 1e-6)
    table = np.zeros((TABLE, n), np.float32)
    table[used] = x
    return Model(names, table, move)


def train(docs: DataFrame, per_language: int = 150, languages: int = 64, longest: int = 1 << 15, **options) -> Model:
    """Fits on about ``per_language`` documents of each lang, those with the least hash of their id.

    docs (doc_id, text, lang). Rows with a null in lang or text are not used; every other lang is learned. Beyond
    ``languages`` of them, documents of each become fewer with the square of their number, one at least, since the
    fit holds words times languages. At most twice that many of each (2 * per_language * languages in all, or
    2 of each if these are more) come to the driver, whole; none of more than ``longest`` bytes, but where a language has
    only such, its shortest. Weights take 256 kB a language.
    """
    bounded_batches(docs.sparkSession)
    u = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    over = F.greatest(F.octet_length("text"), F.lit(longest)).alias("over")
    own = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang", u.alias("u"), over)
    each = own.groupBy("lang").agg(F.count_if(F.col("over") == longest).alias("n"), F.min(F.struct("over", "u")).alias("first"))
    each = each.withColumn("most", F.greatest(F.lit(1.0), F.lit(float(per_language)) * F.least(F.lit(1.0), F.pow(F.lit(float(languages)) / F.count("*").over(Window.partitionBy()), 2))))
    chosen = own.join(F.broadcast(each), "lang").where(((F.col("over") == longest) & (F.col("u") * F.col("n") < F.col("most"))) | (F.struct("over", "u") == F.col("first")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("over", "u", "doc_id", F.xxhash64("text")))
    got = chosen.withColumn("place", place).where("place <= 2 * most").orderBy("u", "doc_id", "lang").select("lang", "text").toArrow()
    return fit(got["text"].to_pylist(), got["lang"].to_pylist(), **options)


def labelled(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, switches): switches counts neighbouring words of a sentence whose likeliest
    labels differ. Null texts and texts without a letter are `und` with score 0."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(per_batch(lambda batch: (x.select([0, 1, 2, 3]) for x in _labels(batch, known.value))), "doc_id long, lang_pred string, score double, switches long")


def _labels(batch: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    """Also sure: the mean over words of each word's own largest marginal, whichever languages these are."""
    texts = batch.column(1)
    n = len(model.names)
    for w in chunks(texts, LETTERS, lower=True):
        letter = np.array([bool(x) and _A_LETTER.search(x) is not None for x in texts.slice(w.row, len(w)).to_pylist()], bool)
        share, switches, sure = np.zeros((len(w), max(1, n))), np.zeros(len(w), np.int64), np.zeros(len(w))
        if n and len(w.start):
            starts = chain_starts(w)
            m, _, _ = forward_backward(emissions(w, model.table), starts, model.move.astype(np.float32))
            total = np.concatenate([np.zeros((1, n)), np.cumsum(m, 0, dtype=np.float64)])
            share = (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(w.counts, 1)[:, None]
            peak = np.concatenate([[0], np.cumsum(m.max(1), dtype=np.float64)])
            sure = (peak[w.first[1:]] - peak[w.first[:-1]]) / np.maximum(w.counts, 1)
            best = m.argmax(1)
            turn = np.concatenate([[False], best[1:] != best[:-1]])
            turn[starts[:-1]] = False
            upto = np.concatenate([[0], np.cumsum(turn)])
            switches = upto[w.first[1:]] - upto[w.first[:-1]]
        said = letter & (n > 0)
        top = share.argmax(1)
        names = [model.names[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), said.tolist(), strict=True)]
        score = np.where(said, np.clip(share[np.arange(len(w)), top], 0, 1), 0.0)
        yield pa.record_batch([batch.column(0).slice(w.row, len(w)), pa.array(names, pa.string()), pa.array(score), pa.array(switches), pa.array(np.where(said, sure, 0.0))], names=["doc_id", "lang_pred", "score", "switches", "sure"])


def language_id(docs: DataFrame, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, switches.

    Ids whose crc32 mod ``folds`` is ``held`` are held out of training. Without labels to
    learn from all is `und`. Other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(own.where(remainder(F.col("doc_id"), folds) != held), **options)
    out = labelled(own, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score", "switches")


def identified(docs: DataFrame, least: float = 0.4, **options) -> DataFrame:
    """The rows of ``docs`` that have a language: a letter, and words that are labelled with a
    mean certainty of ``least`` at least, so that text in several languages stays. One pass over the documents, with all their columns. Where no language can be learned a letter is enough."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(remainder(F.col("doc_id"), 3) != 1), **options)
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not known.value.names:
            yield batch.filter(pa.array([x is not None and _A_LETTER.search(x) is not None for x in batch.column(at).to_pylist()], pa.bool_()))
            return
        pair = pa.record_batch([pa.array(np.zeros(batch.num_rows, np.int64)), batch.column(at)], names=["doc_id", "text"])
        for out in _labels(pair, known.value):
            ok = [x != UNKNOWN and s >= least for x, s in zip(out.column(1).to_pylist(), out.column(4).to_pylist(), strict=True)]
            yield batch.slice(0, len(ok)).filter(pa.array(ok))
            batch = batch.slice(len(ok))

    return docs.mapInArrow(per_batch(keep), docs.schema)

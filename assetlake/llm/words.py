"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A text column is cut into chunks of about one megabyte of whole texts. In a
chunk, words are found from a table of word bytes and named by a 64-bit hash, so
that the cost is a few array passes over the bytes and not a Python step a word.
All separators used here are ASCII, so that byte positions in UTF-8 are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are words when only white space (\x20 \x09-\x0D) separates.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that are words when all ASCII but letters and digits separates.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

CHUNK = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = int(_rng.integers(1, 1 << 62)) * 8 + 5
_RINV = pow(_R, -1, 1 << 64)
_G = np.uint64(int(_rng.integers(1, 1 << 62)) * 8 + 3)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of R and of its inverse mod 2**64, n of them at least, of which ``spans`` needs CHUNK at most."""
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for k, base in enumerate((_R, _RINV)):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, m, 1 << 64))])
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = CHUNK) -> np.ndarray:
    """Hashes of spans of bytes, which ascend and do not overlap: polynomials over their bytes.

    The sums run over a block of bytes at a time, so that a text of any length needs no more than its spans.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = int(np.searchsorted(end, base + block, "right"))
        if j <= i:  # one span that is longer than a block
            out[i], j = _long(buf[base : end[i]], block), i + 1
        else:
            part = buf[base : end[j - 1]]
            up, down = (p[: len(part)] for p in _power(len(part)))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up, out=total[1:])
            a = start[i:j] - base
            out[i:j] = (total[end[i:j] - base] - total[a]) * down[np.minimum(a, len(part) - 1)]
        i = j
    return mixed(out)


def _long(part: np.ndarray, block: int) -> int:
    total = 0
    for k in range(0, len(part), block):
        piece = part[k : k + block]
        total += int((_BYTE[piece] * _power(len(piece))[0][: len(piece)]).sum(dtype=np.uint64)) * pow(_R, k, 1 << 64)
    return total & ((1 << 64) - 1)


class Words:
    """The words of one chunk of texts.

    buf: the bytes; offs: where each text begins, and the end; start, end: of each
    word; first: for each text the index of its first word, and the number of words.
    """

    def __init__(self, row: int, buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
        self.row, self.buf, self.offs = row, buf, offs
        word = table[buf]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        edges = offs[(offs > 0) & (offs < len(buf))]
        opens[edges] |= word[edges]
        closes[edges - 1] |= word[edges - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.offs) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return spans(self.buf, self.start, self.end)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self)), self.counts)

    def said(self, first: int, n: int) -> bytes:
        """n words from the first on, joined by one space."""
        spans = zip(self.start[first : first + n], self.end[first : first + n], strict=True)
        return b" ".join(self.buf[a:b].tobytes() for a, b in spans)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, at each word that has n - 1 after it in the array."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= _G
        out += h[j : len(h) - n + 1 + j]
    return mixed(out + np.uint64(n))


def inside(w: Words, n: int) -> np.ndarray:
    """Which of ``grams(h, n)`` lie within one text."""
    size = max(0, len(w.start) - n + 1)
    left = np.repeat(w.first[1:], w.counts)[:size] - np.arange(size)
    return left >= n


def chunks(column: pa.Array, table: np.ndarray, lower: bool, limit: int = CHUNK) -> Iterator[Words]:
    """Chunks of the texts of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        stop = min(stop, n, row + (1 << 16))
        buf = data[offs[row] : offs[stop]]
        yield Words(row, LOWER[buf] if lower else buf, offs[row : stop + 1] - offs[row], table)
        row = stop


def per_batch(f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: f over each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(batch)
            del batch
            pa.default_memory_pool().release_unused()

    return run


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return h.view(np.int64)

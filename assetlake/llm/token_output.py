"""Training-order materialisation of token sequences.

1. Documents are dealt by ranges of (doc_id, hash of the text) and sorted, so that each has a place that does not depend
   on files, splits or cores. They become token ids (a public byte-level BPE vocabulary) and an end mark,
   cut into sequences of at most ``length``. Sequences are written once, each with its place
   (range, count within the range).
2. A keyed Feistel network with cycle-walking, a permutation of 0..N-1 that needs no
   table, gives the sequence at place i its global slot. Places are made global by the
   counts of the ranges, one row each.
3. Slots are dealt by range: a shard holds ``per_shard`` consecutive slots as records of
   one fixed stride, padded with the end mark, so slot s lies in shard s div per_shard at byte
   (s mod per_shard) * stride. A task sorts a range of slots and writes its shards as they stream past. A reader goes
   through shards in order, and resumes at any slot, without an index.

The order depends on key and documents only. Tokens are computed once; no step holds more than a shard.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import bounded_batches, written
from .words import Words, chunks, mixed, per_batch, spans

#: Where the vocabulary files lie unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's own text splitting is defined.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: doc_id, number of the sequence in its document, tokens that are no padding.
HEADER = np.dtype([("doc_id", "<i8"), ("chunk", "<u4"), ("n", "<u4")])
#: Pieces whose tokens a task remembers, about.
_KNOWN = 400_000
_ANY = np.ones(256, bool)
_SEQUENCES = "task long, place long, doc_id long, chunk long, n long, tokens binary"
_SHARDS = "shard long, first_slot long, n_sequences long, stride long, data binary"


class Tokenizer:
    """Token ids of many texts at once.

    Text is cut before each space that stands alone between characters other than white space, where the vocabulary's own
    splitting cuts too, so that pieces may be encoded apart or in any order. Each distinct piece is encoded once, many in
    one call; pieces in use stay known, in arrays of a bounded size.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = max(ranks.values()) + 1
        if self.end >= 1 << 16:
            raise ValueError("sequences hold 16-bit ids; the vocabulary has more")
        self.bytes_of = np.zeros(self.end, np.int64)
        self.bytes_of[list(ranks.values())] = [len(x) for x in ranks]
        self.names, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint16)

    def __call__(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts of a chunk, index of each text's first token and the end)."""
        buf, offs = w.buf, w.offs
        if not len(buf):
            return np.zeros(0, np.uint16), np.zeros(len(offs), np.int64)
        bare = ~((buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D)) | _wide_space(buf))
        cut = np.zeros(len(buf), bool)
        cut[1:-1] = (buf[1:-1] == 0x20) & bare[:-2] & bare[2:]
        opens = offs[:-1][offs[:-1] < len(buf)]
        cut[opens] = True
        at = np.flatnonzero(cut)
        stop = np.append(at[1:], len(buf))
        name = spans(buf, at, stop)
        distinct, first, which = np.unique(name, return_index=True, return_inverse=True)
        place = self._known(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            k = first[new]
            # those that begin with a lone space and end with no white space may stand side by side
            inner = (buf[at[k]] == 0x20) & bare[np.minimum(at[k] + 1, len(buf) - 1)] & bare[stop[k] - 1]
            self._learn(buf, distinct[new[inner]], at[k[inner]], stop[k[inner]], True)
            self._learn(buf, distinct[new[~inner]], at[k[~inner]], stop[k[~inner]], False)
            place = self._known(distinct)
        self.used[place] += np.bincount(which, minlength=len(distinct))
        n = self.size[place][which]
        upto = np.cumsum(n)
        tokens = self.store[np.arange(upto[-1]) - np.repeat(upto - n - self.begin[place][which], n)]
        if len(self.names) > _KNOWN:
            self._forget()
        return tokens, np.concatenate([[0], upto])[np.searchsorted(at, offs)]

    def _known(self, names: np.ndarray) -> np.ndarray:
        """Where each name stands among the known ones, or -1."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, -1)

    def _learn(self, buf: np.ndarray, names: np.ndarray, at: np.ndarray, stop: np.ndarray, together: bool) -> None:
        if not len(names):
            return
        length = stop - at
        upto = np.cumsum(length)
        text = buf[np.arange(upto[-1]) - np.repeat(upto - length - at, length)].tobytes()
        ids, size = [], []
        # calls of some kilobytes; a piece is never cut
        groups = np.flatnonzero(np.diff(upto // 4096, prepend=-1)) if together else np.arange(len(names))
        for i, j in zip(groups.tolist(), [*groups[1:].tolist(), len(names)], strict=True):
            begin = int(upto[i] - length[i])
            got = np.array(self.encode(text[begin : int(upto[j - 1])].decode()), np.uint16)
            ends = np.cumsum(self.bytes_of[got])
            after = np.searchsorted(ends, upto[i:j] - begin)
            if (ends[after] != upto[i:j] - begin).any():
                raise RuntimeError("a token reaches over a piece's end")
            ids.append(got)
            size.append(np.diff(after, prepend=-1))
        size = np.concatenate(size)
        begin = np.cumsum(size) - size + len(self.store)
        self.store = np.concatenate([self.store, *ids])
        names = np.concatenate([self.names, names])
        order = np.argsort(names, kind="stable")
        self.names = names[order]
        self.begin, self.size = np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]
        self.used = np.concatenate([self.used, np.zeros(len(begin), np.int64)])[order]

    def _forget(self) -> None:
        """Keeps the half of the known pieces that were met most often."""
        keep = np.sort(np.argpartition(self.used, -(_KNOWN // 2))[-(_KNOWN // 2) :])
        size, begin = self.size[keep], self.begin[keep]
        upto = np.cumsum(size)
        self.store = self.store[np.arange(upto[-1]) - np.repeat(upto - size - begin, size)]
        self.names, self.size, self.begin, self.used = self.names[keep], size, upto - size, self.used[keep] // 2


def _wide_space(buf: np.ndarray) -> np.ndarray:
    """The bytes of white space beyond ASCII, as Unicode has it."""
    out = np.zeros(len(buf), bool)
    lead = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
    if len(lead):
        more = np.concatenate([buf, np.zeros(2, np.uint8)])
        a, b, c = more[lead], more[lead + 1], more[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        three |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        for test, width in ((two, 2), (three, 3)):
            for k in range(width):
                out[lead[test] + k] = True
    return out


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1: a Feistel network on the least even number of bits, walked until below n."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) ^ mixed(np.array([key & (1 << 64) - 1], np.uint64)))
    out = x.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        v = out[walking]
        left, right = v >> shift, v & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        v = (left << shift) | right
        out[walking] = v
        walking = walking[v >= np.uint64(n)]
    return out


def sequences(docs: DataFrame, length: int, vocabulary: str) -> DataFrame:
    """(task, place, doc_id, chunk, n, tokens): n little-endian 16-bit ids."""
    made: list[Tokenizer] = []
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Tokenizer(SparkFiles.get(name)))
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(-1))
            for w in chunks(batch.column(1), _ANY, lower=False):
                tokens, first = made[0](w)
                size = np.diff(first) + 1  # with the end mark
                n = -(-size // length)
                many = int(n.sum())
                owner = np.repeat(np.arange(len(w)), n)
                chunk = np.arange(many) - (np.cumsum(n) - n)[owner]
                used = np.minimum(size[owner] - chunk * length, length)
                flat = np.insert(tokens, first[1:], made[0].end).astype("<u2")
                offs = np.concatenate([[0], np.cumsum(2 * used)]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.record_batch([pa.array(np.full(many, task)), pa.array(np.arange(place, place + many)), pa.array(ids[w.row + owner]), pa.array(chunk), pa.array(used), data], names=["task", "place", "doc_id", "chunk", "n", "tokens"])
                place += many
            del batch
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(cut, _SEQUENCES)


def materialised(docs: DataFrame, length: int = 512, per_shard: int = 2048, key: int = 20240229, vocabulary: str = VOCABULARY) -> DataFrame:
    """Shards of (doc_id, text): shard, first_slot, n_sequences, stride, data (binary).

    A null or empty text is one sequence that holds the end mark only; a null id is written as -1;
    repeated rows are sequences of their own, rows of one id stand by a hash of their text. A text may have any length. Other
    columns are ignored; an empty table gives no shards. The vocabulary must have at most 65,535 ids; its file is sent to all executors.
    """
    spark = docs.sparkSession
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(f"no vocabulary at {vocabulary}; name one with the parameter")
    bounded_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("tie"))
    ordered = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows = written(sequences(ordered, length, vocabulary))
    counts = written(rows.groupBy("task").agg(F.count("*").alias("n")))  # one row a task
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("task", before.alias("offset"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], _SHARDS)
    placed = rows.join(F.broadcast(offsets), "task").select((F.col("offset") + F.col("place")).alias("i"), "doc_id", "chunk", "n", "tokens")
    shards = -(-total // per_shard)
    ranges = min(-(-shards // 8), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 512)))

    def slot(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = feistel(np.asarray(batch.column(0)), total, key).astype(np.int64)
        yield pa.record_batch([pa.array((at // per_shard * ranges // shards).astype(np.int32)), pa.array(at), *batch.columns[1:]], names=["range", "slot", "doc_id", "chunk", "n", "tokens"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = np.asarray(batch.column(0)) // per_shard
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0].column(0)[0].as_py() // per_shard != shard[i]:
                    yield whole(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield whole(pa.Table.from_batches(held))

    def whole(table: pa.Table) -> pa.RecordBatch:
        head = np.zeros(table.num_rows, HEADER)
        for name in HEADER.names:
            head[name] = np.asarray(table.column(name).combine_chunks())
        body = np.full((table.num_rows, length), end, "<u2")
        body[np.arange(length) < head["n"][:, None]] = np.frombuffer(b"".join(table.column("tokens").to_pylist()), "<u2")
        data = np.concatenate([head.view(np.uint8).reshape(len(head), -1), body.view(np.uint8)], 1).tobytes()
        k = table.column("slot")[0].as_py() // per_shard
        return pa.record_batch([pa.array([k]), pa.array([k * per_shard]), pa.array([table.num_rows]), pa.array([HEADER.itemsize + 2 * length]), pa.array([data], pa.binary())], names=["shard", "first_slot", "n_sequences", "stride", "data"])

    with open(vocabulary, "rb") as f:
        end = max(int(line.split()[1]) for line in f) + 1
    slots = placed.mapInArrow(per_batch(slot), "range int, slot long, doc_id long, chunk long, n long, tokens binary")
    dealt = slots.repartitionById(ranges, "range").sortWithinPartitions("slot")
    return dealt.select("slot", "doc_id", "chunk", "n", "tokens").mapInArrow(write, _SHARDS)


def records(shards: DataFrame, since: int = 0) -> DataFrame:
    """(slot, shard, at, doc_id, chunk, n, tokens_sha256) read back from shards, from slot ``since`` on; ``at`` is the
    record's byte in its shard."""
    import hashlib

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k, first, n, stride, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = np.frombuffer(data, np.uint8).reshape(n, stride)[max(0, since - first) :]
            start = first + n - len(raw)
            head = np.ascontiguousarray(raw[:, : HEADER.itemsize]).view(HEADER).ravel()
            digest = [hashlib.sha256(r[HEADER.itemsize : HEADER.itemsize + 2 * int(m)].tobytes()).hexdigest() for r, m in zip(raw, head["n"], strict=True)]
            at = np.arange(start, start + len(raw))
            yield pa.record_batch(
                [pa.array(at), pa.array(np.full(len(raw), k)), pa.array((at - first) * stride), pa.array(head["doc_id"]), pa.array(head["chunk"].astype(np.int64)), pa.array(head["n"].astype(np.int64)), pa.array(digest, pa.string())],
                names=["slot", "shard", "at", "doc_id", "chunk", "n", "tokens_sha256"],
            )

    own = shards.where((F.col("first_slot") + F.col("n_sequences")) > since).select("shard", "first_slot", "n_sequences", "stride", "data")
    return own.mapInArrow(per_batch(read), "slot long, shard long, at long, doc_id long, chunk long, n long, tokens_sha256 string")


def write_files(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each shard as a flat file to a folder that all executors share (a path, or the URI of a store), and returns (shard, path, bytes).

    A file is written under another name and renamed when it is whole, so that a repeated task does no harm.
    """

    def write(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        store.create_dir(root)
        out = []
        for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            path = f"{root}/shard-{k:08d}.bin"
            part = f"{path}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(part) as f:
                f.write(data)
            store.move(part, path)
            out.append((k, path, len(data)))
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names=["shard", "path", "bytes"])

    return shards.select("shard", "data").mapInArrow(per_batch(write), "shard long, path string, bytes long")

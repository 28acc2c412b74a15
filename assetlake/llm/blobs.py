"""Columns of 64-bit numbers that travel as compressed blobs, one row for each bucket of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import mixed


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers as byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[int], list[list[bytes]]]:
    """(bucket, rows, blobs of each column) of columns that are sorted by bucket."""
    at = runs(bucket)
    stop = np.append(at, len(bucket))[1:]
    return bucket[at], (stop - at).tolist(), [[pack(c[a:b]) for a, b in zip(at, stop, strict=True)] for c in columns]


def runs(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    if not len(x):
        return np.zeros(0, np.int64)
    new = x[1:] != x[:-1]
    for y in more:
        new |= y[1:] != y[:-1]
    return np.flatnonzero(np.concatenate([[True], new]))


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of ids or hashes, in a way that depends on their values only."""
    return (mixed(x.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def range_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 48-bit hashes by their upper bits, so that buckets ascend with the hash."""
    return (((x >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)

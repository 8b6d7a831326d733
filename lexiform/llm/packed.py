"""Packed rows between blocks of documents and buckets of keys.

A block, about ``BLOCK_BYTES`` of texts dealt by hash, asks about its distinct sorted 64-bit keys; a bucket is a range of
keys. A row holds what one block has for one bucket, so there are fewer rows than keys, and the number of buckets follows the
volume of the keys and not the number of blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import zstandard

BLOCK_BYTES = 6 << 20


def squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    parts = [zstandard.compress(np.ascontiguousarray(a).tobytes(), level) for a in arrays]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def opened(body: bytes, *kinds) -> list[np.ndarray]:
    lens = struct.unpack_from(f"<{len(kinds)}I", body)
    out, at = [], 4 * len(kinds)
    for n, kind in zip(lens, kinds, strict=True):
        out.append(np.frombuffer(zstandard.decompress(body[at : at + n]), kind))
        at += n
    return out


def planes(numbers: np.ndarray) -> np.ndarray:
    """Numbers as bytes, all first bytes before all second ones: where most are small, most planes are zero."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.copy()


def joined(data: np.ndarray, kind) -> np.ndarray:
    return data.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def stepped(data: np.ndarray) -> np.ndarray:
    return np.cumsum(joined(data, np.uint64), dtype=np.uint64)


def slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of sorted keys; a bucket is a range of keys."""
    step = -(-(1 << 64) // buckets)
    at = np.searchsorted(keys, np.array([i * step for i in range(buckets)], np.uint64))
    for i, (a, b) in enumerate(zip(at, np.append(at[1:], len(keys)), strict=True)):
        if b > a:
            yield i, int(a), int(b)


def by_bucket(batches, answer: Callable) -> Iterator:
    """Calls ``answer(bucket, blocks, bodies)`` for each bucket of rows (bucket, block, body) sorted by bucket."""
    bucket, blocks, bodies = None, [], []
    for b in batches:
        for k, block, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != bucket:
                if bodies:
                    yield answer(bucket, blocks, bodies)
                bucket, blocks, bodies = k, [], []
            blocks.append(block)
            bodies.append(body)
    if bodies:
        yield answer(bucket, blocks, bodies)

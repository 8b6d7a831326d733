"""Byte-pair merging: lowest rank first, leftmost among equals."""

from __future__ import annotations

import heapq
from functools import cache

SHORT = 32


@cache
def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``ranks``: pair of ids to (rank, merged id)."""
    return _linear(list(ids), ranks) if len(ids) <= SHORT else _heap(list(ids), ranks)


def _linear(ids, ranks):
    while len(ids) > 1:
        best, at = None, -1
        for i in range(len(ids) - 1):
            r = ranks.get((ids[i], ids[i + 1]))
            if r is not None and (best is None or r[0] < best[0]):
                best, at = r, i
        if best is None:
            break
        ids[at : at + 2] = [best[1]]
    return ids


def _heap(ids, ranks):
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n
    todo = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
    heapq.heapify(todo)
    while todo:
        _, i, a, b, new = heapq.heappop(todo)
        j = after[i]
        if not live[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], live[j] = new, False
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if r := ranks.get((new, ids[k])):
                heapq.heappush(todo, (r[0], i, new, ids[k], r[1]))
        if (p := before[i]) >= 0 and (r := ranks.get((ids[p], new))):
            heapq.heappush(todo, (r[0], p, ids[p], new, r[1]))
    return [x for x, keep in zip(ids, live, strict=True) if keep]

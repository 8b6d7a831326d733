"""Word and n-gram fingerprints of whole Arrow batches with numpy, without a Python object per word.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text. Words of up to
64 bytes get a 64-bit tabulation hash, longer ones eight bytes of BLAKE2b. Equal words have
equal fingerprints in every task of every run: the tables come from a fixed seed.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

SPAN = 1 << 20  # bytes worked on at a time
SHORT = 64
U = np.uint64


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(0x5EED1E51))
    tab = rng.integers(0, 1 << 64, size=SHORT * 256, dtype=np.uint64)
    white = np.zeros(256, bool)
    white[[32, 9, 10, 11, 12, 13]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return tab, white, lower


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _cuts(data: np.ndarray, offs: np.ndarray) -> list[int]:
    """Positions that cut the data into spans of about SPAN bytes, never inside a word."""
    _, white, _ = _tables()
    end, cuts = int(offs[-1]), [int(offs[0])]
    while end - cuts[-1] > SPAN:
        at = cuts[-1]
        doc = int(offs[np.searchsorted(offs, at + SPAN, "right") - 1])
        if doc > at:
            cuts.append(doc)
            continue
        gaps = np.flatnonzero(white[data[at + 1 : at + SPAN]])
        if len(gaps):
            cuts.append(at + 1 + int(gaps[-1]))
            continue
        stop = int(offs[np.searchsorted(offs, at, "right")])  # one word of over SPAN bytes
        place = at + SPAN
        while place < stop and not white[data[place]]:
            step = np.flatnonzero(white[data[place : min(stop, place + SPAN)]])
            place = place + int(step[0]) if len(step) else min(stop, place + SPAN)
        cuts.append(place)
    return [*cuts, end] if cuts[-1] < end else cuts


def words(raw, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, and for each document the index of its first word (n + 1 numbers).

    raw: the documents' bytes, document i at offs[i]:offs[i + 1]. lower: fold A-Z first.
    """
    tab, white, low = _tables()
    data = np.frombuffer(raw, np.uint8)
    out, places = [], []
    cuts = _cuts(data, offs)
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = data[a:b]
        is_word = ~white[part]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        inner = offs[np.searchsorted(offs, a, "left") : np.searchsorted(offs, b, "left")] - a
        begins[inner] |= is_word[inner]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        at = np.flatnonzero(is_word)
        first = np.searchsorted(at, starts)
        lens = np.diff(first, append=len(at))
        kept = part[at]
        if lower:
            kept = low[kept]
        pos = np.arange(len(at)) - np.repeat(first, lens)
        h = np.add.reduceat(tab[(np.minimum(pos, SHORT - 1) << 8) + kept], first)
        h = mix(h + lens.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(lens > SHORT):
            word = kept[first[i] : first[i] + lens[i]].tobytes()
            h[i] = U(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        out.append(h)
        places.append(starts + a)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    where = np.concatenate(places)
    return np.concatenate(out), np.searchsorted(where, offs, "left")


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of the k words from each position on; shorter than h by k - 1. Order counts."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    power, run, step, done, have = 0x9DDFEA08EB382D69, h, 1, None, 0
    bits = k
    while bits:
        if bits & 1:
            if done is None:
                done, have = run, step
            else:  # done covers `have` words, run the `step` words after them
                n = len(h) - have - step + 1
                done, have = done[:n] * U(power) + run[have : have + n], have + step
        bits >>= 1
        if bits:
            n = len(run) - step
            run = run[:n] * U(power) + run[step : step + n]
            power, step = power * power * 0x2545F4914F6CDD1D % (1 << 64) | 1, step * 2
    return mix(done + U(k))

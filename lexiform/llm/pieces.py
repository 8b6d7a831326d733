"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is a BPE model with byte fallback. Encoding keeps an agenda of candidate merges ordered by score
and place. With dropout a candidate is skipped when a keyed hash of it falls below the rate, so one text
has many segmentations, each a function of the seed and the text alone: a retried task repeats it.
Decoding gives back the text exactly, whatever was skipped. Without dropout the result is the model's own.

A piece never holds a space mark behind another character, so a text is cut at spaces and units are
encoded on their own; with dropout each occurrence of a unit has a key of its own, from the seed, the text's digest and its
place in the text. The distinct units of a batch of texts are encoded together: each step carries out the next
merge of every unit's agenda at once. Units that occur more than once are first encoded without dropout, and an occurrence
whose key skips none of the merges carried out has that result; all others are encoded with their own keys. Units of more than
``WIDE`` characters are cut where no piece has both neighbours; what is longer even then goes through a heap alone.
"""

from __future__ import annotations

import hashlib
import heapq
import random
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import batch, bound_batches, buffers, text_of

MARK = "▁"
LITERAL = "\0" + MARK  # no piece holds it
#: Units up to this length go through the agenda together, longer ones one at a time with a heap. A place has six bits there.
WIDE = 24
#: Units of one step.
TOGETHER = 1 << 16
#: Characters of texts encoded at once.
STEP = 4 << 20
_NONE = np.iinfo(np.int32).max
U = np.uint64
_MASK = (1 << 64) - 1


@dataclass
class Pieces:
    """A vocabulary: piece to (id, score), and what each id stands for in bytes."""

    merge: dict[str, tuple[int, float]]
    byte: list[int]
    surface: list[bytes]
    control: frozenset[int]

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Reads a model file on the driver; only its tables travel, which are as large as the vocabulary."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        merge, byte, surface, control = {}, [-1] * 256, [], set()
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                byte[int(p[3:5], 16)] = i
                surface.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                control.add(i)
                surface.append(b"")
            else:
                merge[p] = (i, m.get_score(i))
                surface.append(p.replace(MARK, " ").encode())
                if MARK in p.lstrip(MARK):
                    raise ValueError("a piece holds a space mark behind another character")
        if -1 in byte:
            raise ValueError("the vocabulary has no byte fallback")
        return cls(merge, byte, surface, frozenset(control))

    @cached_property
    def tables(self):
        """(id of each character or -1, what finds the merged ids of pairs, rank of each id)."""
        char = np.full(0x110000, -1, np.int32)
        pairs = {}
        for p, (i, _) in self.merge.items():
            if len(p) == 1:
                char[ord(p)] = i
            for k in range(1, len(p)):
                left, right = self.merge.get(p[:k]), self.merge.get(p[k:])
                if left and right:
                    pairs[left[0] << 24 | right[0]] = i
        char[ord(" ")], char[ord(MARK)] = char[ord(MARK)], -1  # a mark in the text itself is no space
        rank = np.zeros(len(self.surface), np.int32)
        score = np.zeros(len(self.surface))
        for i, x in self.merge.values():
            score[i] = -x
        rank[:] = np.unique(score, return_inverse=True)[1]
        return char, _Pairs(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)), rank

    @cached_property
    def bytes_of(self) -> tuple[pa.Array, np.ndarray]:
        """What each id stands for, and whether it may stand in a text."""
        plain = np.ones(len(self.surface), bool)
        plain[list(self.control)] = False
        return pa.array(self.surface, pa.large_binary()), plain

    @cached_property
    def neighbours(self) -> np.ndarray:
        """Sorted pairs of characters that stand next to each other in some piece. No merge reaches over any other pair."""
        pairs = {ord(a) << 21 | ord(b) for p in self.merge for a, b in zip(p, p[1:], strict=False)}
        return np.array(sorted(pairs), np.int64)

    def _segments(self, points: np.ndarray, first: np.ndarray, size: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, first, size) of the parts of units that can be encoded alone; only units with ``cut`` have more than one."""
        long = np.flatnonzero(cut)
        if len(long) < len(first):  # the others are parts of their own
            owner, begin, span = self._segments(points, first[long], size[long], cut[long]) if len(long) else (long, long, long)
            rest = np.flatnonzero(~cut)
            owner, begin, span = (np.concatenate(x) for x in ((long[owner], rest), (begin, first[rest]), (span, size[rest])))
            order = np.argsort(owner, kind="stable")
            return owner[order], begin[order], span[order]
        ends = np.cumsum(size)
        at = np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        code = points[at].astype(np.int64)
        code = np.where(code == ord(" "), ord(MARK), np.where(code == ord(MARK), (1 << 21) - 1, code))
        pair = code[:-1] << 21 | code[1:]
        known = self.neighbours
        apart = known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] != pair if len(known) else np.ones(len(pair), bool)
        begins = np.zeros(len(at), bool)
        begins[1:] = apart
        begins[ends - size] = True
        where = np.flatnonzero(begins)
        return np.searchsorted(ends, where, "right"), at[where], np.diff(where, append=len(at))

    def _unit(self, unit: str, rate: int, base: int, merges: list[tuple[int, int]] | None = None) -> list[int]:
        """Ids of one unit by a heap. rate: of 2**32; base: of the dropout; merges takes (place, id) of those carried out."""
        merge = self.merge
        chars = [MARK if c == " " else LITERAL if c == MARK else c for c in unit]
        n = len(chars)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if (m := merge.get(chars[i] + chars[i + 1])) is not None:
                agenda.append((-m[1], i, chars[i] + chars[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if j >= n or not chars[i] or chars[i] + chars[j] != piece:
                continue  # one of its parts has been merged
            if rate:
                h = (base + i * 0x9E3779B97F4A7C15 + merge[piece][0] * 0xC2B2AE3D27D4EB4F) & _MASK
                h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & _MASK
                h = (h ^ h >> 32) * 0x94D049BB133111EB & _MASK
                if h >> 32 < rate:
                    continue
            if merges is not None:
                merges.append((i, merge[piece][0]))
            chars[i], chars[j] = piece, ""
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (m := merge.get(piece + chars[k])) is not None:
                    heapq.heappush(agenda, (-m[1], i, piece + chars[k]))
            p = before[i]
            if p >= 0 and (m := merge.get(chars[p] + piece)) is not None:
                heapq.heappush(agenda, (-m[1], p, chars[p] + piece))
        out: list[int] = []
        for c in chars:
            if c:
                if (m := merge.get(c)) is not None:
                    out.append(m[0])
                else:
                    out += [self.byte[b] for b in (MARK if c == LITERAL else c).encode()]
        return out

    def _together(self, sym: np.ndarray, rate: int, base: np.ndarray, merges: list | None = None) -> np.ndarray:
        """Ids of units of at most WIDE known characters, a row each, -1 behind the end and where a character went into the id before it.
        merges takes arrays (row, place, id) of those carried out."""
        _, pairs, rank = self.tables

        def candidate(left, right, place, base):
            """(agenda order and place in one number, merged id) of pairs; _NONE where there is none or it is skipped."""
            to, found = pairs.find(left, right)
            key, ok = np.full(len(left), _NONE, np.int32), np.flatnonzero(found)
            if rate:
                h = base[ok] + (place[ok] - 1).astype(np.uint64) * U(0x9E3779B97F4A7C15) + to[ok].astype(np.uint64) * U(0xC2B2AE3D27D4EB4F)
                h = (h ^ h >> U(29)) * U(0xBF58476D1CE4E5B9)
                h = (h ^ h >> U(32)) * U(0x94D049BB133111EB)
                ok = ok[(h >> U(32)) >= U(rate)]
            key[ok] = rank[to[ok]] << 6 | place[ok]
            return key, to

        m, n = sym.shape
        if n < 2:
            return sym
        # A column for each unit, a row for each place and one before and behind them; pairs are told by their left place. A merge
        # changes the two pairs beside it and the links between places; nothing else is moved.
        out = np.full((m, n), -1, np.int32)
        grid = np.full((n + 2, m), -1, np.int32)
        grid[1:-1] = sym.T
        places = np.repeat(np.arange(1, n, dtype=np.int32), m)
        order, to = np.full((n + 2, m), _NONE, np.int32), np.zeros((n + 2, m), np.int32)
        order[1:n], to[1:n] = (x.reshape(n - 1, m) for x in candidate(grid[1:n].ravel(), grid[2 : n + 1].ravel(), places, np.tile(base, n - 1)))
        before, after = (np.repeat(np.arange(d, n + 2 + d, dtype=np.int32), m).reshape(n + 2, m) for d in (-1, 1))
        live = np.arange(m)  # the unit of each column
        while True:
            best = order.min(axis=0)
            go = np.flatnonzero(best != _NONE)
            if 2 * len(go) < len(live):  # the columns that are done leave
                rest = np.flatnonzero(best == _NONE)
                out[live[rest]] = grid[1:-1, rest].T
                if not len(go):
                    return out
                live, base, best = live[go], base[go], best[go]
                grid, order, to, before, after = (np.take(x, go, axis=1) for x in (grid, order, to, before, after))
                go = np.arange(len(live))
            w = len(live)
            g, o, t, b, f = (x.ravel() for x in (grid, order, to, before, after))  # views
            j = best[go] & 63
            at = j * w + go
            k, new, p = f[at], t[at], b[at]
            if merges is not None:
                merges.append((live[go], j - 1, new))
            gone = k * w + go
            r = f[gone]
            g[at], g[gone], o[gone], f[at] = new, -1, _NONE, r
            past, left = r * w + go, p * w + go
            b[past] = j
            key = base[go]
            beside = np.concatenate([left, at])
            o[beside], t[beside] = candidate(np.concatenate([g[left], new]), np.concatenate([new, g[past]]), np.concatenate([p, j]), np.concatenate([key, key]))

    def encode_many(self, texts: list[str], rate: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and where each text begins (one more number than texts)."""
        cut = round(rate * (1 << 32))
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        keys = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in raw] if cut else []
        # A unit begins with a text and at a space behind another character; a text begins with a space of its own.
        data = b"".join([b" " + t for t in raw if t])
        begins = np.frombuffer(data, np.uint8) == 32
        begins[1:] &= ~begins[:-1]
        bounds = np.cumsum([0] + [len(t) + 1 if t else 0 for t in raw])
        begins[bounds[:-1][bounds[:-1] < len(data)]] = True
        first = np.flatnonzero(begins)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(data))), pa.py_buffer(data)]).dictionary_encode()
        unit, lens = found.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(first, bounds))
        names = _Units(self.tables[0], found.dictionary)
        merges = [] if cut else None
        often = np.flatnonzero(np.bincount(unit, minlength=len(names.size)) > 1) if cut else np.arange(len(names.size))
        flat, at = self._encode_units(names, often, None, 0, merges)
        if cut:
            place = np.arange(len(unit)) - np.repeat(np.cumsum(lens) - lens, lens)
            base = (place.astype(np.uint64) * U(0x9E3779B97F4A7C15) ^ np.repeat(np.array(keys, np.uint64), lens)) * U(0xD6E8FEB86659FD93)
            base = (base ^ base >> U(32)) * U(0xA0761D6478BD642F) + U(seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D & _MASK)
            slot = np.full(len(names.size), -1)
            slot[often] = np.arange(len(often))
            one = slot[unit] < 0  # what occurs once shares with none
            own = np.flatnonzero(one | _skips(np.where(one, 0, slot[unit]), base, merges, cut, len(often)))
            more, ends = self._encode_units(names, unit[own], base[own], cut)
            unit = slot[unit]
            unit[own] = len(often) + np.arange(len(own))
            flat, at = np.concatenate([flat, more]), np.concatenate([at[:-1], at[-1] + ends])
        n = np.diff(at)[unit]
        ends = np.cumsum(n)
        ids = flat[np.repeat(at[unit] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.append(0, ends)[np.append(0, np.cumsum(lens))]
        return ids, stops

    def _encode_units(self, names: _Units, which: np.ndarray, base: np.ndarray | None, cut: int, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units names[which], and where each begins. merges takes arrays (unit, place, id) of the merges carried out."""
        points, sym = names.points, names.sym
        first, size, unknown = names.first[which], names.size[which], names.unknown[which]
        base = np.zeros(len(which), np.uint64) if base is None else base
        # Long units and those with an unknown character are cut where no piece has both neighbours: texts without spaces too
        # become short parts. A part keeps its place in the unit, which is part of its dropout keys.
        owner, begin, span = self._segments(points, first, size, unknown | (size > WIDE))
        inner = begin - first[owner]
        key = base[owner] + inner.astype(np.uint64) * U(0x9E3779B97F4A7C15)
        strange = self._strange(sym, begin, span)
        out: dict = {}
        counts, rows = np.zeros(len(owner), np.int64), []
        single = np.flatnonzero(strange & (span == 1))  # in bytes, whatever the key
        if len(single):
            chars, at = np.unique(points[begin[single]], return_inverse=True)
            spelt = [[self.byte[x] for x in chr(c).replace(" ", MARK).encode()] for c in chars.tolist()]
            table = np.full((len(spelt), 4), -1, np.int32)
            for k, ids in enumerate(spelt):
                table[k, : len(ids)] = ids
            ids = table[at]
            counts[single] = (ids >= 0).sum(axis=1)
            rows.append((single, ids[ids >= 0]))
        alone = np.flatnonzero((strange & (span > 1)) | (span > WIDE))
        for i in alone.tolist():
            done: list | None = None if merges is None else []
            text = points[begin[i] : begin[i] + span[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            out[i] = np.array(self._unit(text, cut, int(key[i]), done), np.int32)
            counts[i] = len(out[i])
            if done:
                place, to = np.array(done, np.int64).T
                merges.append((np.full(len(done), owner[i]), place + inner[i], to))
        together = np.flatnonzero(~(strange | (span > WIDE)))
        together = together[np.argsort(span[together].astype(np.uint8), kind="stable")]  # parts of like length share a step
        for a in range(0, len(together), TOGETHER):
            part = together[a : a + TOGETHER]
            wide = int(span[part].max())
            grid = np.full((len(part), wide), -1, np.int32)
            real = np.arange(wide)[None, :] < span[part][:, None]
            grid[real] = sym[np.repeat(begin[part] - (np.cumsum(span[part]) - span[part]), span[part]) + np.arange(span[part].sum())]
            steps: list | None = None if merges is None else []
            ids = self._together(grid, cut, key[part], steps)
            if steps:
                merges += [(owner[part[row]], place + inner[part[row]], to) for row, place, to in steps]
            counts[part] = (ids >= 0).sum(axis=1)
            rows.append((part, ids[ids >= 0]))
        stop = np.append(0, np.cumsum(counts))
        flat = np.zeros(int(stop[-1]), np.int32)
        for part, ids in rows:
            n = counts[part]
            flat[np.repeat(stop[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        for i in alone.tolist():
            flat[stop[i] : stop[i + 1]] = out[i]
        return flat, stop[np.searchsorted(owner, np.arange(len(which) + 1))]

    @staticmethod
    def _strange(sym: np.ndarray, begin: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Whether a part has a character that is no piece."""
        total = np.append(0, np.cumsum(sym < 0))
        return total[begin + span] > total[begin]

    def encode(self, text: str, rate: float = 0.0, seed: int = 0) -> list[int]:
        return self.encode_many([text], rate, seed)[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids; control ids and ids outside the vocabulary are an error."""
        return self.decode_many(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_many(self, ids: np.ndarray, stops: np.ndarray) -> list[str]:
        """The texts of ids one behind the other; stops tells where each text begins, and the end."""
        surface, plain = self.bytes_of
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(plain):
            raise IndexError("ids outside the vocabulary")
        if not plain[ids].all():
            raise ValueError("control ids have no text")
        data, at = buffers(surface.take(pa.array(ids)))
        out = []
        for a, b in pairwise(at[stops].tolist()):
            text = data[a:b]
            out.append(str(text[1:] if text[:1] == b" " else text, "utf-8", "replace"))
        return out


class _Units:
    """Distinct units as characters: ids of these, where each unit begins, its length, and whether it has a character that is no piece."""

    def __init__(self, char: np.ndarray, units: pa.Array):
        data, at = buffers(units)
        data = data[at[0] : at[-1]]
        self.points = np.frombuffer(str(data, "utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        before = np.append(0, np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))  # characters that begin before each byte
        ends = before[at - at[0]]
        self.first, self.size, self.sym = ends[:-1], np.diff(ends), char[self.points]
        self.unknown = np.minimum.reduceat(self.sym, self.first) < 0 if len(self.first) else np.zeros(0, bool)


class _Pairs:
    """Merged ids of pairs of ids, in slots without a conflict: a pair's hash gives a group, and each group has a shift that brings its
    pairs to free slots, so that finding a pair takes no search."""

    def __init__(self, keys: np.ndarray, merged: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())  # at most half of the slots are taken
        size, tries = 1 << self.bits, random.Random(0)
        while True:  # a factor that brings two pairs to the same group and place is passed over
            self.factor = U(tries.getrandbits(64) | 1)
            group, place = self._hash(keys)
            if len(np.unique(group << self.bits | place)) == len(keys):
                break
        self.shift, slot, free = np.zeros(size, np.int64), np.zeros(len(keys), np.int64), np.ones(size, bool)
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        count = np.diff(first, append=len(keys))
        for k in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():  # the fullest groups first
            own = order[first[k] : first[k] + count[k]]
            at = place[own]
            while not free[at].all():
                at = place[own] + tries.randrange(size) & size - 1
            self.shift[group[own]], slot[own], free[at] = at[0] - place[own[0]], at, False
        one = order[first[count == 1]]  # alone in its group: any free slot will do
        slot[one] = np.flatnonzero(free)[: len(one)]
        self.shift[group[one]] = slot[one] - place[one]
        self.keys, self.merged = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        self.keys[slot], self.merged[slot] = keys, merged

    def _hash(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys.view(np.uint64) * self.factor
        return (h >> U(64 - self.bits)).view(np.int64), (h >> U(64 - 2 * self.bits)).view(np.int64) & (1 << self.bits) - 1

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged id, whether there is one) of pairs; an id of -1 has none."""
        key = left.astype(np.int64) << 24 | right
        group, place = self._hash(key)
        slot = place + self.shift[group] & (1 << self.bits) - 1
        return self.merged[slot], (self.keys[slot] == key) & (key >= 0)


def _skips(unit: np.ndarray, base: np.ndarray, merges: list, cut: int, n_units: int) -> np.ndarray:
    """Whether an occurrence's key skips one of the merges that its unit has without dropout. unit and base: of each occurrence."""
    hit = np.zeros(len(unit), bool)
    if not merges:
        return hit
    row, place, to = (np.concatenate([x[k] for x in merges]).astype(np.int64) for k in range(3))
    order = np.argsort(row, kind="stable")
    add = (place.astype(np.uint64) * U(0x9E3779B97F4A7C15) + to.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))[order]
    count = np.bincount(row, minlength=max(1, n_units))
    begin = np.cumsum(count) - count
    for a in range(0, len(unit), TOGETHER):
        part = unit[a : a + TOGETHER]
        n = count[part]
        of = np.repeat(np.arange(len(part)), n)
        h = base[a : a + TOGETHER][of] + add[np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        h = (h ^ h >> U(29)) * U(0xBF58476D1CE4E5B9)
        h = (h ^ h >> U(32)) * U(0x94D049BB133111EB)
        hit[a + of[(h >> U(32)) < U(cut)]] = True
    return hit


def encode_column(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, ids) of every row; a null or empty text has no ids. Rows are independent and nothing is shuffled: repeated ones give
    the same each, a null id stays null, a text of any length is worked on whole, an empty table gives no rows, further columns
    are ignored. Ids must be integers."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(pieces)  # as large as the vocabulary
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            texts, a = b.column(1).to_pylist(), 0
            while a < len(texts):  # some MB of text at a time
                e, size = a, 0
                while e < len(texts) and size < STEP:
                    size, e = size + len(texts[e]), e + 1
                flat, at = shared.value.encode_many(texts[a:e], rate, seed)
                yield batch(schema, [b.column(0).slice(a, e - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, pa.int32()))])
                a = e

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode_column(encoded: DataFrame, pieces: Pieces, id_col: str = "doc_id", with_text: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, decoded) of the column ids; ids_sha256 is over little-endian 32-bit ids."""
    spark = encoded.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(pieces)
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("decoded", pa.string())] * with_text)

    def run(batches):
        for b in batches:
            ids, n, ids_sha, text_sha = b.column("ids"), [], [], []
            if ids.null_count:
                raise ValueError("a row has no list of ids")
            stops = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False)[stops[0] : stops[-1]].astype("<i4")
            stops = stops - stops[0]
            texts = shared.value.decode_many(flat, stops)
            for a, e, text in zip(stops[:-1].tolist(), stops[1:].tolist(), texts, strict=True):
                n.append(e - a)
                ids_sha.append(hashlib.sha256(flat[a:e]).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield batch(schema, [b.column(id_col), n, ids_sha, text_sha] + [texts] * with_text)

    return encoded.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * with_text)

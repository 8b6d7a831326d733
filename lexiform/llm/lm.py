"""Language-model scoring with a weighted backoff automaton.

Model: interpolated n-grams (``ORDER``) over words and an end mark, smoothed after Witten and Bell, in automaton form. Every
n-gram shorter than the order that was seen as a history is a state; the root is the empty one. A state's arcs are the
words seen after it. Its failure arc leads to the state of its longest proper suffix, down to the root, and carries
the backoff weight. The root has an arc for every word and one for the unknown word.

    P(w)    = c(w) / (N + V), or V / (N + V) for an unknown word
    P(w|h)  = (c(hw) + T(h) * P(w|h')) / (c(h) + T(h)),  backoff weight T(h) / (c(h) + T(h))

c counts in all learning texts, h' is h without its first word. T(h) counts the continuations of h: its distinct next words in all
learning texts. A traversal reads a text from left to right: in a state it takes the
word's arc, or follows failure arcs until there is one, adds up the weights, and goes on in the state of the
longest suffix of what it has read.

Scale: the model is as large as the corpus, so it is never gathered in one place or broadcast. Documents are
dealt into blocks. A block asks for the n-grams that it holds, together with how often its learning documents hold them:
requests and counts are the same packed rows, sorted by n-gram key. Each bucket of keys adds up what all blocks say, names for
each n-gram one block, of those that learn from it, as its owner, and answers each block in the order of its request. A block then
counts for each history the continuations that it owns; the buckets of the histories, which read the requests' exchange again for
the keys, add these up: every n-gram has one owner, so that T(h) is exact, however documents are dealt. With both answers the
block builds the part of the automaton that its texts can reach and traverses them. Texts are shuffled once: all steps read the
same exchange. The number of buckets follows the volume of the keys, that of blocks the volume of the texts; a row holds what one block
has for one bucket, so there are never more rows than n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import by_bucket, joined, opened, planes, slices, squeeze, stepped, steps
from .tables import NULL_ID, batch, bound_batches, buffers, lean, parts, release, remainder, text_of
from .textops import mix, words

#: Words of the longest n-gram.
ORDER = 3
#: Words in a block: it bounds a task's arrays.
BLOCK = 1_000_000
#: N-grams that one bucket gets, about.
BUCKET = 4_000_000
END, START = np.uint64(0x454E44), np.uint64(0x5354415254)
#: Keys of two words or more keep this many bits: two of 10**12 n-grams share a key with a chance of 1 in 70,000 each.
KEY_BITS = 56
PACK = pa.schema([("block", pa.int64()), ("body", pa.binary())])
ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])
STATS = ("tokens", "types")


def unigram_key(h: np.ndarray) -> np.ndarray:
    return mix(h ^ np.uint64(0xA24BAED4963EE407))


def longer_key(key: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of an n-gram and one more word."""
    low = np.uint64(64 - KEY_BITS)
    return mix(mix(key + np.uint64(0x9FB21C651E98DF25)) + w * np.uint64(0xD6E8FEB86659FD93)) >> low << low


def _word_counter(buckets: int):
    """Distinct learning words of each block-sized part of a task, with counts; bucket -1 tells how many words there are."""

    def run(batches):
        held, n, everything = [], 0, 0

        def out():
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            rows = [(i, 0, squeeze(steps(keys[a:b]), c[a:b].astype(np.int32))) for i, a, b in slices(keys, buckets)]
            return batch(ASK, list(zip(*rows, strict=True)))

        for b in batches:
            learn = b.column(0).to_numpy(zero_copy_only=False)
            raw, offs = buffers(b.column(1))
            h, at = words(raw, offs, lower=True)
            lens = np.diff(at)
            everything += len(h) + len(lens)
            keys = unigram_key(h[np.repeat(learn, lens)])
            ends = np.repeat(unigram_key(np.array([END])), int(learn.sum()))
            held += [keys, ends]
            n += len(keys) + len(ends)
            if n >= BLOCK:
                yield out()
                held, n = [], 0
        if n:
            yield out()
        yield batch(ASK, [[-1], [everything], [b""]])

    return run


def _word_stats(batches):
    schema = pa.schema([("all", pa.int64()), *((s, pa.int64()) for s in STATS)])

    def answer(bucket, blocks, bodies):
        if bucket == -1:
            return batch(schema, [[sum(blocks)], [0], [0]])
        got = [opened(b, np.uint8, np.int32) for b in bodies]
        return batch(schema, [[0], [int(sum(c.sum(dtype=np.int64) for _, c in got))], [len(np.unique(np.concatenate([stepped(k) for k, _ in got])))]])

    yield from by_bucket(batches, answer)


def _packer(batches):
    """Texts of a batch, packed per block."""
    for b in batches:
        block = b.column(0).to_numpy()
        ids, learn = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
        raw, offs = buffers(b.column(3))
        data, out = np.frombuffer(raw, np.uint8), []
        order = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]]) if len(order) else []
        for a, e in zip(cut, np.append(cut[1:], len(order)), strict=True):
            at = order[a:e]
            text = np.concatenate([data[offs[i] : offs[i + 1]] for i in at])
            out.append((int(block[at[0]]), squeeze(ids[at], learn[at].astype(np.uint8), offs[at + 1] - offs[at], text, level=5)))
        if out:
            yield batch(PACK, list(zip(*out, strict=True)))


class Block:
    """A block's documents in the order of their packed rows, as n-gram keys.

    ``gram[k]`` tells for each token which of ``keys`` is the n-gram of k + 1 words that ends in it, -1 where the text has
    none: the start mark stands before the first word, and an n-gram holds one at most, as its first word.
    """

    def __init__(self, bodies: list[bytes], order: int) -> None:
        # The same documents can come in another order when a task is retried: sort the packed rows.
        got = [opened(b, np.int64, np.uint8, np.int64, np.uint8) for b in sorted(bodies)]
        self.ids = np.concatenate([x[0] for x in got])
        self.learn = np.concatenate([x[1] for x in got]).astype(bool)
        offs = np.append(0, np.cumsum(np.concatenate([x[2] for x in got])))
        h, at = words(np.concatenate([x[3] for x in got]), offs, lower=True)
        self.lens = np.diff(at) + 1
        self.stops = np.cumsum(self.lens)
        n = int(self.stops[-1])
        token = np.full(n, END)
        inner = np.ones(n, bool)
        inner[self.stops - 1] = False
        token[inner] = h
        self.first = self.stops - self.lens
        place = np.arange(n) - np.repeat(self.first, self.lens)
        start = unigram_key(np.array([START]))
        each = [unigram_key(token)]
        for k in range(1, order):
            before = np.empty_like(token)
            before[1:] = each[-1][:-1]
            if k == 1:
                before[self.first] = start
            each.append(longer_key(before, token))
        there = [place >= k - 1 for k in range(order)]
        # Keys of one word lie in front, those of the longest n-grams, which are no histories, at the end: each have buckets of their own.
        one, back = np.unique(each[0], return_inverse=True)
        mid, back_mid = np.unique(np.concatenate([start, *(e[t] for e, t in zip(each[1:-1], there[1:-1], strict=True))]), return_inverse=True)
        top, back_top = np.unique(each[-1][there[-1]], return_inverse=True)
        self.kinds, self.start = (one, mid, top), len(one) + back_mid[0]
        back_more = np.concatenate([len(one) + back_mid, len(one) + len(mid) + back_top])
        self.gram, at_ = [back.astype(np.int32)], 1  # a block has far fewer than 2**31 n-grams
        for t in there[1:]:
            g = np.full(n, -1, np.int32)
            m = int(t.sum())
            g[t] = back_more[at_ : at_ + m]
            at_ += m
            self.gram.append(g)

    def history(self, k: int) -> np.ndarray:
        """Which key the k words before each token are, -1 where there are none."""
        out = np.empty_like(self.gram[0])
        out[1:] = self.gram[k - 1][:-1]
        out[self.first] = self.start if k == 1 else -1
        return out

    def often(self) -> np.ndarray:
        """How often the learning documents hold each key."""
        learn = np.repeat(self.learn, self.lens)
        n = np.zeros(sum(map(len, self.kinds)), np.int64)
        n[self.start] = self.learn.sum()
        for g in self.gram:
            n += np.bincount(g[learn & (g >= 0)], minlength=len(n))
        return n.astype(np.int32)

    def follow(self, own: np.ndarray) -> np.ndarray:
        """How many distinct words follow each key in the learning documents, of the n-grams that ``own`` marks."""
        learn = np.repeat(self.learn, self.lens)
        out = np.zeros(len(own), np.int64)
        for k, g in enumerate(self.gram[1:], 1):
            place = np.full(len(own), -1, np.int32)  # of one occurrence: all have the same history
            ok = np.flatnonzero(learn & (g >= 0))
            place[g[ok]] = ok
            out += np.bincount(self.history(k)[place[own & (place >= 0)]], minlength=len(own))
        return out.astype(np.int32)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often the learning documents hold each key, and how many distinct words follow it there."""
        n = self.often()
        return n, self.follow(n > 0)

    def rows(self, buckets: tuple[int, ...]) -> Iterator[tuple[int, slice]]:
        """(bucket, keys) in the order of the keys, for so many buckets of each kind of keys."""
        before = at = 0
        for keys, m in zip(self.kinds, buckets, strict=True):
            for b, i, j in slices(keys, m):
                yield before + b, slice(at + i, at + j)
            before, at = before + m, at + len(keys)

    def score(self, c: np.ndarray, follow: np.ndarray, tokens: int, types: int):
        """(n_known, base, score) per document from the counts and continuations of the keys in all learning documents."""
        seen = c[self.gram[0]]
        known = np.add.reduceat((seen > 0).astype(np.int64), self.first)
        base = np.add.reduceat(np.log10((seen + 0.1) / (tokens + 0.1 * (types + 1))), self.first)
        if not tokens:
            return known, base, np.zeros(len(self.first))
        histories = [None, *(self.history(k) for k in range(1, len(self.gram)))]
        arc, fail = automaton(c, follow, self.gram, histories, tokens, types)
        return known, base, np.add.reduceat(traverse(arc, fail, histories, c, self.first), self.first)


def automaton(c, follow, gram, histories, tokens: int, types: int):
    """(arc, fail): for each depth of a state the log10 weight of every token's arc, not a number where the state has none
    (the root has all), and by key the log10 weight of the state's failure arc."""
    p = np.where(c[gram[0]] > 0, c[gram[0]], types) / (tokens + types)
    arc = [np.log10(p)]
    for g, h in zip(gram[1:], histories[1:], strict=True):
        total, other = np.where(h >= 0, c[h], 0), np.where(h >= 0, follow[h], 0)
        state = total > 0
        p = np.where(state, (np.where(g >= 0, c[g], 0) + other * p) / np.maximum(total + other, 1), p)
        arc.append(np.where(state & (g >= 0) & (c[g] > 0), np.log10(p), np.nan))
    with np.errstate(divide="ignore", invalid="ignore"):
        fail = np.where((c > 0) & (follow > 0), np.log10(follow / (c + follow)), 0.0)
    return arc, fail


def traverse(arc, fail, histories, c, first) -> np.ndarray:
    """The weight of each token on the path of its text.

    The state before a token is the longest suffix of the text so far that is one; it is carried from the token before. From
    it the path follows failure arcs down until a state has the token's arc. All texts of a block go at once.
    """
    depth = np.zeros(len(arc[0]), np.int64)  # of the state before each token
    for k in range(1, len(arc)):
        h = histories[k]
        depth[(h >= 0) & (c[np.maximum(h, 0)] > 0)] = k
    step, place = np.zeros(len(depth)), depth.copy()
    going = np.ones(len(depth), bool)
    for k in range(len(arc) - 1, -1, -1):
        here = going & (place == k)
        take = here & ~np.isnan(arc[k])
        step[take] += arc[k][take]
        going &= ~take
        miss = here & ~take
        if k:
            step[miss] += fail[histories[k][miss]]
            place[miss] = k - 1
    return step


def _asker(order: int, buckets: tuple[int, ...]):
    """Streams over packed rows sorted by block; a request per block and bucket."""

    def run(batches):
        block, bodies = None, []

        def out():
            x = Block(bodies, order)
            n, keys = x.often(), np.concatenate(x.kinds)
            rows = [(i, block, squeeze(steps(keys[s]), planes(n[s]))) for i, s in x.rows(buckets)]
            return batch(ASK, list(zip(*rows, strict=True)))

        for b in batches:
            for k, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != block:
                    if bodies:
                        yield out()
                    block, bodies = k, []
                bodies.append(body)
        if bodies:
            yield out()

    return run


def _grouped(keys: np.ndarray):
    """(order, begin and size of each group in it) of equal keys; equal ones stay in their order."""
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    new = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
    return order, new, np.diff(new, append=len(keys))


def _total(n: np.ndarray, order, new, size) -> np.ndarray:
    """For each entry the sum of its group."""
    out = np.empty(len(n), np.int64)
    out[order] = np.repeat(np.add.reduceat(n[order].astype(np.int64), new), size)
    return out


def _answerer(batches):
    """Counts in all blocks, and owners. Rows come sorted by bucket and block, so that a retried task names the same owners."""

    def answer(bucket, blocks, bodies):
        got = [opened(b, np.uint8, np.uint8) for b in bodies]
        keys, n = [stepped(k) for k, _ in got], np.concatenate([joined(c, np.int32) for _, c in got])
        del got
        stops = np.cumsum([len(k) for k in keys])
        order, new, size = _grouped(np.concatenate(keys))
        del keys
        total = _total(n, order, new, size)
        # The owner is the first block that learns from the n-gram. One that alone does so needs no mark.
        learnt = np.flatnonzero(n[order] > 0)
        group = np.repeat(np.arange(len(new), dtype=np.int32), size)[learnt]
        own = np.zeros(len(n), bool)
        own[order[learnt[np.flatnonzero(np.diff(group, prepend=np.int32(-1)))]]] = True
        told = []
        for s in map(slice, np.append(0, stops[:-1]), stops):
            told.append(squeeze(planes(total[s]), np.packbits(own[s][_shared(n[s], total[s])])))
        return batch(ANSWER, [blocks, [bucket] * len(blocks), told])

    yield from by_bucket(batches, answer)


def _shared(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """N-grams that this block learns from and others too."""
    return (n > 0) & (n < total)


def _rows_of(t: pa.Table, by: str) -> list[tuple[int, bytes]]:
    return sorted(zip(t.column(by).to_pylist(), t.column("body").to_pylist(), strict=True))


def _follower(order: int, buckets: tuple[int, ...]):
    """A block's own continuations of each history, by bucket, from its texts and the first answers."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        release()  # what the block before this one held
        if not texts.num_rows:
            return ASK.empty_table()
        x = Block(texts.column("body").to_pylist(), order)
        n = x.often()
        own = n > 0
        rows = list(x.rows(buckets))
        for (_, s), (_, body) in zip(rows, _rows_of(answers, "bucket"), strict=True):
            total, marks = opened(body, np.uint8, np.uint8)
            some = _shared(n[s], joined(total, np.int64))
            own[s][some] = np.unpackbits(marks, count=int(some.sum())).astype(bool)
        follow, block = x.follow(own), texts.column("block")[0].as_py()
        out = [(i, block, squeeze(planes(follow[s]))) for i, s in rows if i < sum(buckets[:-1])]
        return pa.Table.from_batches([batch(ASK, list(zip(*out, strict=True)))])

    return run


def _follow_answerer(buckets: tuple[int, ...]):
    """Continuations in all blocks, for the histories' buckets: the keys are those of the requests. The answers' buckets are numbered
    behind those of the first answers."""

    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return ANSWER.empty_table()
        release()
        asked_, told_ = _rows_of(asked, "block"), _rows_of(told, "block")
        blocks = [k for k, _ in told_]
        if blocks != [k for k, _ in asked_]:
            raise ValueError("a block's continuations and its request differ")
        keys = [stepped(opened(body, np.uint8, np.uint8)[0]) for _, body in asked_]
        stops = np.cumsum([len(k) for k in keys])
        total = _total(np.concatenate([joined(*opened(body, np.uint8), np.int32) for _, body in told_]), *_grouped(np.concatenate(keys)))
        out = [squeeze(planes(total[s])) for s in map(slice, np.append(0, stops[:-1]), stops)]
        bucket = sum(buckets) + told.column("bucket")[0].as_py()
        return pa.Table.from_batches([batch(ANSWER, [blocks, [bucket] * len(blocks), out])])

    return run


def _scorer(order: int, buckets: tuple[int, ...], stats: dict[str, int]):
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        release()  # what the block before this one held
        if not texts.num_rows:
            return schema.empty_table()
        x = Block(texts.column("body").to_pylist(), order)
        told = _rows_of(answers, "bucket")
        c = np.concatenate([joined(opened(body, np.uint8, np.uint8)[0], np.int64) for i, body in told if i < sum(buckets)])
        follow = np.zeros_like(c)  # the longest n-grams are no histories
        some = np.concatenate([joined(*opened(body, np.uint8), np.int64) for i, body in told if i >= sum(buckets)])
        follow[: len(some)] = some
        known, base, score = x.score(c, follow, *(stats[s] for s in STATS))
        cols = [x.ids, ~x.learn, x.lens, known, np.full(len(x.ids), stats["tokens"]), base, score]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, order: int = ORDER) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model of n-grams up to ``order`` words, two at least, learns from the rows whose crc32 of the id as text is no multiple
    of ``modulus``; a null id counts as the empty text. Words are runs of other bytes than white space, A-Z lower-cased, and
    each text has an end mark, counted as a token. Null counts as the empty text: one token. base_score: unigrams
    with 0.1 added. score: the automaton's log10 probability. Without learning rows both are 0. Repeated
    rows are counted each. A text of any length is worked on whole, in one task. Ids must be integers. An empty table gives no
    rows. Further columns are ignored.
    """
    if order < 2:
        raise ValueError("an automaton needs n-grams of two words or more")
    bound_batches(docs.sparkSession)
    n = parts(docs)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), (remainder(id_col, modulus) != 0).alias("learn"), text_of(text_col).cast("binary").alias("text"))
    ask, answer = "bucket int, block long, body binary", "block long, bucket int, body binary"
    counted = rows.select("learn", "text").mapInArrow(lean(_word_counter(n)), ask).repartition(n, "bucket").sortWithinPartitions("bucket")
    found = counted.mapInArrow(lean(_word_stats), "all long, " + ", ".join(f"{s} long" for s in STATS))
    totals = found.agg(F.sum("all").alias("all"), *(F.sum(s).alias(s) for s in STATS)).first()
    stats = {s: int(totals[s] or 0) for s in STATS}
    every = int(totals["all"] or 0)
    blocks = max(1, -(-every // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).select("block", "id", "learn", "text")
    buckets = tuple(max(1, -(-every * m // (4 * BUCKET))) for m in (1, 4 * (order - 2), 4))
    n = max(n, blocks)
    packed = dealt.mapInArrow(lean(_packer), "block long, body binary").repartition(n, "block")
    asked = packed.sortWithinPartitions("block").mapInArrow(lean(_asker(order, buckets)), ask).repartitionById(sum(buckets), "bucket")  # a bucket each
    first = asked.sortWithinPartitions("bucket", "block").mapInArrow(lean(_answerer), answer).repartition(n, "block")
    own = packed.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_follower(order, buckets), ask).repartitionById(sum(buckets), "bucket")
    second = asked.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(_follow_answerer(buckets), answer).repartition(n, "block")
    names = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = packed.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInArrow(_scorer(order, buckets, stats), names)
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

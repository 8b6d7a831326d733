"""Removal of word passages that repeat an earlier one: seed and extend over winnowed anchors.

A window is ``length`` consecutive words of one document. Winnowing gives each window one anchor, the
k-gram with the smallest fingerprint inside it, a function of the window's words alone, so equal
windows in any two places share their anchor. Neighbouring windows mostly share theirs, so anchors are few.

1. Documents are dealt into blocks by hash. Each block asks which of its distinct anchors other blocks hold too.
2. In a block, equal windows are found directly. The first of each that has an anchor of another block as well goes, as
   the words around that anchor, to the anchor's bucket.
3. A bucket joins the occurrences of an anchor and extends them to both sides to maximal repeats of ``length`` words or more.
4. Each block gets the runs to remove and cuts them from its texts.

A fingerprint only proposes: where two places are to repeat, the words of the whole maximal repeat are compared, and
where these differ, window by window. A passage of a third of all documents sends one row per block. Texts are shuffled
once; all three passes over them read the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import BLOCK_BYTES, by_bucket, opened, slices, squeeze, stepped, steps
from .tables import NULL_ID, batch, bound_batches, buffers, lean, parts, release, text_of
from .textops import grams, mix, words

#: Words of an anchor.
ANCHOR = 8
#: Bytes of texts whose anchors one bucket gets, the same for the words around them, and windows that a bucket works on at
#: once (one anchor can have more).
ASK_BYTES, BUCKET_BYTES, TOGETHER = 64 << 20, 16 << 20, 1 << 19
ASK = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])
TOLD = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary())])
RUNS = pa.schema([("block", pa.int64()), ("body", pa.binary())])
I = np.int64


class Text:
    """A text's words joined by single spaces, and where each begins."""

    def __init__(self, raw: bytes) -> None:
        each = raw.split()
        self.body = b" ".join(each)
        self.at = np.append(0, np.cumsum(np.fromiter(map(len, each), I, len(each)) + 1))

    def words(self, start: int, n: int) -> bytes:
        return self.body[self.at[start] : self.at[start + n] - 1]


def find_repeats(mark: np.ndarray, rank: np.ndarray, doc: np.ndarray, at: np.ndarray, texts: Callable[[int], Text], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(again, first) of windows that are given in the order of ``rank`` wherever their words are equal.

    again: an equal window has a smaller rank. first: the window stands for all that are equal to it. ``mark`` is a
    fingerprint of a window's words, doc and at where it begins. Equal marks propose; maximal runs of them on one
    diagonal are compared by their words.
    """
    again, first = np.zeros(len(mark), bool), np.ones(len(mark), bool)
    order = np.argsort(mark, kind="stable")
    opens = np.r_[True, mark[order][1:] != mark[order][:-1]] if len(mark) else np.zeros(0, bool)
    head = order[np.maximum.accumulate(np.where(opens, np.arange(len(mark)), 0))] if len(mark) else order
    t, g = order[~opens], head[~opens]
    if not len(t):
        return again, first
    by = np.argsort(t)
    t, g = t[by], g[by]
    on = (doc[t][1:] == doc[t][:-1]) & (at[t][1:] == at[t][:-1] + 1) & (doc[g][1:] == doc[g][:-1]) & (at[g][1:] == at[g][:-1] + 1)
    cut = np.flatnonzero(np.r_[True, ~on])
    n = np.diff(cut, append=len(t))
    same = np.ones(len(t), bool)
    places = zip(cut.tolist(), n.tolist(), doc[t[cut]].tolist(), at[t[cut]].tolist(), doc[g[cut]].tolist(), at[g[cut]].tolist(), strict=True)
    for c, k, d, a, other, b in places:
        size = k + length - 1
        if texts(d).words(a, size) != texts(other).words(b, size):
            same[c : c + k] = False
    again[t[same]] = rank[t[same]] > rank[g[same]]
    first[t[same]] = False
    if not same.all():  # unequal words with one fingerprint: their windows are told apart by words
        held: dict[bytes, int] = {}
        for w in order[np.isin(mark[order], mark[t[~same]])].tolist():
            other = held.setdefault(texts(int(doc[w])).words(int(at[w]), length), w)
            again[w], first[w] = rank[w] > rank[other], other == w
    return again, first


class Block:
    """A block's documents in the order of (id, sub), with their windows."""

    def __init__(self, table: pa.Table, length: int, bits: int) -> None:
        table = table.sort_by([("id", "ascending"), ("sub", "ascending")]).combine_chunks()
        self.ids, self.subs = table["id"].to_numpy(), table["sub"].to_numpy()
        self.raw = table["text"]
        raw, offs = buffers(self.raw.chunk(0)) if table.num_rows else (b"", np.zeros(1, I))
        h, at = words(raw, offs, lower=False)
        sizes = np.diff(at)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.arange(len(h)) - np.repeat(at[:-1], sizes)
        whole = np.flatnonzero(np.repeat(sizes, sizes) - self.at >= length)
        self.doc, self.at = self.doc[whole], self.at[whole]
        self.anchor, self.mark = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(whole):
            k = min(ANCHOR, length)
            low, width, span = grams(h, k), 1, length - k + 1
            while width * 2 <= span:
                low, width = np.minimum(low[:-width], low[width:]), width * 2
            if width < span:
                low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
            # The least of several fingerprints is a low number: mixed, anchors are even over the range that buckets share.
            self.anchor, self.mark = mix(low[whole]), grams(h, length)[whole] >> np.uint64(64 - bits)
        self.asked = np.unique(self.anchor)
        self.held: dict[int, Text] = {}

    def text(self, d: int) -> Text:
        if d not in self.held:
            self.held[d] = Text(self.raw[d].as_py())
        return self.held[d]

    def rank(self) -> np.ndarray:
        """Places in the order of (id, sub, at); rows that share id and text have the same places."""
        new = np.r_[True, (self.ids[1:] != self.ids[:-1]) | (self.subs[1:] != self.subs[:-1])]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first of such rows
        begin = np.searchsorted(self.doc, np.arange(len(self.ids)))
        return begin[lead[self.doc]] + np.arange(len(self.doc)) - begin[self.doc]


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of neighbouring windows begin, and how many windows they have."""
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]) if len(doc) else np.zeros(0, I)
    return cut, np.diff(cut, append=len(doc))


def _asker(length: int, buckets: int, bits: int):
    def run(key, table):
        release()  # what the block before this one held
        x = Block(table, length, bits)
        rows = [(b, key[0].as_py(), squeeze(steps(x.asked[i:j]))) for b, i, j in slices(x.asked, buckets)]
        return pa.Table.from_batches([batch(ASK, list(zip(*rows, strict=True)))] if rows else [], ASK)

    return run


def _answerer(batches):
    """A bit for each key of each row: whether another block has it too."""

    def answer(bucket, blocks, bodies):
        keys = [stepped(opened(b, np.uint8)[0]) for b in bodies]
        every = np.sort(np.concatenate(keys))
        both = np.unique(every[1:][every[1:] == every[:-1]])
        told = []
        for k in keys:
            place = np.minimum(np.searchsorted(both, k), len(both) - 1)
            told.append(squeeze(np.packbits(both[place] == k if len(both) else np.zeros(len(k), bool))))
        return batch(TOLD, [blocks, [bucket] * len(blocks), told])

    yield from by_bucket(batches, answer)


def _seeder(length: int, asks: int, buckets: int, bits: int):
    """A block's rows for the buckets of its anchors; a negative bucket is a message for the block itself."""

    def run(key, table, told):
        release()
        block, x = key[0].as_py(), Block(table, length, bits)
        if not len(x.doc):
            return ASK.empty_table()
        bits_of = dict(zip(told["bucket"].to_pylist(), told["body"].to_pylist(), strict=True))
        shared = np.zeros(len(x.asked), bool)
        for b, i, j in slices(x.asked, asks):
            shared[i:j] = np.unpackbits(opened(bits_of[b], np.uint8)[0], count=j - i).astype(bool)
        again, first = find_repeats(x.mark, x.rank(), x.doc, x.at, x.text, length)
        rows = []
        if again.any():
            doc, at = x.doc[again], x.at[again]
            cut, n = _runs(doc, at)
            rows.append((-1 - block % buckets, block, squeeze(x.ids[doc[cut]], x.subs[doc[cut]], at[cut], n)))
        go = np.flatnonzero(first)
        go = go[shared[np.searchsorted(x.asked, x.anchor[go])]]
        if len(go):
            # One entry for each run of windows with the same anchor, in the order of anchors.
            anchor, doc, at = x.anchor[go], x.doc[go], x.at[go]
            cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])
            n = np.diff(cut, append=len(go))
            by = np.argsort(anchor[cut], kind="stable")
            cut, n = cut[by], n[by]
            anchor, doc, at = anchor[cut], doc[cut], at[cut]
            for b, i, j in slices(anchor, buckets):
                bodies = [x.text(d).words(a, k + length - 1) for d, a, k in zip(doc[i:j].tolist(), at[i:j].tolist(), n[i:j].tolist(), strict=True)]
                lens = np.fromiter(map(len, bodies), I, len(bodies))
                rows.append((b, block, squeeze(steps(anchor[i:j]), x.ids[doc[i:j]], x.subs[doc[i:j]], at[i:j], n[i:j], lens, np.frombuffer(b"".join(bodies), np.uint8))))
        return pa.Table.from_batches([batch(ASK, list(zip(*rows, strict=True)))] if rows else [], ASK)

    return run


def _joined(blocks: list[int], bodies: list[bytes], length: int, bits: int):
    """(block, packed runs) of the windows that repeat an earlier one of another block."""
    got = [opened(b, np.uint8, I, I, I, I, I, np.uint8) for b in bodies]
    anchor = np.concatenate([stepped(x[0]) for x in got])
    ids, subs, start, n, lens = (np.concatenate([x[k] for x in got]) for k in range(1, 6))
    home = np.repeat(np.array(blocks, I), [len(x[1]) for x in got])
    body = np.concatenate([x[6] for x in got])
    del got
    offs = np.cumsum(lens) - lens
    order = np.lexsort((start, subs, ids, anchor))
    cuts = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])  # an anchor's entries stay together
    total = np.cumsum(n[order])
    told: dict[int, list] = {}
    lo = 0
    while lo < len(order):
        ends = cuts[np.searchsorted(cuts, lo, "right") :]
        past = np.searchsorted(total, (total[lo - 1] if lo else 0) + TOGETHER)
        hi = int(next(iter(ends[ends > past]), len(order))) if len(ends) else len(order)
        e = order[lo:hi]
        lo = hi
        raw = [body[offs[k] : offs[k] + lens[k]].tobytes() for k in e.tolist()]
        h, at = words(b"".join(raw), np.append(0, np.cumsum(lens[e])), lower=False)
        sizes = np.diff(at)
        doc = np.repeat(np.arange(len(e)), sizes)
        place = np.arange(len(h)) - np.repeat(at[:-1], sizes)
        whole = np.flatnonzero(np.repeat(sizes, sizes) - place >= length)
        doc, place = doc[whole], place[whole]
        held: dict[int, Text] = {}

        def text(d: int, raw=raw, held=held) -> Text:
            if d not in held:
                held[d] = Text(raw[d])
            return held[d]

        again, _ = find_repeats(grams(h, length)[whole] >> np.uint64(64 - bits), np.arange(len(doc)), doc, place, text, length)
        doc, place = doc[again], place[again]
        cut, count = _runs(doc, place)
        d = e[doc[cut]]
        for b in np.unique(home[d]).tolist():
            own = home[d] == b
            told.setdefault(b, []).append((ids[d[own]], subs[d[own]], (start[d] + place[cut])[own], count[own]))
    for b, each in told.items():
        yield b, squeeze(*(np.concatenate(c) for c in zip(*each, strict=True)))


def _extender(length: int, bits: int):
    """Streams over packed rows sorted by bucket; messages of blocks to themselves go through."""

    def run(batches):
        def answer(bucket, blocks, bodies):
            rows = list(zip(blocks, bodies, strict=True)) if bucket < 0 else list(_joined(blocks, bodies, length, bits))
            return batch(RUNS, list(zip(*rows, strict=True)) if rows else [[], []])

        yield from by_bucket(batches, answer)

    return run


def _remover(length: int, with_text: bool, carry: pa.DataType | None):
    kinds = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text

    def run(table, told):
        runs: dict[tuple[int, int], list] = {}
        for body in told["body"].to_pylist():
            ids, subs, start, n = opened(body, I, I, I, I)
            for i, s, a, k in zip(ids.tolist(), subs.tolist(), start.tolist(), n.tolist(), strict=True):
                runs.setdefault((i, s), []).append((a, k))
        seen: set[tuple[int, int]] = set()
        out = []
        for i, s, raw in zip(table["id"].to_pylist(), table["sub"].to_pylist(), table["text"].to_pylist(), strict=True):
            kept = raw.split()
            n = len(kept)
            if (i, s) in seen and n >= length:  # each window of a row that repeats id and text starts in the row before it
                kept = []
            elif (found := runs.get((i, s))) is not None:
                cover = np.zeros(n + 1, I)
                starts, counts = np.array(found, I).T
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + counts + length - 1, -1)
                kept = [w for w, gone in zip(kept, np.cumsum(cover[:n]).tolist(), strict=True) if not gone]
            seen.add((i, s))
            joined = b" ".join(kept)
            out.append((i, n, n - len(kept), hashlib.sha256(joined).hexdigest(), (joined if len(kept) < n else raw).decode() if with_text else None)[: len(kinds)])
        cols = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for _, t in kinds]
        names = [k for k, _ in kinds]
        if carry is not None:
            cols.append(table["carry"])
            names.append("carry")
        return pa.Table.from_arrays(cols, names)

    return run


def _order_key(text: Column) -> Column:
    """60 bits of a text's SHA-256: the order of rows that share an id."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, with_text: bool = False, carry: Sequence[str] = (), bits: int = 64) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text and the columns ``carry``.

    A word goes when a window of ``length`` words that covers it also starts earlier: in a document of
    smaller id, or earlier in the same one. Windows are judged on the input. Kept words are
    joined by one space; kept_text is the text as it was where nothing went. A null or empty text has no words. A null id is
    smaller than any other and comes back as null. Each row is a document of its own, also where ids repeat or are null:
    those that share an id come in the order of their texts' SHA-256; of rows that share the text too, one is the first.
    An empty table gives no rows. Ids must be integers; further columns are ignored. ``bits`` is the size of the window
    fingerprints; the result doesn't depend on it.
    """
    bound_batches(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id")
    text = text_of(text_col).cast("binary")
    rows = docs.select(key, _order_key(text).alias("sub"), text.alias("text"), *[F.struct(*carry).alias("carry")] * bool(carry))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(parts(docs), -(-size // (4 * BLOCK_BYTES)))
    blocks = max(1, -(-size // BLOCK_BYTES))
    asks, buckets = max(1, -(-size // ASK_BYTES), min(n, blocks)), max(1, -(-size // BUCKET_BYTES), min(n, blocks))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "sub"), F.lit(blocks))).repartition(n, "block")
    each = dealt.groupBy("block")
    ask, told = "bucket long, block long, body binary", "block long, bucket long, body binary"
    # Buckets are numbered, so partitions get equally many of them.
    asked = each.applyInArrow(_asker(length, asks, bits), ask).repartitionById(min(n, asks), F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    answers = asked.mapInArrow(lean(_answerer), told).repartition(n, "block")
    work = each.cogroup(answers.groupBy("block")).applyInArrow(_seeder(length, asks, buckets, bits), ask)
    work = work.repartitionById(buckets, F.pmod("bucket", F.lit(buckets)).cast("int")).sortWithinPartitions("bucket")
    runs = work.mapInArrow(lean(_extender(length, bits)), "block long, body binary").repartition(n, "block")
    kind = rows.schema["carry"].dataType.simpleString() if carry else ""
    names = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text + (f", carry {kind}" if carry else "")
    out = each.cogroup(runs.groupBy("block")).applyInArrow(_remover(length, with_text, pa.null() if carry else None), names)
    back = F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col)
    return out.select(back, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text, *(F.col("carry")[c].alias(c) for c in carry))

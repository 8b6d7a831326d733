"""Near-duplicate detection by one-permutation MinHash with optimal densification.

One pass makes, per document, its set of distinct word shingles (64-bit fingerprints), a digest of
the set, and a one-permutation signature: the fingerprints' top bits choose the bin and the smallest
fingerprint of a bin is its value, so sorting the set is all the hashing there is. An empty bin
borrows from the first non-empty one along its own fixed pseudo-random probe order (optimal
densification). The signature is cut into bands whose keys are the buckets. A set of at most ``SMALL``
shingles, where few bins are full, also gets a key for each subset that a linked set could share with it.

Documents with equal sets fold into one class first. Within a bucket each class is linked to the
bucket's smallest class only (a star), so candidates grow with the bucket's size and not with its
square; every candidate is confirmed on the two full sets. A star misses links between two members
that both differ from its centre. Rounds with new centres therefore follow in every bucket whose
members still lie in several components, until each bucket has compared all it must. No bucket or
candidate list has a cap. Before these rounds an exact bound thins the buckets: a link across components
needs enough of a document's shingles to occur in other components at all, and documents with fewer
leave. This keeps a family of thousands of copies from meeting its rim of too different ones. A part of a bucket
tells only the links that join two of its components, a spanning forest, and a pair that shares
several buckets is told in one of them, so that a round's links grow with members and not with pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import batch, bound_batches, buffers, discard, join_hot, lean, materialise, parts, text_of
from .textops import grams, mix, words

BINS, ROWS = 128, 4
#: Sets of at most so many shingles get subset keys besides their bands.
SMALL = 9
#: New centres of a bucket in each later round, and shingles that they have together at most (one centre can have more).
CENTRES, SHINGLES = 4096, 4_000_000
#: Documents compared with one copy of a centre's text.
CHUNK = 64
#: Members of a bucket that meet one copy of its new centres.
PART = 1000


@cache
def _probes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(0xB1D5))
    probes = np.stack([np.concatenate([[i], rng.permutation(np.delete(np.arange(BINS), i))]) for i in range(BINS)])
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    return probes, edges, rng.integers(0, 1 << 64, size=ROWS, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation signature of a sorted set of at least one fingerprint."""
    probes, edges, _ = _probes()
    at = np.append(np.searchsorted(shingles, edges), len(shingles))
    full = at[1:] > at[:-1]
    low = shingles[np.minimum(at[:-1], len(shingles) - 1)]
    if full.all():
        return low
    return low[probes[np.arange(BINS), np.argmax(full[probes], axis=1)]]


def band_keys(sig: np.ndarray) -> np.ndarray:
    _, _, odd = _probes()
    bands = sig.reshape(-1, ROWS)
    return mix((bands * odd).sum(axis=1, dtype=np.uint64) + np.arange(len(bands), dtype=np.uint64)).view(np.int64)


def subset_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a small set and of its subsets that a linked set can consist of or share with it: two linked sets have
    at least ``percent`` of either in common, so they meet in the key of their intersection."""
    spare = len(s) * (100 - percent) // 100
    if len(s) > SMALL or math.comb(len(s), spare) > 64:
        return np.zeros(0, np.int64)
    each = mix(s)
    gone = np.array([each[list(g)].sum(dtype=np.uint64) for k in range(spare + 1) for g in itertools.combinations(range(len(s)), k)], np.uint64)
    return mix(each.sum(dtype=np.uint64) - gone ^ np.uint64(0x534D414C4C)).view(np.int64)


def bucket_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The distinct buckets of a set of at least one fingerprint."""
    return np.unique(np.concatenate([band_keys(signature(s)), subset_keys(s, percent)]))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def shingle_sets(raw, offs: np.ndarray, size: int):
    """The sorted shingle set of every document of a batch."""
    h, at = words(raw, offs, lower=True)
    g = grams(h, size)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            yield np.unique(g[a : b - size + 1])
        elif b > a:
            yield grams(h[a:b], int(b - a))  # the whole sequence; its length is part of the hash
        else:
            yield h[:0]


def _signer(size: int, percent: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def sign(batches):
        for b in batches:
            raw, offs = buffers(b.column(1))
            n, digests, keys, at = [], [], [], [0]
            for s in shingle_sets(raw, offs, size):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    keys.append(bucket_keys(s, percent))
                at.append(at[-1] + (len(keys[-1]) if len(s) else 0))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield batch(schema, [b.column(0), n, digests, lists])

    return sign


def _confirmer(size: int, percent: int):
    """Streams over (centre, salt, tag, id, text) sorted by the first three; tag 0 is the centre's text."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("linked", pa.bool_())])

    def confirm(batches):
        key, sets = None, []
        for b in batches:
            centre, salt, tag, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            raw, offs = buffers(b.column(4))
            u, v, ok = [], [], []
            for i, s in enumerate(shingle_sets(raw, offs, size)):
                if (centre[i], salt[i]) != key:
                    key, sets = (centre[i], salt[i]), []
                if tag[i] == 0:
                    sets.append(s)
                    continue
                hit = False
                for c in sets:  # more than one only where rows repeat an id
                    hit |= bool(len(s)) and (100 + percent) * shared(c, s) >= percent * (len(c) + len(s))
                u.append(centre[i])
                v.append(ids[i])
                ok.append(hit)
            if u:
                yield batch(schema, [np.array(u, np.int64), np.array(v, np.int64), ok])

    return confirm


def _lister(size: int):
    """(id, comp, n, text) to a row for each shingle."""
    schema = pa.schema([("id", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("s", pa.int64())])

    def spread(batches):
        for b in batches:
            ids, comp, n = (b.column(i).to_numpy() for i in range(3))
            raw, offs = buffers(b.column(3))
            sets = list(shingle_sets(raw, offs, size))
            lens = [len(s) for s in sets]
            if sum(lens):
                yield batch(schema, [*(np.repeat(x, lens) for x in (ids, comp, n)), np.concatenate(sets).view(np.int64)])

    return spread


def _thin(left: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``left`` (key, id, n, comp) without rows that can have no link to another component.

    Two sets of m and n shingles are linked only if both share percent / (100 + percent) of m + n, so a row leaves
    when the shingles of its document that occur in other components at all are fewer even with its bucket's smallest set.
    """
    docs = left.groupBy("id", "comp").agg(F.min("n").alias("n"))
    spread = docs.join(texts, "id").select("id", "comp", "n", "text").mapInArrow(lean(_lister(size)), "id long, comp long, n long, s long")
    rows = materialise(spread.select("id", "comp", "s").distinct(), "shingles")
    across = rows.groupBy("s").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("m")).filter("a <> b").select("s", "m")
    across = materialise(across, "across")
    counts = join_hot(rows, across, "s").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    buckets = materialise(left.groupBy("key").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("m")), "buckets")
    enough = F.expr(f"{100 + percent} * shared >= {percent} * (n + greatest(least, ceil(n * {percent} / 100)))")
    out = _open(join_hot(left, buckets, "key").join(counts, "id").filter(enough).select("key", "id", "n", "comp"))
    discard(rows, across, buckets)
    return out


def _compare(pairs: DataFrame, texts: DataFrame, size: int, percent: int, n: int) -> DataFrame:
    """(u, v, linked) of the candidate pairs (u, v). A frequent u is split into chunks, each with a copy of its text."""
    many = materialise(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("m")), "many")
    dealt = join_hot(pairs, many, "u").select("u", "v", F.pmod(F.xxhash64("v"), (F.col("m") / CHUNK).cast("int") + 1).alias("salt"))
    dealt = materialise(dealt, "dealt")
    need = dealt.select("u", "salt", F.lit(1).alias("tag"), F.col("v").alias("id")).unionByName(dealt.select("u", "salt", F.lit(0).alias("tag"), F.col("u").alias("id")).distinct())
    rows = need.join(texts, "id").select("u", "salt", "tag", "id", "text").repartition(n, "u", "salt").sortWithinPartitions("u", "salt", "tag")
    out = materialise(rows.mapInArrow(lean(_confirmer(size, percent)), "u long, v long, linked boolean"), "tested")
    discard(many, dealt)
    return out


class Forest:
    """Union-find over the components that meet in one part of a bucket."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class Centres:
    """A part's new centres, as one inverted index of their shingles."""

    def __init__(self, percent: int) -> None:
        self.percent, self.sets, self.comps, self.keys, self.index = percent, [], [], {}, None

    def add(self, comp: int, s: np.ndarray) -> None:
        self.sets.append(s)
        self.comps.append(int(comp))

    def met(self, s: np.ndarray) -> np.ndarray:
        """The centres that a set is linked with."""
        if self.index is None:
            lens = np.array([len(c) for c in self.sets])
            values = np.concatenate(self.sets)
            order = np.argsort(values, kind="stable")
            self.index = values[order], np.repeat(np.arange(len(lens), dtype=np.int32), lens)[order], lens
        values, owner, lens = self.index
        low, high = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(lens))
        return np.flatnonzero((100 + self.percent) * both >= self.percent * (lens + len(s)))

    def told_here(self, key: int, i: int, own: np.ndarray) -> bool:
        """Whether ``key`` is the first bucket that centre i shares with the set whose buckets are ``own``."""
        if i not in self.keys:
            self.keys[i] = bucket_keys(self.sets[i], self.percent)
        both = np.intersect1d(self.keys[i], own, assume_unique=True)
        return len(both) > 0 and both[0] == key


def _meeter(size: int, percent: int):
    """Streams over (key, salt, tag, comp, text) sorted by the first three: a bucket's new centres (tag 0), then its
    members. Each member meets all centres; pairs of components that a link joins come out, a spanning forest of each part."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def meet(batches):
        at, centres, forest = None, None, None
        for b in batches:
            key, salt, tag, comp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            raw, offs = buffers(b.column(4))
            u, v = [], []
            for i, s in enumerate(shingle_sets(raw, offs, size)):
                if (key[i], salt[i]) != at:
                    at, centres, forest = (key[i], salt[i]), Centres(percent), Forest()
                if tag[i] == 0:
                    centres.add(comp[i], s)
                    continue
                own, mine = None, int(comp[i])
                for c in centres.met(s):
                    other = centres.comps[c]
                    if forest.root(other) == forest.root(mine):
                        continue
                    own = bucket_keys(s, percent) if own is None else own
                    if centres.told_here(key[i], c, own):
                        forest.join(other, mine)
                        u.append(other)
                        v.append(mine)
            if u:
                yield batch(schema, [np.array(u, np.int64), np.array(v, np.int64)])

    return meet


def _meet(left: DataFrame, heads: DataFrame, buckets: DataFrame, texts: DataFrame, size: int, percent: int, n: int) -> DataFrame:
    """Pairs of components that links between the new centres ``heads`` of buckets and all members join.
    A large bucket is dealt out in parts, each with a copy of the centres."""
    salts = (F.col("m") / PART).cast("int")
    met = buckets.join(heads.select("key").distinct(), "key", "left_semi")
    members = join_hot(left, met, "key").select("key", F.pmod(F.xxhash64("id"), salts + 1).alias("salt"), F.lit(1).alias("tag"), "id", "comp")
    centres = heads.join(met, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long"))).alias("salt"), F.lit(0).alias("tag"), "id", "comp")
    rows = centres.unionByName(members).join(texts, "id").select("key", "salt", "tag", "comp", "text")
    return rows.repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "tag").mapInArrow(lean(_meeter(size, percent)), "u long, v long").distinct()


def _open(left: DataFrame) -> DataFrame:
    """The rows (key, id, n, comp) of buckets whose members lie in several components, written."""
    left = materialise(left, "left")
    wide = left.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("m")).filter("a <> b").select("key", "m")
    wide = materialise(wide, "wide")
    out = materialise(join_hot(left, wide, "key").select("key", "id", "n", "comp"), "open")
    discard(left, wide)
    return out


def _rounds(left: DataFrame, texts: DataFrame, size: int, percent: int, n: int) -> DataFrame | None:
    """(id, component) of components that links inside open buckets join; None where there is no such link."""
    joined, merged = None, None
    while not left.isEmpty():
        # New centres: members outside the bucket's largest component, at most CENTRES of them at a time.
        sizes = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
        buckets = materialise(sizes.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("big"), F.sum("k").alias("m")), "buckets")
        order = Window.partitionBy("key").orderBy("comp", "id")
        heads = join_hot(left, buckets, "key").filter("comp <> big").withColumn("k", F.row_number().over(order)).filter(f"k <= {CENTRES}")
        heads = heads.withColumn("sum", F.sum("n").over(order)).filter(f"k = 1 or sum <= {SHINGLES}").select("key", "comp", "id")
        heads = materialise(heads, "heads")
        found = materialise(_meet(left, heads, buckets, texts, size, percent, n), "found")
        rest = left.join(heads.select("key", "id"), ["key", "id"], "left_anti")
        if not found.isEmpty():
            joined = found if joined is None else materialise(joined.unionByName(found), "joined")
            merged = components(joined)
            now = merged.select(F.col("id").alias("comp"), "component")
            rest = rest.join(now, "comp", "left").select("key", "id", "n", F.coalesce("component", "comp").alias("comp"))
        rest = _open(rest)
        discard(left, buckets, heads)
        left = rest
    discard(left)
    return merged


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of distinct
    ``size``-word shingles (A-Z lower-cased; a shorter text is one shingle). component_id is the
    smallest id reachable over links, itself included; kept says that it is the row's own.
    A null or empty text or one of white space only has an empty set and no links. Rows that
    share an id are one document, with the links of all its texts. A row with a null id has no links, a null
    component_id and is kept. An empty table gives an empty result; further columns are ignored. Ids must be integers.
    """
    bound_batches(docs.sparkSession)
    n = parts(docs)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    signed = materialise(source.mapInArrow(lean(_signer(size, percent)), "id long, n long, digest binary, keys array<long>"), "signatures")
    some = signed.filter("n > 0 and id is not null")
    classes = some.groupBy("digest").agg(F.min(F.struct("id", "n", "keys")).alias("r"), F.count(F.lit(1)).alias("m"))
    classes = materialise(classes.select("digest", "r.id", "r.n", "r.keys", "m"), "classes")
    reps = classes.select("digest", F.col("id").alias("rep"), "m")
    copies = join_hot(some.select("id", "digest"), reps, "digest").select(F.col("id").alias("u"), F.col("rep").alias("v")).filter("u <> v").distinct()

    bands = classes.select("id", "n", F.explode("keys").alias("key"))
    star = bands.groupBy("key").agg(F.min("id").alias("c"), F.max("id").alias("top"), F.count(F.lit(1)).alias("m")).filter("c <> top").select("key", "c", "m")
    star = materialise(star, "stars")
    members = materialise(join_hot(bands, star, "key").select("key", "id", "n", "c"), "members")  # of buckets of two documents or more
    texts = materialise(source.join(members.select("id").distinct(), "id", "left_semi"), "texts")

    sizes = classes.groupBy(F.col("id").alias("u")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    pairs = members.withColumnRenamed("n", "vn").filter("id <> c").select(F.col("c").alias("u"), F.col("id").alias("v"), "vn").distinct()
    pairs = pairs.join(sizes, "u").filter(f"vn * 100 >= least * {percent} and most * 100 >= vn * {percent}").select("u", "v")
    pairs = materialise(pairs, "pairs")
    tested = _compare(pairs, texts, size, percent, n)
    same = components(tested.filter("linked").select("u", "v").unionByName(copies))

    # Centres that met their whole bucket need not meet it again.
    left = members.filter("id <> c").select("key", "id", "n")
    left = _open(left.join(same, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp")))
    discard(classes, star, members, pairs, tested)
    if not left.isEmpty():
        open_, left = left, _thin(left, texts, size, percent)
        discard(open_)
    merged = _rounds(left, texts, size, percent, n)
    discard(texts)
    out = signed.select("id", "n").join(same, "id", "left").select("id", "n", F.coalesce("component", "id").alias("c"))
    if merged is not None:
        out = out.join(merged.select(F.col("id").alias("c"), "component"), "c", "left").select("id", "n", F.coalesce("component", "c").alias("c"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("c").eqNullSafe(F.col("id")).alias("kept"))

"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces of equal length are exchangeable, so the packing is planned on the histogram of piece lengths, which
has at most as many entries as the longest permitted length, whatever the input's size. Best-fit
decreasing runs on it with multiplicities: all pieces of a length go into all bins of the fullest fitting kind
at once. Several rules for opening bins are planned over all permitted lengths jointly, each bin is then
downsized to the smallest length that holds its contents, and the cheapest plan is carried out.

Pieces get their slots by rank among the pieces of their length. Ranks are counted in groups of about ``GROUP`` pieces of a
length, so that a length of a third of all pieces becomes as many groups as it needs.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise, text_of

SIZES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length.
OVERHEAD = 16
GROUP = 1 << 16
#: Rules: a new bin is the least-cost size of those at least so many times its first piece.
ROOM = (1.0, 1.25, 1.5, 2.0, 3.0, 4.0, 8.0, 1e9)


@dataclass(frozen=True)
class Kind:
    """``bins`` bins alike: pairs (piece length, how many of them) in order."""

    bins: int
    items: tuple[tuple[int, int], ...]

    @property
    def fill(self) -> int:
        return sum(n * k for n, k in self.items)


def _plan(histogram: dict[int, int], sizes: tuple[int, ...], room: float, cost) -> list[Kind]:
    open_: dict[int, list[Kind]] = {}  # by space left
    spaces: list[int] = []
    done: list[Kind] = []

    def put(space: int, kind: Kind) -> None:
        if not kind.bins:
            return
        if not space:
            done.append(kind)
            return
        if space not in open_:
            open_[space] = []
            insort(spaces, space)
        open_[space].append(kind)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                kind = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[i]
            else:
                fits = [s for s in sizes if s >= length * room] or [sizes[-1]]
                space = min(fits, key=lambda s: (cost(s) / (s // length * length), s))
                kind = Kind(-(-left // (space // length)), ())
            each = space // length
            whole = min(kind.bins, left // each)
            put(space - each * length, Kind(whole, (*kind.items, (length, each))))
            left -= whole * each
            rest = kind.bins - whole
            if rest and left:  # fewer than fill one more bin
                put(space - left * length, Kind(1, (*kind.items, (length, left))))
                left, rest = 0, rest - 1
            if kind.items:
                put(space, Kind(rest, kind.items))
    return done + [k for ks in open_.values() for k in ks]


def plan(histogram: dict[int, int], sizes=SIZES, overhead: int = OVERHEAD) -> list[tuple[int, Kind]]:
    """(permitted length, bins alike) of the cheapest plan. Every piece has a place in it."""
    sizes = tuple(sorted(set(sizes)))
    histogram = {int(n): int(k) for n, k in histogram.items() if k}
    if histogram and not 0 < min(histogram) <= max(histogram) <= sizes[-1]:
        raise ValueError("piece lengths must lie between 1 and the longest permitted length")
    cost = lambda s: s + overhead
    best = None
    for room in ROOM:
        kinds = [(sizes[bisect_left(sizes, k.fill)], k) for k in _plan(histogram, sizes, room, cost)]
        total = sum(cost(s) * k.bins for s, k in kinds)
        if best is None or total < best[0]:
            best = total, kinds
    return sorted(best[1], key=lambda x: (-x[0], x[1].items, x[1].bins)) if best else []


def most_slots(longest: int) -> int:
    """A bound on the slots of a plan: a length leaves two kinds more than it found at most, besides one it opens, and the
    distinct lengths of a bin add up to ``longest`` at most."""
    return 3 * longest * math.isqrt(2 * longest)


def pieces(docs: DataFrame, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length) of every document: its words and one end mark, cut at ``longest``.

    A null or empty text is its end mark alone. start counts words from 0.
    """
    n = F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
    rows = docs.select(F.col(id_col).alias("id"), n.alias("n"))
    rows = rows.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest).cast("long"))).alias("piece"))
    return rows.select("id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("length"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes=SIZES, overhead: int = OVERHEAD) -> DataFrame:
    """One row per piece: id, piece, start, length, bin_id, bin_size, bin_offset.

    No piece is dropped or shortened; the pieces of a bin lie next to each other from offset 0 and
    bin_size is the smallest permitted length that holds them. Rows that repeat are packed each on
    their own, and so are those with a null id. An empty table gives no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    sizes = tuple(sorted(set(sizes)))
    rows = materialise(pieces(docs, sizes[-1], id_col, text_col), "pieces")
    # At most sizes[-1] rows, one for each length: collected, and broadcast as the number of each length's groups.
    lengths = materialise(rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in lengths.collect()}
    groups = F.broadcast(lengths.select("length", (F.col("n") / GROUP).cast("long").alias("more")))
    salt = F.pmod(F.xxhash64("id", "piece"), F.col("more") + 1).alias("salt")
    rows = rows.join(groups, "length").select("id", "piece", "start", "length", salt)
    counts = materialise(rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "counts")
    slots, ranks, bins = [], {}, 0
    for size, kind in plan(histogram, sizes, overhead):
        offset = 0
        for length, each in kind.items:
            first = ranks.get(length, 0)
            ranks[length] = first + each * kind.bins
            slots.append((length, first, ranks[length], each, bins, offset, size))
            offset += length * each
        bins += kind.bins
    table = spark.createDataFrame(slots, "slot_length long, first long, stop long, each long, bin0 long, offset0 long, bin_size long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("id", "piece")
    ranked = rows.withColumn("k", F.row_number().over(own) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("k") + F.col("base"))
    # A proven bound: ``most_slots`` of the permitted lengths, whatever the input.
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
    at = F.col("rank") - F.col("first")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length",
        (F.col("bin0") + F.floor(at / F.col("each"))).cast("long").alias("bin_id"),
        "bin_size",
        (F.col("offset0") + F.pmod(at, F.col("each")) * F.col("length")).alias("bin_offset"),
    )

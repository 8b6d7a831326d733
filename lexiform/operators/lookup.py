"""Reuse of encoded prefixes: content digests propose, bytes decide."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import Tokenizer

MARK = 4096
#: Bounds of what is kept without a name: bytes a text needs, entries, bytes of all.
AUTO_LEAST, AUTO_ENTRIES, AUTO_BYTES = 4096, 1024, 128 << 20


def prefix(text: Column, n: Column) -> Column:
    """The first n bytes of a text."""
    return F.substring(text.cast("binary"), F.lit(1), n)


def content_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def marks(text: Column) -> Column:
    """Positions MARK * 2**k strictly inside the text, in bytes."""
    n = F.octet_length(text)
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(18)), lambda k: F.call_function("shiftleft", F.lit(MARK).cast("long"), k)), lambda p: p < n)


def mark_digests(text: Column) -> Column:
    """array<struct<pos, digest>>: the digest of the text up to each mark."""
    return F.transform(marks(text), lambda p: F.struct(p.alias("pos"), F.sha2(prefix(text, p.cast("int")), 256).alias("digest")))


def blocks(df: DataFrame, id_col: str, text_col: str, size: int = MARK) -> DataFrame:
    """(id, block, digest) of a text's whole blocks of ``size`` characters, each digest that of the text up to its end. A text
    is hashed once, by a running digest."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            h, told = hashlib.sha256(), []
            for at in range(0, len(t) - size + 1 if t else 0, size):
                h.update(t[at : at + size].encode())
                told.append(h.copy().hexdigest())
            out.append(told)
        return pa.array(out, pa.list_(pa.string()))

    return df.filter(F.length(text_col) >= size).select(id_col, F.posexplode(run(F.col(text_col))).alias("block", "digest"))


def chain(df: DataFrame, id_col: str, text_col: str, size: int = MARK) -> DataFrame:
    """(id, block, node): a node is the digest of the node before it and its own block, so that a text is hashed once."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            node, told = "", []
            for at in range(0, len(t) - size + 1 if t else 0, size):
                node = hashlib.sha256((node + t[at : at + size]).encode()).hexdigest()
                told.append(node)
            out.append(told)
        return pa.array(out, pa.list_(pa.string()))

    return df.filter(F.length(text_col) >= size).select(id_col, F.posexplode(run(F.col(text_col))).alias("block", "node"))


def chain_prefix(queries: DataFrame, nodes: DataFrame, query_id: str, text_col: str, size: int = MARK) -> DataFrame:
    """(query_id, n_blocks): how many blocks from the start are all among ``nodes`` (column node). The first that
    is missing ends the match."""
    asked = chain(queries, query_id, text_col, size).join(nodes.select("node").distinct().withColumn("_held", F.lit(True)), "node", "left")
    found = asked.groupBy(query_id).agg(F.min(F.when(F.col("_held").isNull(), F.col("block"))).alias("gap"), F.count(F.lit(1)).alias("all"))
    found = found.select(query_id, F.coalesce("gap", "all").cast("long").alias("n_blocks"))
    return queries.select(query_id).join(found, query_id, "left").select(query_id, F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def _powers(n: Column) -> Column:
    """Powers of two up to n."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k)), lambda p: p <= n)


def _digests_at(text: Column, lengths: Column) -> Column:
    """The digests of a text's beginnings of the given lengths in bytes, which are sorted: one running digest."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for t, lens in zip(texts.to_pylist(), lengths.to_pylist(), strict=True):
            if t is None or lens is None:
                out.append(None)
                continue
            data, h, at, told = memoryview(t.encode()), hashlib.sha256(), 0, []
            for n in lens:
                h.update(data[at:n])
                at = n
                told.append(h.copy().hexdigest())
            out.append(told)
        return pa.array(out, pa.list_(pa.string()))

    return run(text, lengths)


def longest_prefix(queries: DataFrame, entries: DataFrame, query_id: str, query_text: str, entry_id: str, entry_text: str, bits: int = 256) -> DataFrame:
    """For each query the longest entry that begins it: (query_id, entry_id, matched_bytes), no row for a miss.

    Entries are grouped by the digest of their longest beginning of 2**k bytes; a group holds only its distinct
    lengths, so entries that all begin alike cost a query one digest per length, not one row per entry. A query is
    digested at all powers of two, then at the lengths of the groups it meets, by a running digest each time, and meets entries
    by their whole digest. Bytes decide: the longest candidate is compared, and where it isn't the query's beginning all others of
    that query are. Of equal entries the smallest id is told. Query ids must be unique. ``bits`` of a digest are kept; the
    result doesn't depend on it.
    """
    text, digits = F.col(entry_text), bits // 4
    short = lambda c: F.transform(c, lambda d: F.substring(d, 1, digits))
    e = entries.filter(F.octet_length(text) > 0).groupBy(text.alias("_et")).agg(F.min(entry_id).alias("_e"))
    e = e.withColumn("_n", F.octet_length("_et")).withColumn("_all", F.substring(content_digest(F.col("_et")), 1, digits))
    lead = e.select(F.array_max(_powers(F.col("_n"))).alias("_p"), "_et", "_n").select("_p", F.substring(F.sha2(prefix(F.col("_et"), F.col("_p")), 256), 1, digits).alias("_d"), "_n")
    lengths = lead.groupBy("_p", "_d").agg(F.collect_set("_n").alias("_ns"))
    q = queries.select(F.col(query_id).alias("_q"), F.col(query_text).alias("_qt"))
    at = q.select("_q", "_qt", _powers(F.octet_length("_qt")).alias("_ps"))
    keyed = at.select("_q", F.explode(F.arrays_zip(F.col("_ps").alias("_p"), short(_digests_at(F.col("_qt"), F.col("_ps"))).alias("_d"))).alias("k")).select("_q", "k._p", "k._d")
    asked = keyed.join(lengths, ["_p", "_d"]).groupBy("_q").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_ns")))).alias("_ns")).join(q, "_q")
    fits = asked.select("_q", "_qt", F.filter("_ns", lambda n: n <= F.octet_length("_qt")).alias("_ns"))
    tried = fits.select("_q", F.explode(F.arrays_zip(F.col("_ns").alias("_n"), short(_digests_at(F.col("_qt"), F.col("_ns"))).alias("_all"))).alias("t")).select("_q", "t._n", "t._all")
    met = tried.join(e.select("_n", "_all", "_e"), ["_n", "_all"]).select("_q", "_e", "_n")
    true = lambda c: c.join(e.select("_e", "_et"), "_e").join(q, "_q").filter(F.col("_qt").startswith(F.col("_et"))).select("_q", "_e", "_n")
    best = lambda c: c.groupBy("_q").agg(F.min_by(F.struct("_e", "_n"), F.struct(-F.col("_n"), F.col("_e"))).alias("b")).select("_q", "b.*")
    held = true(best(met))
    others = best(true(met.join(held.select("_q"), "_q", "left_anti")))  # none, unless a digest was wrong
    return held.unionByName(others).select(F.col("_q").alias(query_id), F.col("_e").alias(entry_id), F.col("_n").alias("matched_bytes"))


def entries(tok: Tokenizer, df: DataFrame, name: str, text: str, kind: str = "named", used: Column | None = None) -> DataFrame:
    """Stored entries with their digests and ids: (name, kind, used, byte_length, end_digest, marks, text, ids)."""
    t = F.col(text)
    return df.select(F.col(name).alias("name"), F.lit(kind).alias("kind"), (used if used is not None else F.lit(0)).cast("long").alias("used"), F.octet_length(t).cast("long").alias("byte_length"), content_digest(t).alias("end_digest"), mark_digests(t).alias("marks"), t.alias("text"), tok.encode(t).alias("ids"))


def keep(store: DataFrame, least: int = AUTO_LEAST, most: int = AUTO_ENTRIES, budget: int = AUTO_BYTES) -> DataFrame:
    """The store after eviction: all named entries, and of the others of at least ``least`` bytes those last used,
    at most ``most`` and at most ``budget`` bytes of text. The bounds are the store's, the window sees ``most`` rows."""
    from pyspark.sql import Window

    auto = store.filter((F.col("kind") == "auto") & (F.col("byte_length") >= least)).orderBy(F.col("used").desc(), "name").limit(most)
    w = Window.partitionBy("kind").orderBy(F.col("used").desc(), "name").rowsBetween(Window.unboundedPreceding, 0)
    auto = auto.withColumn("_sum", F.sum("byte_length").over(w)).filter(F.col("_sum") <= budget).drop("_sum")
    return store.filter("kind = 'named'").unionByName(auto)


def serve(tok: Tokenizer, queries: DataFrame, store: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """(query_id, name, path, ids): a stored text's own ids (exact), its ids with the rest encoded from the last
    safe cut on (extension), or no ids (miss): a miss neither encodes nor stores. Ids equal a full encode."""
    engine = tok._engine()
    hit = longest_prefix(queries, store, query_id, query_text, "name", "text").select(query_id, "name")
    rows = queries.select(query_id, F.col(query_text).alias("_qt")).join(hit, query_id, "left").join(store.select("name", F.col("text").alias("_et"), F.col("ids").alias("_ids")), "name", "left")

    @F.pandas_udf("array<int>")
    def extend(whole: pd.Series, stored: pd.Series, ids: pd.Series) -> pd.Series:
        e, out = engine(), []
        for q, t, i in zip(whole, stored, ids, strict=True):
            if t is None or q is None:
                out.append(None)
                continue
            at = e.cut(t)
            out.append(list(i) if q == t else list(i[: len(i) - len(e.encode(t[at:]))]) + e.encode(q[at:]))
        return pd.Series(out, dtype=object)

    path = F.when(F.col("_et").isNull(), "miss").when(F.col("_qt") == F.col("_et"), "exact").otherwise("extension")
    return rows.select(query_id, "name", path.alias("path"), extend("_qt", "_et", "_ids").alias("ids"))

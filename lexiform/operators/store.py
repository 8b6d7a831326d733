"""Session texts as shared block nodes, and an index of their digests beside checked records.

A session's whole blocks become nodes of a hash chain, so that sessions with a common past share them: a node is written once,
whoever brings it. What is left of the text is the session's tail. Exported tables are taken in again only where every node holds.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from ..sources import records
from .lookup import MARK, content_digest, mark_digests

#: Fixed value: the digest's domain, which callers of another store replace by that store's.
PERSON = b"lexiform.fidx.v1"


def prefix_digest(text: Column, person: bytes = PERSON) -> Column:
    """array<struct<pos, digest>>: 128-bit BLAKE2b digests of a text's beginnings up to each mark and of the whole, which is last."""

    @F.arrow_udf("array<struct<pos: long, digest: string>>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            data, h, at, told = memoryview(t.encode()), hashlib.blake2b(digest_size=16, person=person), 0, []
            stops = []
            while MARK << len(stops) < len(data):
                stops.append(MARK << len(stops))
            for n in [*stops, len(data)]:
                h.update(data[at:n])
                at = n
                told.append({"pos": n, "digest": h.copy().hexdigest()})
            out.append(told)
        return pa.array(out, pa.list_(pa.struct([("pos", pa.int64()), ("digest", pa.string())])))

    return run(text)


def _cut(df: DataFrame, session: str, text: str, size: int) -> DataFrame:
    """(session, n_blocks, nodes, parents, bodies, tail): a text's whole blocks with their chained digests, in one pass."""
    bound_batches(df.sparkSession, 4 << 20)

    @F.arrow_udf("struct<nodes: array<string>, parents: array<string>, bodies: array<string>, tail: string>")
    def run(texts: pa.Array) -> pa.Array:
        ends, nodes, parents, bodies, tails = [0], [], [], [], []
        for x in texts:
            t = x.as_py() or ""
            node, whole = "", len(t) - len(t) % size
            for at in range(0, whole, size):
                parents.append(node)
                bodies.append(t[at : at + size])
                node = hashlib.sha256((node + bodies[-1]).encode()).hexdigest()
                nodes.append(node)
            ends.append(len(nodes))
            tails.append(t[whole:])
        offs = pa.array(ends, pa.int32())
        rows = [pa.ListArray.from_arrays(offs, pa.array(c, pa.string())) for c in (nodes, parents, bodies)]
        return pa.StructArray.from_arrays([*rows, pa.array(tails, pa.string())], ["nodes", "parents", "bodies", "tail"])

    # The number of blocks needs no digest: who asks for no more than that doesn't pay for one.
    n = F.floor(F.coalesce(F.length(text), F.lit(0)) / F.lit(size)).cast("int")
    return df.select(F.col(session).alias("session"), n.alias("n_blocks"), run(F.col(text)).alias("c")).select("session", "n_blocks", "c.*")


def export(df: DataFrame, session: str, text: str, size: int = MARK) -> tuple[DataFrame, DataFrame]:
    """(nodes, sessions). nodes: (node, parent, block, body), each node once; sessions: (session, head, n_blocks, tail)."""
    cut = _cut(df, session, text, size)
    each = cut.select(F.posexplode(F.arrays_zip(F.col("nodes").alias("node"), F.col("parents").alias("parent"), F.col("bodies").alias("body"))).alias("block", "n"))
    nodes = each.select("n.node", "n.parent", "block", "n.body")
    nodes = nodes.groupBy("node").agg(F.any_value("parent").alias("parent"), F.any_value("block").alias("block"), F.any_value("body").alias("body"))
    return nodes, cut.select("session", F.try_element_at("nodes", F.lit(-1)).alias("head"), "n_blocks", "tail", "nodes")


def checked(nodes: DataFrame) -> DataFrame:
    """Nodes with ``ok``: a node's name is the digest of its parent's name and its own body."""
    return nodes.withColumn("ok", F.coalesce(F.sha2(F.concat("parent", "body").cast("binary"), 256) == F.col("node"), F.lit(False)))


def restore(nodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, text, n_blocks, whole): each session's text as far as its nodes are there and hold; the first that fails ends it, and
    then the tail is left out too. ``whole`` tells whether nothing is missing, n_blocks how many blocks the text has."""
    good = checked(nodes).filter("ok").select("node", "body")
    asked = sessions.select("session", F.posexplode_outer("nodes").alias("block", "node"))
    got = asked.join(good, "node", "left").groupBy("session").agg(
        F.min(F.when(F.col("node").isNotNull() & F.col("body").isNull(), F.col("block"))).alias("gap"),
        F.sort_array(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("block", "body")))).alias("parts"),
    )
    rows = sessions.select("session", "tail", "n_blocks").join(got, "session")
    kept = F.filter("parts", lambda p: F.col("gap").isNull() | (p["block"] < F.col("gap")))
    body = F.array_join(F.transform(kept, lambda p: p["body"]), "")
    whole = F.col("gap").isNull()
    return rows.select("session", F.when(whole, F.concat(body, "tail")).otherwise(body).alias("text"), F.coalesce("gap", "n_blocks").alias("n_blocks"), whole.alias("whole"))


def bind(held: DataFrame) -> DataFrame:
    """(session, revision, bound, byte_length, end_digest, marks): the digests of a record's text beside the record's own hash."""
    v = held.select("session", "revision", "record", records.verify(F.col("record")).alias("v")).filter("v.ok")
    return v.select("session", "revision", F.sha2("record", 256).alias("bound"), F.octet_length("v.text").cast("long").alias("byte_length"), content_digest(F.col("v.text")).alias("end_digest"), mark_digests(F.col("v.text")).alias("marks"))


def index(held: DataFrame, sidecar: DataFrame) -> DataFrame:
    """The index of ``held`` records: a sidecar row where it is bound to that very record, else digests made anew from the record
    (``rebuilt``). Records that don't verify have no row; sidecar rows of other records are not used."""
    own = held.select("session", "revision", F.sha2("record", 256).alias("bound"))
    fits = own.join(sidecar.dropDuplicates(["session", "revision", "bound"]), ["session", "revision", "bound"])
    lost = held.join(fits.select("session", "revision"), ["session", "revision"], "left_anti")
    return fits.withColumn("rebuilt", F.lit(False)).unionByName(bind(lost).withColumn("rebuilt", F.lit(True)))

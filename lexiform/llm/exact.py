"""Exact deduplication by a heavy-hitter split, in DataFrame operations only.

1. Every row becomes a 256-bit digest of its normalised text; only ids and digests go on.
2. A mergeable Misra-Gries summary (Spark's frequent-items sketch, whose size is fixed by
   ``tracked``) finds the candidates for frequent digests in one pass without a shuffle by key.
3. The candidates are verified: their exact counts and largest ids come from a map-side combined
   aggregation. Those that hold at least 1/``share`` of the rows are at most ``share`` rows, a proven
   bound, and are broadcast; their losing copies are decided where they are read.
4. All other digests are rarer than that, so an ordinary shuffle by digest deals them out evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise, text_of


def digest_rows(docs: DataFrame, id_col: str, text_col: str, normalise) -> DataFrame:
    """(id, row, digest): row numbers tell rows apart that share id and text."""
    text: Column = text_of(text_col)
    text = normalise(text) if normalise else text
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def heavy_digests(rows: DataFrame, share: int = 256, tracked: int = 4096) -> DataFrame:
    """At most ``share`` rows (digest, top, group_size): digests of at least 1/share of the rows; top has the largest id."""
    total = rows.count()
    found = rows.agg(F.expr(f"approx_top_k(hex(digest), {share}, {tracked})").alias("top")).first()["top"] if total else []
    named = [r["item"] for r in found or [] if r["item"] is not None and r["count"] * share >= total]
    # The sketch's counts are upper bounds here, so no digest of that share is missed; verify them.
    held = rows.filter(F.hex("digest").isin(named) if named else F.lit(False))
    verified = held.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    return verified.filter(F.col("group_size") * share >= total)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, share: int = 256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts the one with the largest id is kept. ``normalise`` maps
    a string Column to a string Column (none: texts are equal when identical). A null text counts as
    empty. A null id is smaller than any other. Of rows that repeat both text and id exactly one is kept.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = materialise(digest_rows(docs, id_col, text_col, normalise), "digests")
    joined = rows.join(F.broadcast(heavy_digests(rows, share)), "digest", "left")
    # A frequent digest's rows are decided where they are read, its winner too; only the others go on to the shuffle.
    heavy = F.col("group_size").isNotNull()
    done = joined.filter(heavy).select("id", F.col("top.id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "digest")
    same = Window.partitionBy("digest")
    first = same.orderBy(F.col("id").desc_nulls_last(), F.col("row").desc())
    rest = joined.filter(~heavy).select(
        "id",
        F.max("id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        (F.row_number().over(first) == 1).alias("kept"),
        "digest",
    )
    out = done.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

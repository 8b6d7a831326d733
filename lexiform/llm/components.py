"""Connected components by alternating large-star and small-star rounds, all in DataFrames.

Each round is a map-side combined minimum per node and a join; the edges are written after each
round, so plans stay short and lost executors cost one round. Nothing is collected but two
numbers that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, join_hot, materialise


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (u, v) of any orderable type. Returns (id, component) for every id that has an
    edge to another; component is the smallest id that it reaches."""
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    edges = materialise(edges.filter(F.col("u") != F.col("v")).select(*pair).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"), F.count(F.lit(1)).alias("m"))
        low = materialise(low, "low")
        # A star's centre has as many edges as its component has members: a hot key.
        up = both.filter(F.col("v") > F.col("u"))
        large = materialise(join_hot(up, low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct(), "large")
        discard(low)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, materialise(small, "edges")
        discard(before, large)
        if (now := _mark(edges)) == mark:
            break
        mark = now
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out = materialise(out, "components")
    discard(edges)
    return out

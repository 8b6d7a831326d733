"""Artifact files, what a manifest says of them, and names that mean the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactHashMismatch, ArtifactNotFound, RegistryInvalid

#: A manifest's columns. An alias is another name of a family's content.
COLUMNS = ["family", "sha256", "n_bytes"]


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n_bytes, sha256) of a folder's files, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def check(files: DataFrame, manifest: DataFrame, names: DataFrame) -> DataFrame:
    """(family, path, status) of files (path, n_bytes, sha256) that ``names`` (path, family) assigns to families:
    ok, hash_mismatch, size_mismatch, missing (no file) or unlisted (no family of that name)."""
    held = names.join(files, "path", "left").select("family", "path", F.col("sha256").alias("_sha"), F.col("n_bytes").alias("_n"))
    rows = manifest.select(*COLUMNS, F.lit(True).alias("_listed")).join(held, "family", "full")
    status = F.when(F.col("_listed").isNull(), "unlisted").when(F.col("_sha").isNull(), "missing").when(F.col("_n") != F.col("n_bytes"), "size_mismatch").when(F.col("_sha") != F.col("sha256"), "hash_mismatch").otherwise("ok")
    return rows.select("family", "path", status.alias("status"))


def families(files: DataFrame, manifest: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(path, family): the family whose pinned content, or that of one of its aliases (sha256, family), a file is.
    The content decides, never the name; unknown content has no family."""
    known = manifest.select("sha256", "family")
    if aliases is not None:
        known = known.unionByName(aliases.select("sha256", "family")).distinct()
    return files.join(known, "sha256", "left").select("path", "family")


def resolve(spark: SparkSession, folder: str, manifest: DataFrame, family: str) -> str:
    """The path of the file that is a family's content. One row of the manifest is read to the driver."""
    rows = manifest.filter(F.col("family") == family).select(*COLUMNS).limit(2).collect()
    if not rows:
        raise ArtifactNotFound("unknown family", family=family)
    if len(rows) > 1:
        raise RegistryInvalid("a family with two rows", family=family)
    files = scan(spark, folder)
    hit = files.filter(F.col("sha256") == rows[0]["sha256"]).agg(F.min("path").alias("path")).first()
    if hit["path"] is not None:
        return hit["path"]
    near = files.filter(F.col("path").contains(family)).agg(F.min(F.struct("path", "sha256")).alias("x")).first()["x"]
    if near is not None:
        raise ArtifactHashMismatch("a file of that name holds other content", family=family, path=near["path"], expected_sha256=rows[0]["sha256"], observed_sha256=near["sha256"])
    raise ArtifactNotFound("no file holds the family's content", family=family, searched=folder)

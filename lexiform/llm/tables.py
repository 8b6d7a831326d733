"""Shared plumbing: written tables that cut lineage, batch bounds, partition counts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to a Python worker; long texts make batches short, not large.
BATCH_BYTES = 16 << 20
#: Stands for a null id where ids are ordered: it sorts before every real one.
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Only a local session, which has no
    other machine, may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexiform-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that a lost executor
    costs no more than the stage that is running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiform/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and no later step reads."""
    for t in tables:
        if path := getattr(t, "written", None):
            jvm = t.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def join_hot(rows: DataFrame, counted: DataFrame, key: str, share: int = 1024) -> DataFrame:
    """``rows`` joined with ``counted``, which has a row for each key and in ``m`` how many rows have it.

    Keys that hold at least 1/``share`` of all these rows number ``share`` at most: this proven bound is broadcast, so
    that a hot key's rows stay where they are. All others are rarer and are shuffled. Both tables should be written ones.
    """
    total = counted.agg(F.sum("m")).first()[0] or 0
    hot = F.col("m") * share >= total
    many = counted.filter(hot)
    rest = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(counted.filter(~hot), key)
    return rows.join(F.broadcast(many), key).unionByName(rest)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, unless the session already sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("b")) > 64 << 20:
        spark.conf.set(key, str(BATCH_BYTES))


def lean(run):
    """``run`` over a task's batches, giving freed memory back at its end: workers outlive their tasks, and
    what an allocator keeps of one stage would count against the next one."""

    def kept(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return kept


def release() -> None:
    """Free what this worker no longer uses, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def parts(df: DataFrame, least: int = 1) -> int:
    """Partitions for a shuffle of about the size of ``df``: as many as its scan has splits,
    and never fewer than the session's own number."""
    spark = df.sparkSession
    return max(least, df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def buffers(column: pa.Array) -> tuple[memoryview, "object"]:
    """The bytes and the offsets of a string or binary column without nulls, not copied."""
    import numpy as np

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0 or offs is None:
        return memoryview(b""), np.zeros(1, np.int64)
    at = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return memoryview(data) if data is not None else memoryview(b""), at


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, for operators that stream over sorted partitions."""
    for b in batches:
        names, cols = b.schema.names, b.columns
        for i in range(b.num_rows):
            yield {n: c[i].as_py() for n, c in zip(names, cols, strict=True)}

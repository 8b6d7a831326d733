"""Columns of byte-fallback models in Arrow UDFs, no shuffle: texts are normalized whole, their distinct units merged once
and kept, and ids and bytes are put together as whole arrays."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches
from ..sources.sentencepiece import PieceArtifact
from .tokens import flat, gather, lists


class PieceTokenizer:
    """A byte-fallback model bound to a session."""

    def __init__(self, spark: SparkSession, artifact: PieceArtifact, batch_bytes: int = 16 << 20) -> None:
        self.spark, self.artifact, self.local = spark, artifact, artifact
        bound_batches(spark, batch_bytes)
        self.shared = spark.sparkContext.broadcast(artifact)  # as large as the vocabulary

    def _engine(self):
        shared = self.shared
        return lambda: shared.value

    def encoder(self):
        """A function of a text column."""
        shared = self.shared

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            a = shared.value
            each = [() if t is None else a.encode(t) for t in texts.to_pylist()]
            lens = np.fromiter(map(len, each), np.int64, len(each))
            return lists(np.fromiter(itertools.chain.from_iterable(each), np.int64, lens.sum()), np.append(0, np.cumsum(lens)), np.asarray(texts.is_null()))

        return run

    def encode(self, text: Column, add_special_tokens: bool = False) -> Column:
        """array<int> of a text's ids; null stays null."""
        ids = self.encoder()(text)
        if add_special_tokens:
            ids = F.concat(F.array(*map(F.lit, self.artifact.bos)).cast("array<int>"), ids, F.array(*map(F.lit, self.artifact.eos)).cast("array<int>"))
        return ids

    def counter(self):
        """A function of a text column: the number of its ids, without sending them; null stays null."""
        shared = self.shared

        @F.arrow_udf("long")
        def run(texts: pa.Array) -> pa.Array:
            a = shared.value
            return pa.array([None if t is None else len(a.encode(t)) for t in texts.to_pylist()], pa.int64())

        return run

    def count(self, text: Column) -> Column:
        return self.counter()(text)

    def decoder(self, skip_special_tokens: bool = True):
        """A function of an id column."""
        shared, held = self.shared, {}

        @F.arrow_udf("string")
        def run(rows: pa.Array) -> pa.Array:
            a = shared.value
            if not held:
                held["lens"] = np.full(max(a.surface) + 1, -1, np.int64)
                parts = {i: b"" if skip_special_tokens and i in a.special else a.surface[i] for i in sorted(a.surface)}
                held["lens"][list(parts)] = [len(p) for p in parts.values()]
                held["bytes"] = np.frombuffer(b"".join(parts.values()), np.uint8)
            lens = held["lens"]
            ids, at, none = flat(rows)
            if len(ids) and not (0 <= ids.min() and ids.max() < len(lens) and (lens[ids] >= 0).all()):
                raise KeyError("an id that the vocabulary lacks")
            data, offs = gather(held["bytes"], np.maximum(lens, 0), ids)
            ends = offs[at]
            return pa.array([None if n else a.told(data[x:y].tobytes()) for x, y, n in zip(ends[:-1], ends[1:], none, strict=True)], pa.string())

        return run

    def decode(self, ids: Column, skip_special_tokens: bool = True) -> Column:
        return self.decoder(skip_special_tokens)(ids)

"""Encoding and decoding of text columns.

Pieces are split in the JVM; merging runs in Arrow UDFs that hold the vocabulary as a broadcast of its own
size and a bounded memo of pieces. A batch's pieces are dictionary-encoded, so that Python sees each distinct
piece once and the ids are gathered by whole arrays. Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import itertools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import schemes
from ..functions.bpe import merge
from ..functions.text import may_hold
from ..session import bound_batches
from ..sources.artifact import Artifact, Splitter

MEMO = 200_000
NOT_ASCII = r"[^\x00-\x7F]"


class Engine:
    """One artifact's encoder in plain Python, for a worker or for one text."""

    def __init__(self, artifact: Artifact) -> None:
        self.a, self.memo, self.tables = artifact, {}, {}
        self.surface = artifact.surface()
        self.special = {t.id for t in artifact.added if t.special}
        self.added = Splitter(artifact.added)
        self.cuts = schemes.free_cuts(self.added.by_text.values())
        if artifact.prefix_space:  # what doesn't begin with a space would get one
            self.cuts = schemes.cuts("") if self.cuts.startswith(schemes.cuts("")) else ""
        self.cuttable = bool(self.cuts)

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.memo.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.a.whole.get(data) if self.a.ignore_merges else None
            # Bytes that the vocabulary lacks are dropped before merging.
            ids = (whole,) if whole is not None else tuple(merge([i for b in data if (i := self.a.bytes[b]) >= 0], self.a.ranks))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, token in self.added.split(text):
            if token is not None:
                out.append(token)
            elif part:
                if self.a.nfc and not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                if self.a.prefix_space and not part.startswith(" "):
                    part = " " + part
                for p in schemes.split(part, self.a.scheme):
                    out += self.piece(p)
        return out

    def cut(self, text: str) -> int:
        """The last place at which both sides of a text encode alone, whatever is appended; 0 for none."""
        return schemes.last_cut(text, pattern=self.cuts)

    def pieces(self, pieces) -> list[int]:
        out: list[int] = []
        for p in pieces:
            out += self.piece(p)
        return out

    def decode(self, ids, skip_special: bool = True) -> bytes:
        return b"".join(self.surface[i] for i in ids if not (skip_special and i in self.special))

    def table(self, skip_special: bool) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after the other, and the number of each id's; -1 where there is no such id."""
        if skip_special not in self.tables:
            lens = np.full(max(self.surface, default=-1) + 1, -1, np.int64)
            parts = []
            for i in sorted(self.surface):
                body = b"" if skip_special and i in self.special else self.surface[i]
                lens[i] = len(body)
                parts.append(body)
            self.tables[skip_special] = np.frombuffer(b"".join(parts), np.uint8), lens
        return self.tables[skip_special]

    def spans(self, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
        """Character spans of ids whose bytes are the text's; tokens inside one character share its span."""
        data = np.frombuffer(text.encode(), np.uint8)
        lens = self.table(False)[1][np.asarray(ids, np.int64)] if len(ids) else np.zeros(0, np.int64)
        ends = np.cumsum(lens)
        if (ends[-1] if len(ends) else 0) != len(data):
            raise ValueError("ids do not close over the text")
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        return (char[ends - lens], char[ends - 1] + 1) if len(ends) else (ends, ends)


def gather(values: np.ndarray, lens: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``idx`` of a ragged table one after the other, and where each ends up (one offset more)."""
    take = lens[idx]
    offs = np.append(0, np.cumsum(take))
    starts = np.cumsum(lens) - lens
    return values[np.repeat(starts[idx] - offs[:-1], take) + np.arange(offs[-1])], offs


def _looked_up(e: Engine, texts: pa.Array, pieces: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the batch's distinct pieces, their indices row by row, indices per row, null rows). A row that came
    without pieces is one entry of its own."""
    # Nulls are seen before the pieces are put together: a null list has none.
    bare = np.asarray(pieces.is_null())
    counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pieces.flatten().dictionary_encode()
    idx = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids: list = [e.piece(p) for p in coded.dictionary.to_pylist()]
    whole = np.flatnonzero(bare & np.asarray(texts.is_valid()))
    if len(whole):
        starts = np.cumsum(counts) - counts
        idx = np.insert(idx, starts[whole], np.arange(len(whole)) + len(ids))
        ids += [e.encode(t) for t in texts.take(pa.array(whole)).to_pylist()]
        counts[whole] = 1
    bare[whole] = False
    return ids, idx, counts, bare


def lists(values: np.ndarray, offs: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.astype(np.int32)), mask=pa.array(none))


def flat(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, one offset more than rows, null rows) of a list column."""
    counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return rows.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(counts)), np.asarray(rows.is_null())


class Tokenizer:
    """An artifact bound to a session."""

    def __init__(self, spark: SparkSession, artifact: Artifact, batch_bytes: int = 4 << 20) -> None:
        self.spark, self.artifact = spark, artifact
        bound_batches(spark, batch_bytes)
        self.shared = spark.sparkContext.broadcast(artifact)  # as large as the vocabulary
        self.local = Engine(artifact)

    def _engine(self):
        shared = self.shared

        def engine() -> Engine:
            """The worker's own, kept beside the broadcast vocabulary: its memo outlives a task."""
            a = shared.value
            if "engine" not in a.held:
                a.held["engine"] = Engine(a)
            return a.held["engine"]

        return engine

    def pieces(self, text: Column) -> Column:
        return schemes.pieces(text, self.artifact.scheme)

    def plain(self, text: Column) -> Column:
        """Rows whose pieces the JVM can split: no added token, no normalization to do."""
        a = self.artifact
        ok = ~may_hold(text, a.literals())
        if a.nfc:
            ok &= ~text.rlike(NOT_ASCII)
        return ok & F.lit(not a.prefix_space)

    def plain_sql(self, text: str) -> str:
        """The same as SQL text."""
        a, quoted = self.artifact, schemes.quoted
        tests = [f"NOT contains({text}, {quoted(x)})" for x in a.literals()]
        tests += [f"NOT {text} RLIKE {quoted(NOT_ASCII)}"] * a.nfc + ["false"] * a.prefix_space
        return " AND ".join(tests) or "true"

    def encoder(self):
        """A function of a text column and one of its pieces, of which one is null."""
        engine = self._engine()

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array, pieces: pa.Array) -> pa.Array:
            ids, idx, counts, none = _looked_up(engine(), texts, pieces)
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            values = np.fromiter(itertools.chain.from_iterable(ids), np.int32, lens.sum())
            offs = np.append(0, np.cumsum(lens[idx]))[np.append(0, np.cumsum(counts))]
            known = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), pa.array(values))
            # Taken by Arrow, ids need no indices of their own: a byte vocabulary has one for each byte.
            return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), known.take(pa.array(idx)).flatten(), mask=pa.array(none))

        return run

    def encode(self, text: Column, add_special_tokens: bool = False) -> Column:
        """array<int> of a text's ids; null stays null. Equal to a from-scratch encode on either path."""
        plain = self.plain(text)
        ids = self.encoder()(F.when(~plain, text), F.when(plain, self.pieces(text)))
        if add_special_tokens:
            ids = F.concat(F.array(*map(F.lit, self.artifact.bos)).cast("array<int>"), ids, F.array(*map(F.lit, self.artifact.eos)).cast("array<int>"))
        return ids

    def counter(self):
        """The same with the number of ids, which are not sent; null stays null."""
        engine = self._engine()

        @F.arrow_udf("long")
        def run(texts: pa.Array, pieces: pa.Array) -> pa.Array:
            ids, idx, counts, none = _looked_up(engine(), texts, pieces)
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            sums = np.append(0, np.cumsum(lens[idx]))
            at = np.append(0, np.cumsum(counts))
            return pa.array(sums[at[1:]] - sums[at[:-1]], mask=none)

        return run

    def encode_alone(self, text: Column) -> Column:
        """The reference path: each text by the plain definition, its pieces split in Python and merged anew."""
        engine = self._engine()

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            e, out = Engine(engine().a), []
            for t in texts.to_pylist():
                e.memo.clear()
                out.append(None if t is None else e.encode(t))
            return pa.array(out, pa.list_(pa.int32()))

        return run(text)

    def count(self, text: Column) -> Column:
        plain = self.plain(text)
        return self.counter()(F.when(~plain, text), F.when(plain, self.pieces(text)))

    def encode_distinct(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """The relational way: each distinct piece is merged once, and documents are put together again.
        Two shuffles of pieces; worth it only where a piece's merging costs more than its shuffle."""
        engine = self._engine()

        @F.pandas_udf("array<int>")
        def run(pieces: pd.Series) -> pd.Series:
            e = engine()
            return pd.Series([list(e.piece(p)) for p in pieces], dtype=object)

        each = df.select(id_col, F.posexplode(self.pieces(F.col(text_col))).alias("pos", "piece"))
        known = each.select("piece").distinct().withColumn("ids", run("piece"))
        put = each.join(known, "piece").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
        joined = put.select(id_col, F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
        return df.select(id_col).join(joined, id_col, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))

    def encode_spread(self, df: DataFrame, id_col: str, text_col: str, size: int = 1 << 16, partitions: int | None = None) -> DataFrame:
        """(id, ids) with long texts cut at safe places and dealt out, so that one huge text isn't one task.
        Ids must be unique. Where an added token could reach over a cut, texts stay whole."""
        text = F.col(text_col)
        # What is short enough stays where it is; only parts of long texts and their ids are moved.
        short = df.filter(F.coalesce(F.length(text) <= size, F.lit(True))).select(id_col, self.encode(text).alias("ids"))
        each = df.filter(F.length(text) > size).select(id_col, F.posexplode(schemes.ranges(text, size, self.local.cuts)).alias("pos", "part"))
        each = each.repartition(partitions, id_col, "pos") if partitions else each.repartition(id_col, "pos")
        put = each.select(id_col, "pos", self.encode(F.col("part")).alias("ids")).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
        return short.unionByName(put.select(id_col, F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids")))

    def decoder(self, skip_special_tokens: bool = True):
        """A function of an id column."""
        engine = self._engine()

        @F.arrow_udf("string")
        def run(rows: pa.Array) -> pa.Array:
            e = engine()
            ids, at, none = flat(rows)
            values, lens = e.table(skip_special_tokens)
            if len(ids) and not (0 <= ids.min() and ids.max() < len(lens) and (lens[ids] >= 0).all()):
                raise KeyError("an id that the vocabulary lacks")
            data, offs = gather(values, np.maximum(lens, 0), ids)
            ends = offs[at]
            try:
                return pa.array([None if n else data[a:b].tobytes().decode() for a, b, n in zip(ends[:-1], ends[1:], none, strict=True)], pa.string())
            except UnicodeDecodeError:
                return pa.array([None if n else data[a:b].tobytes().decode("utf-8", "replace") for a, b, n in zip(ends[:-1], ends[1:], none, strict=True)], pa.string())

        return run

    def decode(self, ids: Column, skip_special_tokens: bool = True) -> Column:
        return self.decoder(skip_special_tokens)(ids)

    def window(self, text: Column, ids: Column, marks: Column, first: int, last: int) -> Column:
        """struct<starts, ends> of the tokens from ``first`` up to ``last``, told from the checkpoint before them: only the text
        behind that is looked at. The marks' distance is that of their tokens."""
        engine = self._engine()

        @F.arrow_udf("struct<starts: array<int>, ends: array<int>>")
        def run(texts: pa.Array, rows: pa.Array, marks: pa.Array) -> pa.Array:
            lens = engine().table(False)[1]
            every, at, none = flat(rows)
            out = []
            for k, (t, told) in enumerate(zip(texts.to_pylist(), marks.to_pylist(), strict=True)):
                if t is None or none[k] or told is None:
                    out.append(None)
                    continue
                own = every[at[k] : at[k + 1]][:last]
                mark = max((m for m in told if m["token"] <= first), key=lambda m: m["token"], default={"token": 0, "char": 0})
                # The checkpoint's token can begin inside a character; bytes are counted from the text's own.
                size = lens[own[mark["token"] :]]
                skip = int(lens[own[: mark["token"]]].sum()) - len(t[: mark["char"]].encode())
                data = np.frombuffer(t[mark["char"] :].encode()[: skip + int(size.sum()) + 4], np.uint8)
                char = np.cumsum((data & 0xC0) != 0x80) - 1 + mark["char"]
                ends = skip + np.cumsum(size)
                cut = first - mark["token"]
                out.append({"starts": char[ends - size][cut:].tolist(), "ends": (char[ends - 1] + 1)[cut:].tolist()} if len(size) else {"starts": [], "ends": []})
            return pa.array(out, pa.struct([("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]))

        return run(text, ids, marks)

    def checkpoints(self, text: Column, ids: Column, stride: int = 1024) -> Column:
        """The checkpoints of a text's spans, which are not sent; null where the ids do not close over the text."""
        engine = self._engine()

        @F.arrow_udf("array<struct<token: int, char: int>>")
        def run(texts: pa.Array, rows: pa.Array) -> pa.Array:
            e, (every, at, none) = engine(), flat(rows)
            lens, token, char = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, t in enumerate(texts):
                try:
                    own = e.spans(t.as_py(), every[at[k] : at[k + 1]])[0] if t.is_valid and not none[k] else None
                except ValueError:
                    own = None
                lens.append(-1 if own is None else -(-len(own) // stride))
                if own is not None:
                    token.append(np.arange(0, len(own), stride))
                    char.append(own[::stride])
            n = np.array(lens, np.int64)
            told = pa.StructArray.from_arrays([pa.array(np.concatenate(c).astype(np.int32)) for c in (token, char)], ["token", "char"])
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.maximum(n, 0))).astype(np.int32)), told, mask=pa.array(n < 0))

        return run(text, ids)

    def spans(self, text: Column, ids: Column) -> Column:
        """struct<starts, ends> in characters, or null where the ids do not close over the text."""
        engine = self._engine()

        @F.arrow_udf("struct<starts: array<int>, ends: array<int>>")
        def run(texts: pa.Array, rows: pa.Array) -> pa.Array:
            e = engine()
            every, at, none = flat(rows)
            empty = np.zeros(0, np.int32)
            starts, ends, lens = [empty], [empty], []
            for k, t in enumerate(texts):
                try:
                    told = e.spans(t.as_py(), every[at[k] : at[k + 1]]) if t.is_valid and not none[k] else None
                except ValueError:
                    told = None
                lens.append(-1 if told is None else len(told[0]))
                if told is not None:  # kept as they are sent, at half the size
                    starts.append(told[0].astype(np.int32))
                    ends.append(told[1].astype(np.int32))
            n = np.array(lens, np.int64)
            offs, lost = pa.array(np.append(0, np.cumsum(np.maximum(n, 0))).astype(np.int32)), pa.array(n < 0)
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offs, pa.array(np.concatenate(x)), mask=lost) for x in (starts, ends)], ["starts", "ends"])

        return run(text, ids)


def byte_spans(pieces: Column) -> Column:
    """struct<starts, ends>: where each piece of a text lies in its UTF-8 bytes."""

    @F.arrow_udf("struct<starts: array<int>, ends: array<int>>")
    def run(rows: pa.Array) -> pa.Array:
        none = np.asarray(rows.is_null())
        counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.append(0, np.cumsum(counts))
        total = np.append(0, np.cumsum(pc.binary_length(rows.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)))
        base = np.repeat(total[at[:-1]], counts)
        return pa.StructArray.from_arrays([lists(total[:-1] - base, at, none), lists(total[1:] - base, at, none)], ["starts", "ends"])

    return run(pieces)


def checkpoints(spans: Column, stride: int = 1024) -> Column:
    """array<struct<token, char>>: where every ``stride``-th token of a text begins, from its spans."""

    @F.arrow_udf("array<struct<token: int, char: int>>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows:
            starts = r["starts"] if r.is_valid else None
            if starts is None or not starts.is_valid:
                out.append(None)
                continue
            at = starts.values.to_numpy()
            out.append([{"token": k, "char": int(at[k])} for k in range(0, len(at), stride)])
        return pa.array(out, pa.list_(pa.struct([("token", pa.int32()), ("char", pa.int32())])))

    return run(spans)


def ragged(df: DataFrame, id_col: str, ids_col: str) -> DataFrame:
    """The long form of an id column: (id, pos, token)."""
    return df.select(id_col, F.posexplode(ids_col).alias("pos", "token"))


def offsets(df: DataFrame, group: str, order: str, n: str, parts: int) -> DataFrame:
    """``df`` with the place of each row's ``n`` ids in one long column of its group in ``order``: a running sum in two levels.

    Groups are cut at quantiles of ``order`` into ``parts`` at most, so that a group of most rows is no single task; what is summed
    one after another are the parts' sums.
    """
    bounds = df.approxQuantile(order, [k / parts for k in range(1, parts)], 0.5 / parts) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, sorted({int(b) for b in bounds}))), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    rows = df.withColumn("_part", part)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, "_part").agg(F.sum(n).alias("_n"))
    base = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before(Window.partitionBy(group).orderBy("_part"))), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(n).over(before(Window.partitionBy(group, "_part").orderBy(order))), F.lit(0))
    placed = rows.withColumn("_own", own).join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn("offset", (F.col("_base") + F.col("_own")).cast("long")).drop("_part", "_own", "_g", "_p", "_base")

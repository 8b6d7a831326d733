"""Conversations as token sessions: an append returns only the replaced suffix.

A session's ids are sealed up to the last place where the text can be cut; only the tail behind it is encoded
again by an append, so that its cost follows the delta and not the session. A text without such a place
stays in the tail, which is always exact.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LexiformError, SessionStateMismatch
from ..sources import records
from .tokens import Tokenizer

PATCH = pa.schema([("revision", pa.int64()), ("replace_from", pa.int32()), ("replacement_ids", pa.list_(pa.int32())), ("token_count", pa.int32()), ("path", pa.string())])
#: What a command does to its session.
APPEND, PUT, DELETE = "append", "put", "delete"
#: Paths of patches that leave the ids as they are.
KEEPS = ("noop", "hit", "revision_conflict", "unknown_session")
#: A tail of more characters is told apart: its append costs a whole encode of the tail.
HARD_CAP = 1 << 20


class Encoder(Protocol):
    """What a session needs of an engine."""

    def encode(self, text: str) -> list[int]: ...

    def cut(self, text: str) -> int: ...


def first_difference(old: list[int], new: list[int]) -> int:
    n = 0
    for a, b in zip(old, new, strict=False):
        if a != b:
            break
        n += 1
    return n


class Tail:
    """The part of a session that an append can still change: the state to keep between micro-batches."""

    def __init__(self, engine: Encoder, text: str = "", sealed: int = 0, revision: int = -1) -> None:
        self.engine, self.text, self.sealed, self.revision = engine, text, sealed, revision
        self.empty = not text and not sealed
        self.ids = engine.encode(text)

    @property
    def count(self) -> int:
        return self.sealed + len(self.ids)

    def append(self, delta: str, expected: int | None = None) -> tuple:
        """(revision, replace_from, replacement_ids, token_count, path). A wrong expected revision changes nothing."""
        if expected is not None and expected != self.revision:
            return self._conflict()
        self.revision += 1
        if not delta:  # keeps ids, still a revision
            return self.revision, self.count, [], self.count, "noop"
        path = "seed" if self.empty else "degraded_full_reencode" if len(self.text) > HARD_CAP else "append"
        self.empty = False
        text = self.text + delta
        at = self.engine.cut(text)
        done, rest = self.engine.encode(text[:at]) if at else [], self.engine.encode(text[at:])
        new = done + rest
        same = first_difference(self.ids, new)
        patch = self.revision, self.sealed + same, new[same:], self.sealed + len(new), path
        self.text, self.ids, self.sealed = text[at:], rest, self.sealed + len(done)
        return patch

    def _conflict(self) -> tuple:
        return self.revision, self.count, [], self.count, "revision_conflict"

    def put(self, text: str, expected: int | None = None) -> tuple:
        """Overwrites the session's text as its next revision."""
        if expected is not None and expected != self.revision:
            return self._conflict()
        path = "seed" if self.empty and text else "overwrite"
        self.__init__(self.engine, "", 0, self.revision)
        patch = self.append(text)
        return self.revision, 0, patch[2], patch[3], path

    def delete(self, expected: int | None = None) -> tuple:
        """Forgets the session: the next command begins a new one."""
        if self.revision < 0:
            return -1, 0, [], 0, "unknown_session"
        if expected is not None and expected != self.revision:
            return self._conflict()
        revision = self.revision
        self.__init__(self.engine)
        return revision, 0, [], 0, "deleted"

    def take(self, op: str | None, text: str | None, expected: int | None = None) -> tuple:
        """One command; no operation named is an append."""
        if op in (None, APPEND):
            return self.append(text or "", expected)
        if op == PUT:
            return self.put(text or "", expected)
        if op == DELETE:
            return self.delete(expected)
        raise ValueError(f"unknown operation: {op}")


class Session:
    """One conversation with its whole text and ids. Every result equals a full encode of the text."""

    def __init__(self, engine: Encoder, text: str = "", revision: int = -1) -> None:
        self.engine, self.text, self.ids = engine, "", []
        self.tail = Tail(engine)
        if text:
            self.append(text)
        self.tail.revision = revision

    @property
    def revision(self) -> int:
        return self.tail.revision

    def _take(self, patch: tuple) -> tuple:
        if patch[4] not in KEEPS:
            self.ids[patch[1] :] = patch[2]
        return patch

    def append(self, delta: str, expected: int | None = None) -> tuple:
        patch = self._take(self.tail.append(delta, expected))
        if patch[4] != "revision_conflict":
            self.text += delta
        return patch

    def transcript(self, text: str, prefix: str | None = None) -> tuple:
        """Takes a whole text: the same is a hit, a longer one is an append, any other overwrites.
        A caller that claims ``prefix`` as the stored text is refused where it isn't."""
        if prefix is not None and prefix != self.text:
            raise SessionStateMismatch("the claimed prefix is not the stored text", stored=len(self.text), claimed=len(prefix))
        if text == self.text and self.revision >= 0:
            return self.revision, len(self.ids), [], len(self.ids), "hit"
        if text.startswith(self.text):
            return self.append(text[len(self.text) :])
        old, revision = self.ids, self.revision + 1
        self.__init__(self.engine, text, revision)
        at = first_difference(old, self.ids)
        return revision, at, self.ids[at:], len(self.ids), "overwrite"

    def snapshot(self) -> dict:
        return {"text": self.text, "ids": list(self.ids), "revision": self.revision, "token_count": len(self.ids)}

    def fork(self) -> Session:
        return Session(self.engine, self.text, 0)


def _streamed(rows: DataFrame, fresh, step) -> DataFrame:
    """A patch per row of (session, turn, ...), a session's rows in order. Sessions keep their own type, and a null one is
    a session like any other; a task holds one session at a time."""
    kind = rows.schema["session"].dataType.simpleString()

    def run(batches):
        current, held = None, None
        for b in batches:
            out = []
            for s, *given in zip(b.column(0).to_pylist(), *(b.column(i).to_pylist() for i in range(2, b.num_columns)), strict=True):
                if held is None or s != current:
                    current, held = s, fresh()
                out.append(step(held, *given))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PATCH, strict=True)] if out else [pa.array([], f.type) for f in PATCH]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["session", *PATCH.names])

    names = f"session {kind}, revision long, replace_from int, replacement_ids array<int>, token_count int, path string"
    return rows.repartition("session").sortWithinPartitions("session", "turn").mapInArrow(run, names)


def patches(tok: Tokenizer, turns: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text", op: str | None = None, expected: str | None = None) -> DataFrame:
    """One patch per turn. ``op`` names a column of append (also null), put and delete; ``expected`` one of the revisions that
    callers think stored: a turn with a wrong one changes nothing. A null text is an empty one."""
    engine = tok._engine()
    told = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
    rows = turns.select(F.col(session).alias("session"), F.col(order).alias("turn"), told(op, "string").alias("op"), F.coalesce(text, F.lit("")).alias("delta"), told(expected, "long").alias("expected"))
    return _streamed(rows, lambda: Tail(engine()), lambda held, *given: held.take(*given))


def transcripts(tok: Tokenizer, states: DataFrame, session: str, order: str, text: str, growing: bool = False) -> DataFrame:
    """One patch per whole transcript, in order: hits, appends and overwrites of growing or rewritten sessions. With ``growing``
    the column holds what a transcript has more than the one before it, so that no table of whole transcripts is made."""
    engine = tok._engine()
    rows = states.select(F.col(session).alias("session"), F.col(order).alias("turn"), F.coalesce(text, F.lit("")).alias("body"))
    return _streamed(rows, lambda: Session(engine()), lambda held, body: held.transcript(held.text + body if growing else body))


def forked(turns: DataFrame, forks: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """``turns`` and, for each row (session, name, upto) of ``forks``, the session's turns up to ``upto`` again as those of ``name``:
    a fork is its own session with a common past. Names have the sessions' type."""
    past = turns.join(forks.select(F.col("session").alias(session), "name", "upto"), session).filter(F.col(order) <= F.col("upto"))
    return turns.unionByName(past.drop(session, "upto").withColumnRenamed("name", session))


def fold(patches_: DataFrame) -> DataFrame:
    """(session, revision, ids) after the last patch: a session's patches spliced in the order of their revisions, one session at
    a time. Patches of a session that was deleted and begun again have no single order and must not be folded together."""
    kind = patches_.schema["session"].dataType.simpleString()
    rows = patches_.select("session", "revision", "replace_from", "replacement_ids", "path").filter(~F.col("path").isin("revision_conflict", "unknown_session"))

    def run(batches):
        current, revision, ids, begun = None, None, [], False
        own = None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([current], own), pa.array([revision], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["session", "revision", "ids"])

        for b in batches:
            own = b.schema.field(0).type
            for s, v, at, new, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or s != current:
                    if begun:
                        yield out()
                    current, ids, begun = s, [], True
                revision = v
                if path not in KEEPS:
                    ids[at:] = new
        if begun:
            yield out()

    return rows.repartition("session").sortWithinPartitions("session", "revision").mapInArrow(run, f"session {kind}, revision long, ids array<int>")


def recorded(tok: Tokenizer, turns: DataFrame, session: str, turn: str, delta: str, fingerprint: bytes) -> DataFrame:
    """(session, revision, ok, kept, n_tokens, replace_from) of sessions to which every turn appends its text: what ``records.write``,
    ``records.chain`` and ``records.appended`` tell of them.

    A revision's record holds the whole session, so that a session's records grow with the square of its turns. Here each is
    written, read back and checked behind the one before it and then dropped: what is moved and held is the session's text.
    """
    rows = turns.select(F.col(session).alias("session"), F.col(turn).alias("turn"), F.coalesce(F.col(delta), F.lit("")).alias("text"))
    kind, engine = rows.schema["session"].dataType.simpleString(), tok._engine()

    def run(batches):
        e, current, begun = engine(), None, False
        for b in batches:
            out = []
            for s, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not begun or s != current:
                    current, begun, ok, link, after, text = s, True, True, records.ZERO, None, b""
                    tail, ids, own, old = Tail(e), np.zeros(64, np.uint32), np.zeros(0, np.uint32), None
                revision, at, new, n, _ = tail.append(t)
                if n > len(ids):
                    ids = np.concatenate([ids[:at], np.zeros(2 * n - at, np.uint32)])
                ids[at:n] = new
                text += t.encode()
                data = records.encode(records.Record(fingerprint, revision, ids[:n], text, previous=link))
                link = records.link_of(data)
                try:  # what follows a record that fails fails too
                    after, now, read = records.unpack(data, fingerprint, after) if ok else (None, None, None)
                except LexiformError:
                    ok = False
                if not ok:
                    out.append((revision, False, None, None, None))
                    continue
                least = min(len(own), len(now))
                other = np.flatnonzero(own[:least] != now[:least])
                out.append((revision, True, old is None or read.startswith(old), len(now), int(other[0]) if len(other) else least))
                own, old = now, read
            kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            told = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *told], ["session", "revision", "ok", "kept", "n_tokens", "replace_from"])

    return rows.repartition("session").sortWithinPartitions("session", "turn").mapInArrow(run, f"session {kind}, revision long, ok boolean, kept boolean, n_tokens long, replace_from long")

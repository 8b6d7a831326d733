"""The same sessions over a stream of turns, with state per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sessions import Tail
from ..operators.tokens import Tokenizer


def patch_stream(tok: Tokenizer, turns: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text", op: str | None = None, expected: str | None = None) -> DataFrame:
    """Patches of a streaming DataFrame of turns, with the columns ``op`` and ``expected`` of the table form. Turns of one
    micro-batch are taken in their order; the tail behind the sealed ids, their number and the revision are the state, so
    it doesn't grow with the session. A deleted session's state goes. Sessions keep their own type; those that are null are one."""
    engine = tok._engine()
    kind = turns.schema[session].dataType.simpleString()
    told = lambda c, as_: (F.col(c) if c else F.lit(None)).cast(as_)
    # A whole number that can be null must not pass through floats: it travels as text.
    rows = turns.select(F.col(session).cast("string").alias("session"), F.col(order).cast("long").alias("turn"), told(op, "string").alias("op"), F.coalesce(text, F.lit("")).alias("delta"), told(expected, "string").alias("expected"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = Tail(engine(), *state.get) if state.exists else Tail(engine())
        new = pd.concat(list(batches)).sort_values("turn")
        none = lambda x: None if pd.isna(x) else x
        out = [(none(key[0]), *held.take(none(o), d, None if pd.isna(e) else int(e))) for o, d, e in zip(new["op"], new["delta"], new["expected"], strict=True)]
        if held.revision < 0 and state.exists:
            state.remove()
        elif held.revision >= 0:
            state.update((held.text, held.sealed, held.revision))
        yield pd.DataFrame(out, columns=["session", "revision", "replace_from", "replacement_ids", "token_count", "path"])

    names = "session string, revision long, replace_from int, replacement_ids array<int>, token_count int, path string"
    out = rows.groupBy("session").applyInPandasWithState(run, names, "text string, sealed long, revision long", "append", "NoTimeout")
    return out.withColumn("session", F.col("session").cast(kind))

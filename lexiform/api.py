"""The front door: load a vocabulary, encode texts or columns, register SQL functions, tell what was done."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from .config import Config
from .config import load as load_config
from .errors import SessionRevisionConflict, SessionStateMismatch, UncertifiedTokenizer, UnsupportedConfig
from .functions import schemes
from .operators import lookup
from .operators.pieces import PieceTokenizer
from .operators.sessions import Session
from .operators.tokens import Tokenizer
from .plans import routing
from .session import ship
from .sources import artifact, manifest
from .sources.sentencepiece import PieceArtifact


@dataclass(frozen=True)
class Encoding:
    ids: tuple[int, ...]
    starts: tuple[int, ...] | None = None
    ends: tuple[int, ...] | None = None


class Lexiform:
    """A loaded vocabulary: single texts on the driver, columns on the cluster, named sessions."""

    def __init__(self, spark: SparkSession, a, config: Config, certified: bool = True) -> None:
        self.spark, self.artifact, self.config = spark, a, config
        try:
            self.plan = routing.plan(config.policy, certified, config.threshold)
        except ValueError:
            raise UncertifiedTokenizer("the policy needs a certified vocabulary", artifact_sha256=a.sha256) from None
        self.columns = (PieceTokenizer if isinstance(a, PieceArtifact) else Tokenizer)(spark, a, config.batch_bytes)
        self.sessions: dict[str, Session] = {}
        self.counts = {"encode": 0, "hit": 0, "append": 0, "overwrite": 0, "seed": 0, "noop": 0, "degraded_full_reencode": 0, "lookup_hit": 0, "lookup_miss": 0, "revision_conflict": 0}

    def encode(self, text: str, *, session: str | None = None, add_special_tokens: bool = False, offsets: bool = False, lookup: DataFrame | None = None) -> Encoding | None:
        """Ids of one text. With a session, the text is its whole transcript. Special tokens go with neither. With ``lookup``, a
        table of stored entries, the ids come from the longest one that begins the text, completed behind its last safe cut
        and kept nowhere; None where there is none, and then nothing is encoded."""
        if lookup is not None:
            if session is not None or add_special_tokens or offsets:
                raise UnsupportedConfig("a lookup goes with no other option", option="lookup", value=True, reason="entries hold core ids")
            one = self.spark.createDataFrame([(0, text)], "q long, t string")
            served = self.lookup(one, lookup, "q", "t").first()
            self.counts["lookup_miss" if served["path"] == "miss" else "lookup_hit"] += 1
            return None if served["path"] == "miss" else Encoding(tuple(served["ids"]))
        if add_special_tokens and (session is not None or offsets):
            raise UnsupportedConfig("special tokens are added to plain encodes only", option="add_special_tokens", value=True, reason="sessions and offsets hold core ids")
        if session is not None:
            held = self.sessions.pop(session, None) or Session(self.columns.local)
            self.sessions[session] = held  # the last used is last
            while len(self.sessions) > self.config.max_sessions:
                del self.sessions[next(iter(self.sessions))]
            path = held.transcript(text)[4]
            self.counts[path] += 1
            ids = held.ids
        else:
            self.counts["encode"] += 1
            ids = self.columns.local.encode(text)
        if offsets:
            if isinstance(self.artifact, PieceArtifact):
                raise UnsupportedConfig("normalizing models have no offsets", option="offsets", value=True, reason="text changes")
            starts, ends = self.columns.local.spans(text, ids)
            return Encoding(tuple(ids), tuple(starts.tolist()), tuple(ends.tolist()))
        return Encoding((*self.artifact.bos, *ids, *self.artifact.eos) if add_special_tokens else tuple(ids))

    def encode_batch(self, texts: list[str]) -> list[Encoding]:
        return [self.encode(t) for t in texts]

    def append(self, session: str, delta: str, expected_revision: int | None = None) -> tuple:
        held = self.sessions.get(session)
        if held is None:
            raise SessionStateMismatch("no such session", session=session)
        patch = held.append(delta, expected_revision)
        if patch[4] == "revision_conflict":
            self.counts[patch[4]] += 1
            raise SessionRevisionConflict("another revision is stored", expected_revision=expected_revision, stored_revision=held.revision)
        self.counts[patch[4]] += 1
        return patch

    def fork(self, session: str, name: str) -> None:
        self.sessions[name] = self.sessions[session].fork()

    def close(self, session: str) -> None:
        self.sessions.pop(session, None)

    def decode(self, ids, skip_special_tokens: bool = True) -> str:
        out = self.columns.local.decode(list(ids), skip_special_tokens)
        return out.decode("utf-8", "replace") if isinstance(out, bytes) else out

    def ids(self, text: Column, add_special_tokens: bool = False) -> Column:
        return self.columns.encode(text, add_special_tokens)

    def ids_of(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, ids) of a table with unique ids, long texts cut and dealt out."""
        if isinstance(self.artifact, PieceArtifact):
            return df.select(id_col, self.ids(F.col(text_col)).alias("ids"))
        return self.columns.encode_spread(df, id_col, text_col, self.config.spread_chars)

    def text(self, ids: Column, skip_special_tokens: bool = True) -> Column:
        return self.columns.decode(ids, skip_special_tokens)

    def lookup(self, queries: DataFrame, store: DataFrame, query_id: str, text: str) -> DataFrame:
        return lookup.serve(self.columns, queries, store, query_id, text)

    def explain(self, df: DataFrame | None = None, text: str = "text") -> str | DataFrame:
        """The plan and its counters, or for a table the number of rows per path and reason."""
        if df is None:
            return f"{self.plan.explain()}\n" + ", ".join(f"{k} {v}" for k, v in self.counts.items() if v)
        literals = [a.content for a in self.artifact.added]
        r = df.select(routing.route(self.plan, F.col(text), literals).alias("r"))
        return r.groupBy("r.path", "r.reason").agg(F.count(F.lit(1)).alias("n_rows"))

    def register(self, prefix: str = "tok") -> None:
        """SQL functions: PREFIX_encode, PREFIX_decode, PREFIX_count and the table function PREFIX_pieces. They are the columns'
        own functions over whole batches; a byte-level text is split in the JVM, and counting sends no ids."""
        held = self.columns
        self.spark.udf.register(f"{prefix}_decode", held.decoder())
        if isinstance(held, PieceTokenizer):
            for name, f in (("encode", held.encoder()), ("count", held.counter())):
                self.spark.udf.register(f"{prefix}_{name}", f)
        else:
            for name, f, kind in (("encode", held.encoder(), "ARRAY<INT>"), ("count", held.counter(), "BIGINT")):
                self.spark.udf.register(f"{prefix}_{name}_pieces", f)
                plain = held.plain_sql("t")
                body = f"{prefix}_{name}_pieces(CASE WHEN NOT ({plain}) THEN t END, CASE WHEN {plain} THEN {schemes.pieces_sql('t', held.artifact.scheme)} END)"
                self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}(t STRING) RETURNS {kind} RETURN {body}")
        scheme = getattr(self.artifact, "scheme", None)
        if scheme:
            from pyspark.sql.functions import udtf

            class Pieces:
                def eval(self, text: str):
                    for n, p in enumerate(schemes.split(text, scheme) if text is not None else ()):
                        yield Row(n, p)

            self.spark.udtf.register(f"{prefix}_pieces", udtf(Pieces, returnType="pos int, piece string"))


def load(spark: SparkSession, path: str, *, scheme: str | None = None, sha256: str | None = None, config: Config | None = None, certified: bool = True, **settings) -> Lexiform:
    """A ``tokenizer.json`` (byte-level or byte-fallback) or a rank file, checked against its digest if one is given."""
    config = (config or load_config(spark)).with_(**settings)
    return Lexiform(ship(spark), artifact.load(spark, path, scheme, sha256), config, certified)


def load_family(spark: SparkSession, family: str, folder: str, listing: DataFrame, **options) -> Lexiform:
    """The same for a family of a manifest: the file whose content is pinned there."""
    path = manifest.resolve(spark, folder, listing, family)
    return load(spark, path, sha256=listing.filter(F.col("family") == family).first()["sha256"], **options)

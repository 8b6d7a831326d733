"""Registered queries of the tokenizer engine, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import oracles
from .functions import schemes, text
from .operators import lookup, sessions, store
from .operators.tokens import Tokenizer, byte_spans, offsets
from .plans import routing
from .session import spread
from .sources import convert, records
from .sources.artifact import byte_artifact, load, unsafe_frame

#: A public byte-level vocabulary; a parameter wherever it is used.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ADDED = ["<script>", "the ", "</p>"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of documents for work that costs more than moving them."""
    return spread(_table(spark, sf_dir, "documents").select(*columns))


def _bytes(spark: SparkSession) -> Tokenizer:
    return Tokenizer(spark, byte_artifact())


_loaded: dict[str, Tokenizer] = {}


def _real(spark: SparkSession) -> Tokenizer:
    """The vocabulary, loaded and sent out once in a session."""
    app = spark.sparkContext.applicationId
    if app not in _loaded:
        _loaded[app] = Tokenizer(spark, load(spark, f"file://{VOCABULARY}"))
    return _loaded[app]


def token_count_by(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _dealt(spark, sf_dir, key, "text")
    counted = docs.select(key, _real(spark).count(F.col("text")).alias("n"))
    return counted.groupBy(key).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("long").alias("n_tokens"))


def _sum(ids) -> F.Column:
    return F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x)


def _digest(ids) -> F.Column:
    """A digest of ids that SQL can repeat."""
    return F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), 256)


def encode_bytes_ids(spark, sf_dir):
    ids = _dealt(spark, sf_dir, "doc_id", "text").select("doc_id", _bytes(spark).encode(F.col("text")).alias("ids"))
    # A text without bytes has no sum and no last id, which SQL tells by null.
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.when(F.size("ids") > 0, _sum("ids")).alias("sum_ids"), F.try_element_at("ids", F.lit(-1)).cast("long").alias("last_id"))


def decode_roundtrip(spark, sf_dir):
    tok = _real(spark)
    ids = _dealt(spark, sf_dir, "doc_id", "text").select("doc_id", tok.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.sha2(tok.decode("ids"), 256).alias("text_sha256"))


def encode_bpe(spark, sf_dir):
    ids = _dealt(spark, sf_dir, "doc_id", "text").select("doc_id", _real(spark).encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sum("ids").alias("sum_ids"), _digest("ids").alias("ids_sha256"))


def spans_tile(spark, sf_dir):
    tok = _real(spark)
    rows = _dealt(spark, sf_dir, "doc_id", "text").select("doc_id", "text", tok.encode(F.col("text")).alias("ids"))
    s = rows.select("doc_id", tok.spans(F.col("text"), F.col("ids")).alias("s")).select("doc_id", "s.*")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("doc_id", F.size("starts").cast("long").alias("n_spans"), total("starts").alias("sum_starts"), total("ends").alias("sum_ends"))


def pieces_by_scheme(spark, sf_dir):
    docs = _dealt(spark, sf_dir, "text")
    name = F.element_at(F.array(*map(F.lit, schemes.SCHEMES)), F.col("k") + 1)
    each = docs.select(F.posexplode(F.array(*[schemes.pieces(F.col("text"), s) for s in schemes.SCHEMES])).alias("k", "p"))
    # Exploded, pieces are counted by compiled code; a text without pieces is a row of its own.
    each = each.select("k", F.size("p").alias("n"), F.posexplode_outer("p").alias("i", "piece"))
    n = F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n"))
    # The sum of the pieces' places times their lengths changes with any cut that moves.
    weight = (F.col("i") + 1).cast("long") * F.length("piece")
    return each.groupBy(name.alias("scheme")).agg(F.sum(n).cast("long").alias("n_pieces"), F.sum(weight).cast("long").alias("weight"))


def memo_reuse_ratio(spark, sf_dir):
    """Pieces and distinct pieces of the corpus: what a memo of pieces saves."""
    each = _dealt(spark, sf_dir, "text").select(F.explode(schemes.pieces(F.col("text"), "gpt2")).alias("piece"))
    return each.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").cast("long").alias("n_pieces"), F.count(F.lit(1)).alias("n_distinct"))


def normalize(column, name: str, spark, sf_dir):
    body = _table(spark, sf_dir, "pages")
    return body.select("page_id", F.sha2(column(F.col("html")), 256).alias(name))


def added_token_prefilter(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.may_hold(F.col("html"), ADDED).alias("may_hold"))


def route_reason_counts(spark, sf_dir):
    plan = routing.plan(threshold=8192)
    r = _table(spark, sf_dir, "documents").select(routing.route(plan, F.col("text"), ADDED).alias("r"))
    return r.groupBy(F.col("r.path").alias("path"), F.col("r.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def size_threshold_route(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.over(F.col("text"), 8192).alias("over"))


def session_patch(spark, sf_dir):
    p = sessions.patches(_real(spark), _table(spark, sf_dir, "conversations"))
    return p.select(F.col("session").alias("conv_id"), "revision", F.col("replace_from").cast("long").alias("replace_from"), F.size("replacement_ids").cast("long").alias("n_replaced"), _sum("replacement_ids").alias("sum_replaced"), F.col("token_count").cast("long").alias("token_count"), "path")


def session_final_length(spark, sf_dir):
    p = sessions.patches(_real(spark), _table(spark, sf_dir, "conversations"))
    return p.groupBy(F.col("session").alias("conv_id")).agg(F.max("revision").alias("revision"), F.max_by("token_count", "revision").cast("long").alias("token_count"))


def unsafe_merges(spark, sf_dir):
    """The merges of a public vocabulary that a fold over ranks would take too early."""
    return unsafe_frame(load(spark, f"file://{VOCABULARY}").merges_frame(spark)).agg(F.count(F.lit(1)).alias("n_merges"))


def conversion_splits(spark, sf_dir):
    """All two-way splits of a rank file's tokens, by the number of bytes of the token."""
    ranks = convert.rank_frame(spark, bytes(spark.read.format("binaryFile").load(f"file://{RANKS}").select("content").first()["content"]))
    n = ranks.select("rank", F.length("token").cast("long").alias("n_bytes"))
    return convert.splits(ranks).join(n, "rank").groupBy("n_bytes").agg(F.count(F.lit(1)).alias("n_splits"), F.sum("left").alias("sum_left"), F.sum("right").alias("sum_right"))


def _transcripts(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("body"), F.element_at("t", 1)["text"].alias("head"))


def prefix_lookup_longest(spark, sf_dir):
    t = _transcripts(spark, sf_dir)
    return lookup.longest_prefix(t, t.select(F.col("conv_id").alias("entry_id"), F.col("head")), "conv_id", "body", "entry_id", "head").withColumn("matched_bytes", F.col("matched_bytes").cast("long"))


def content_digest(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("byte_length"), lookup.content_digest(F.col("text")).alias("end_digest"), F.size(lookup.marks(F.col("text"))).cast("long").alias("n_marks"))


def block_slices(spark, sf_dir):
    return lookup.blocks(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("block", F.col("block").cast("long"))


def block_chain(spark, sf_dir):
    return lookup.chain(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("block", F.col("block").cast("long"))


def chain_prefix_blocks(spark, sf_dir):
    """How many blocks of each conversation from the start on a store of all first turns holds."""
    t = _transcripts(spark, sf_dir)
    return lookup.chain_prefix(t, lookup.chain(t, "conv_id", "head", 16), "conv_id", "body", 16)


def serve_paths(spark, sf_dir):
    """Whole conversations served from a store of their first turns."""
    t, tok = _transcripts(spark, sf_dir), _real(spark)
    store = lookup.entries(tok, t.filter("head <> ''"), "conv_id", "head")
    return lookup.serve(tok, t, store, "conv_id", "body").select("conv_id", "path", F.size("ids").cast("long").alias("n_tokens"), _digest("ids").alias("ids_sha256"))


def store_keep(spark, sf_dir):
    """What a store keeps of all documents as unnamed entries, the newest being those of the largest id."""
    d = _table(spark, sf_dir, "documents")
    store = lookup.entries(_real(spark), d, "doc_id", "text", "auto", F.col("doc_id"))
    return lookup.keep(store).select(F.col("name").alias("doc_id"), "byte_length")


def _records(spark, sf_dir) -> tuple[DataFrame, bytes]:
    tok = _real(spark)
    key = bytes.fromhex(tok.artifact.fingerprint())
    d = _dealt(spark, sf_dir, "doc_id", "text")
    return records.write(d.select(F.col("doc_id").alias("session"), F.lit(0).alias("revision"), "text", tok.encode(F.col("text")).alias("ids")), key, single=True), key


def record_store(spark, sf_dir):
    """Every document as a record, read back and verified."""
    held, key = _records(spark, sf_dir)
    checked = held.select("session", F.length("record").cast("long").alias("n_bytes"), records.verify(F.col("record"), key).alias("v"))
    ids = F.transform("v.ids", lambda x: x)
    return checked.select(F.col("session").alias("doc_id"), "n_bytes", "v.ok", F.sha2(F.col("v.text").cast("binary"), 256).alias("text_sha256"), F.size("v.ids").cast("long").alias("n_tokens"), _digest(ids).alias("ids_sha256"))


def record_damage(spark, sf_dir):
    """Every record as it is and with one byte changed, at a place that the id chooses: only the former are accepted."""
    held, key = _records(spark, sf_dir)
    at = F.pmod(F.col("session") * 7919, F.length("record")).cast("int")
    byte = F.substring(F.col("record"), at + 1, F.lit(1))
    other = F.unhex(F.when(byte == F.lit(b"\xff"), "00").otherwise("FF"))
    bad = F.concat(F.substring(F.col("record"), F.lit(1), at), other, F.substring(F.col("record"), at + 2, F.length("record")))
    both = held.select(F.explode(F.array(F.struct(F.lit(False).alias("damaged"), F.col("record")), F.struct(F.lit(True).alias("damaged"), bad.alias("record")))).alias("r"))
    v = both.select("r.damaged", records.verify(F.col("r.record"), key).alias("v"))
    return v.groupBy("damaged", F.col("v.ok").alias("ok")).agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum(F.size("v.ids")), F.lit(0)).cast("long").alias("n_tokens"))


def session_transcript(spark, sf_dir):
    """Patches of whole growing transcripts, as a caller sends them turn by turn."""
    p = sessions.transcripts(_real(spark), _table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", growing=True)
    return p.groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("replacement_ids")).cast("long").alias("n_replaced"), F.sum(_sum("replacement_ids")).cast("long").alias("sum_replaced"))


def session_fold(spark, sf_dir):
    """A session's ids, put together from its patches."""
    ids = sessions.fold(sessions.patches(_real(spark), _table(spark, sf_dir, "conversations")))
    return ids.select(F.col("session").alias("conv_id"), "revision", F.size("ids").cast("long").alias("n_tokens"), _digest("ids").alias("ids_sha256"))


def encode_spread(spark, sf_dir):
    """Counts with long documents cut at safe places and dealt out to tasks."""
    ids = _real(spark).encode_spread(_dealt(spark, sf_dir, "doc_id", "text"), "doc_id", "text", 4096)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _digest("ids").alias("ids_sha256"))


def ragged_offsets(spark, sf_dir):
    """The place of each document's ids in one long column of all, in the order of the ids of documents, by language."""
    n = _dealt(spark, sf_dir, "lang", "doc_id", "text").select("lang", "doc_id", _real(spark).count(F.col("text")).alias("n"))
    n = n.persist()  # three numbers a document, asked for quantiles, sums and places: texts are encoded once
    parts = max(1, _table(spark, sf_dir, "documents").rdd.getNumPartitions())
    return offsets(n, "lang", "doc_id", "n", parts).select("lang", "doc_id", "offset", "n")


def mark_positions(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lookup.mark_digests(F.col("text"))).alias("k", "m")).select("doc_id", F.col("k").cast("long").alias("k"), F.col("m.pos").alias("pos"), F.col("m.digest").alias("digest"))


def letter_runs_topk(spark, sf_dir):
    """The hundred most frequent letter runs, ties by the run."""
    runs = _dealt(spark, sf_dir, "text").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("piece"))
    return runs.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "piece").limit(100)


def node_sharing(spark, sf_dir):
    """Blocks of all documents as nodes that documents with a common past share, put together again."""
    nodes, heads = store.export(_table(spark, sf_dir, "documents"), "doc_id", "text", 512)
    back = store.restore(nodes, heads)
    return back.select(F.col("session").alias("doc_id"), F.col("n_blocks").cast("long").alias("n_blocks"), "whole", F.sha2("text", 256).alias("text_sha256"))


def node_counts(spark, sf_dir):
    """How many blocks all documents have at each place, and how many nodes are written for them."""
    d = _table(spark, sf_dir, "documents")
    nodes, heads = store.export(d, "doc_id", "text", 512)
    held = store.checked(nodes).groupBy("block").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("ok").alias("ok"))
    every = heads.filter("n_blocks > 0").select(F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    n = every.groupBy("block").agg(F.count(F.lit(1)).alias("n_blocks"))
    return n.join(held, "block").select(F.col("block").cast("long").alias("block"), "n_blocks", "n_nodes", "ok")


def index_rebuild(spark, sf_dir):
    """The digest index of all records where the sidecar is of other records for ids that five divides: those are made anew."""
    # The store, read for its hashes, for the sidecar and for what is made anew: its records are made once.
    held = _records(spark, sf_dir)[0].persist(StorageLevel.DISK_ONLY)
    sidecar = store.bind(held).withColumn("bound", F.when(F.col("session") % 5 == 0, F.lit("of another")).otherwise(F.col("bound")))
    i = store.index(held, sidecar)
    return i.select(F.col("session").alias("doc_id"), "rebuilt", "byte_length", "end_digest", F.size("marks").cast("long").alias("n_marks"))


def record_chain(spark, sf_dir):
    """Every conversation after every turn as chained records, verified from the first on, with the shape of its appends."""
    tok = _real(spark)
    told = sessions.recorded(tok, _table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", bytes.fromhex(tok.artifact.fingerprint()))
    return told.withColumnRenamed("session", "conv_id").select("conv_id", "revision", "ok", "kept", "n_tokens", "replace_from")


def route_execute(spark, sf_dir):
    """Every document by the path that its size and content give it, with the ids of that path."""
    tok = _real(spark)
    done = routing.execute(routing.plan(threshold=8192), tok, _dealt(spark, sf_dir, "doc_id", "text"), "doc_id", "text")
    return done.select("doc_id", "path", "reason", F.size("ids").cast("long").alias("n_tokens"), _digest("ids").alias("ids_sha256"))


def piece_spans(spark, sf_dir):
    """Where pieces lie in the bytes of each document."""
    s = _dealt(spark, sf_dir, "doc_id", "text").select("doc_id", byte_spans(schemes.pieces(F.col("text"), "o200k")).alias("s"))
    return s.select("doc_id", F.size("s.starts").cast("long").alias("n_pieces"), _sum("s.starts").alias("sum_starts"), _sum("s.ends").alias("sum_ends"))


def span_checkpoints(spark, sf_dir):
    """Spans of 64 tokens from the 200th on, told from checkpoints that lie 128 tokens apart."""
    tok = _real(spark)
    rows = _dealt(spark, sf_dir, "doc_id", "text").select("doc_id", "text", tok.encode(F.col("text")).alias("ids"))
    rows = rows.select("doc_id", "text", "ids", tok.checkpoints(F.col("text"), F.col("ids"), 128).alias("marks"))
    w = rows.select("doc_id", F.size("marks").cast("long").alias("n_marks"), tok.window(F.col("text"), F.col("ids"), F.col("marks"), 200, 264).alias("w"))
    return w.select("doc_id", "n_marks", F.size("w.starts").cast("long").alias("n_spans"), _sum("w.starts").alias("sum_starts"), _sum("w.ends").alias("sum_ends"))


def safe_cuts(spark, sf_dir):
    """At how many places each document can be cut, and its longest part between two of them."""
    parts = _table(spark, sf_dir, "documents").select("doc_id", schemes.ranges(F.col("text"), 1).alias("p"))
    return parts.select("doc_id", F.size("p").cast("long").alias("n_parts"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).cast("long").alias("longest"))


def vocab_byte_lengths(spark, sf_dir):
    v = load(spark, f"file://{VOCABULARY}").vocab_frame(spark)
    return v.groupBy(F.octet_length("bytes").cast("long").alias("n_bytes")).agg(F.count(F.lit(1)).alias("n_tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "token_count_by_lang": partial(token_count_by, "lang"),
        "token_count_by_source": partial(token_count_by, "source"),
        "encode_bytes_ids": encode_bytes_ids,
        "encode_bpe": encode_bpe,
        "decode_roundtrip": decode_roundtrip,
        "spans_tile": spans_tile,
        "pieces_by_scheme": pieces_by_scheme,
        "memo_reuse_ratio": memo_reuse_ratio,
        "norm_collapse_spaces": partial(normalize, text.collapse_spaces, "sha256"),
        "norm_strip": partial(normalize, text.strip, "sha256"),
        "metaspace": partial(normalize, text.metaspace, "sha256"),
        "added_token_prefilter": added_token_prefilter,
        "route_reason_counts": route_reason_counts,
        "size_threshold_route": size_threshold_route,
        "session_patch": session_patch,
        "session_final_length": session_final_length,
        "prefix_lookup_longest": prefix_lookup_longest,
        "content_digest": content_digest,
        "block_slices": block_slices,
        "vocab_byte_lengths": vocab_byte_lengths,
        "unsafe_merges": unsafe_merges,
        "conversion_splits": conversion_splits,
        "block_chain": block_chain,
        "chain_prefix_blocks": chain_prefix_blocks,
        "serve_paths": serve_paths,
        "store_keep": store_keep,
        "record_store": record_store,
        "record_damage": record_damage,
        "session_transcript": session_transcript,
        "session_fold": session_fold,
        "encode_spread": encode_spread,
        "ragged_offsets": ragged_offsets,
        "mark_positions": mark_positions,
        "letter_runs_topk": letter_runs_topk,
        "node_sharing": node_sharing,
        "node_counts": node_counts,
        "index_rebuild": index_rebuild,
        "record_chain": record_chain,
        "route_execute": route_execute,
        "piece_spans": piece_spans,
        "span_checkpoints": span_checkpoints,
        "safe_cuts": safe_cuts,
    }


_DOCS = oracles.merged(RANKS, "SELECT doc_id, text FROM documents")
#: (doc_id, text, ids) of whole documents.
_IDS = _DOCS + ", d AS (SELECT t.doc_id, t.text, coalesce(i.ids, []) AS ids FROM t LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM p JOIN b USING (piece) GROUP BY doc_id) i USING (doc_id)) "
_SHA = "sha256(array_to_string({0}, ','))"
#: Every conversation after every turn: its whole text is split and merged anew, and compared with what it was before.
_GROWN = (
    oracles.merged(RANKS, "SELECT conv_id || ':' || turn AS k, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS text FROM conversations", key="k")
    + ", i AS (SELECT k, flatten(list(ids ORDER BY pos)) AS ids FROM p JOIN b USING (piece) GROUP BY k)"
    + ", c AS (SELECT conv_id, turn, c.text AS delta, coalesce(i.ids, []) AS ids, coalesce(lag(i.ids) OVER s, []) AS old, row_number() OVER s - 1 AS revision, row_number() OVER s AS nth, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations c LEFT JOIN i ON i.k = conv_id || ':' || turn WINDOW s AS (PARTITION BY conv_id ORDER BY turn))"
    + ", e AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(ids), len(old)) + 1), lambda x: ids[x] = old[x]), false) - 1, least(len(ids), len(old))) AS same FROM c)"
    + ", s AS (SELECT conv_id, revision, nth, turns, ids, CAST(same AS BIGINT) AS replace_from, ids[same + 1 :] AS new, CAST(len(ids) AS BIGINT) AS token_count, delta, old FROM e) "
)


def oracle_sql() -> dict[str, str]:
    held = " OR ".join(f"contains({{0}}, '{x}')" for x in ADDED)
    return {
        "token_count_by_lang": _IDS + "SELECT lang, count(*) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM d JOIN documents USING (doc_id) GROUP BY lang",
        "token_count_by_source": _IDS + "SELECT source, count(*) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM d JOIN documents USING (doc_id) GROUP BY source",
        "encode_bytes_ids": "WITH h AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents), b AS (SELECT doc_id, n, list_transform(range(0, n), lambda i: 16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS ids FROM h) SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(list_sum(ids) AS BIGINT) AS sum_ids, CAST(ids[-1] AS BIGINT) AS last_id FROM b",
        "encode_bpe": _IDS + f"SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS sum_ids, {_SHA.format('ids')} AS ids_sha256 FROM d",
        "pieces_by_scheme": " UNION ALL ".join(f"SELECT '{s}' AS scheme, CAST(sum(len(x)) AS BIGINT) AS n_pieces, CAST(sum(list_sum(list_transform(range(1, len(x) + 1), lambda i: i * length(x[i])))) AS BIGINT) AS weight FROM (SELECT {oracles.pieces(s)} AS x FROM documents)" for s in schemes.SCHEMES),
        "memo_reuse_ratio": f"SELECT CAST(sum(n) AS BIGINT) AS n_pieces, count(*) AS n_distinct FROM (SELECT piece, count(*) AS n FROM (SELECT unnest({oracles.pieces('gpt2')}) AS piece FROM documents) GROUP BY piece)",
        "node_sharing": "SELECT doc_id, CAST(length(coalesce(text, '')) // 512 AS BIGINT) AS n_blocks, true AS whole, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
        "node_counts": "SELECT k - 1 AS block, count(*) AS n_blocks, count(DISTINCT substr(text, 1, 512 * k)) AS n_nodes, true AS ok FROM (SELECT text, unnest(range(1, length(text) // 512 + 1)) AS k FROM documents) GROUP BY k",
        "index_rebuild": "SELECT doc_id, doc_id % 5 = 0 AS rebuilt, CAST(strlen(text) AS BIGINT) AS byte_length, sha256(text) AS end_digest, CAST(len(list_filter(range(0, 19), lambda k: 4096 * (1::BIGINT << k) < strlen(text))) AS BIGINT) AS n_marks FROM documents",
        "record_chain": _GROWN + "SELECT conv_id, revision, true AS ok, true AS kept, token_count AS n_tokens, replace_from FROM s",
        "route_execute": _IDS + f"SELECT doc_id, CASE WHEN contains(text, '<|endoftext|>') THEN 'reference' WHEN strlen(text) < 8192 THEN 'fast' ELSE 'split' END AS path, CASE WHEN contains(text, '<|endoftext|>') THEN 'R_INPUT_ADDED_TOKEN' WHEN strlen(text) < 8192 THEN 'R_INPUT_BELOW_GPU_THRESHOLD' END AS reason, CAST(len(ids) AS BIGINT) AS n_tokens, {_SHA.format('ids')} AS ids_sha256 FROM d",
        "piece_spans": f"WITH q AS (SELECT doc_id, {oracles.pieces('o200k')} AS x FROM documents), p AS (SELECT doc_id, unnest(range(0, len(x))) AS pos, unnest(x) AS piece FROM q), o AS (SELECT doc_id, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS e, strlen(piece) AS n FROM p) SELECT doc_id, count(e) AS n_pieces, CAST(coalesce(sum(e - n), 0) AS BIGINT) AS sum_starts, CAST(coalesce(sum(e), 0) AS BIGINT) AS sum_ends FROM documents LEFT JOIN o USING (doc_id) GROUP BY doc_id",
        "span_checkpoints": _DOCS
        + """, g AS (SELECT piece, list_transform(range(1, len(piece) + 1), lambda i: strlen(piece[1:i])) AS ends, list_transform(range(0, len(sizes)), lambda i: coalesce(list_sum(sizes[1:i]), 0)) AS begin, sizes FROM b),
h AS (SELECT piece, list_transform(range(1, len(sizes) + 1), lambda i: len(list_filter(ends, lambda e: e <= begin[i]))) AS starts, list_transform(range(1, len(sizes) + 1), lambda i: 1 + len(list_filter(ends, lambda e: e < begin[i] + sizes[i]))) AS stops FROM g),
o AS (SELECT doc_id, pos, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM p),
w AS (SELECT doc_id, pos, base + unnest(starts) AS a, base + unnest(stops) AS z, unnest(range(0, len(starts))) AS k FROM o JOIN h USING (piece)),
y AS (SELECT doc_id, a, z, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS n FROM w)
SELECT t.doc_id, count(CASE WHEN n % 128 = 0 THEN 1 END) AS n_marks, count(CASE WHEN n BETWEEN 200 AND 263 THEN 1 END) AS n_spans, CAST(coalesce(sum(CASE WHEN n BETWEEN 200 AND 263 THEN a END), 0) AS BIGINT) AS sum_starts, CAST(coalesce(sum(CASE WHEN n BETWEEN 200 AND 263 THEN z END), 0) AS BIGINT) AS sum_ends FROM t LEFT JOIN y USING (doc_id) GROUP BY t.doc_id""",
        "safe_cuts": r"WITH c AS (SELECT doc_id, text, list_filter(range(2, length(text) + 1), lambda i: regexp_matches(substr(text, i - 1, 3), '^(?:[\p{L}\p{N}] \p{L}|\p{L}[\n,.;:!?()\[\]{}<>=+*/%&|^~@#$\x22\\、。，；：！？（）])')) AS cuts FROM documents), e AS (SELECT doc_id, [1] || cuts || [length(text) + 1] AS b, length(text) AS n FROM c) SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE CAST(len(b) - 1 AS BIGINT) END AS n_parts, CAST(coalesce(list_max(list_transform(range(1, len(b)), lambda i: b[i + 1] - b[i])), 0) AS BIGINT) AS longest FROM e",
        "decode_roundtrip": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
        "spans_tile": _DOCS
        + """, g AS (SELECT piece, list_transform(range(1, len(piece) + 1), lambda i: strlen(piece[1:i])) AS ends, list_transform(range(0, len(sizes)), lambda i: list_sum(sizes[1:i])) AS begin, sizes FROM b),
h AS (SELECT piece, CAST(len(sizes) AS BIGINT) AS n, list_sum(list_transform(range(1, len(sizes) + 1), lambda i: len(list_filter(ends, lambda e: e <= coalesce(begin[i], 0))))) AS starts, list_sum(list_transform(range(1, len(sizes) + 1), lambda i: 1 + len(list_filter(ends, lambda e: e < coalesce(begin[i], 0) + sizes[i])))) AS stops FROM g),
o AS (SELECT doc_id, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM p)
SELECT t.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_spans, CAST(coalesce(sum(base * n + starts), 0) AS BIGINT) AS sum_starts, CAST(coalesce(sum(base * n + stops), 0) AS BIGINT) AS sum_ends FROM t LEFT JOIN o USING (doc_id) LEFT JOIN h USING (piece) GROUP BY t.doc_id""",
        "norm_collapse_spaces": "SELECT page_id, sha256(regexp_replace(html, ' {2,}', ' ', 'g')) AS sha256 FROM pages",
        "norm_strip": r"SELECT page_id, sha256(regexp_replace(html, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g')) AS sha256 FROM pages",
        "metaspace": "SELECT page_id, sha256(CASE WHEN html = '' OR starts_with(replace(html, ' ', '▁'), '▁') THEN replace(html, ' ', '▁') ELSE '▁' || replace(html, ' ', '▁') END) AS sha256 FROM pages",
        "added_token_prefilter": f"SELECT page_id, ({held.format('html')}) AS may_hold FROM pages",
        "route_reason_counts": f"SELECT path, reason, count(*) AS n_rows FROM (SELECT CASE WHEN {held.format('text')} THEN 'reference' WHEN strlen(text) < 8192 THEN 'fast' ELSE 'split' END AS path, CASE WHEN {held.format('text')} THEN 'R_INPUT_ADDED_TOKEN' WHEN strlen(text) < 8192 THEN 'R_INPUT_BELOW_GPU_THRESHOLD' END AS reason FROM documents) GROUP BY path, reason",
        "size_threshold_route": "SELECT doc_id, strlen(text) >= 8192 AS over FROM documents",
        "session_patch": _GROWN + "SELECT conv_id, revision, replace_from, CAST(len(new) AS BIGINT) AS n_replaced, CAST(coalesce(list_sum(new), 0) AS BIGINT) AS sum_replaced, token_count, CASE WHEN delta = '' THEN 'noop' WHEN len(old) = 0 THEN 'seed' ELSE 'append' END AS path FROM s",
        "session_final_length": _GROWN + "SELECT conv_id, revision, token_count FROM s WHERE nth = turns",
        "prefix_lookup_longest": "WITH t AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS body, first(text ORDER BY turn) AS head FROM conversations GROUP BY conv_id), c AS (SELECT q.conv_id, e.conv_id AS entry_id, CAST(strlen(e.head) AS BIGINT) AS matched_bytes, row_number() OVER (PARTITION BY q.conv_id ORDER BY strlen(e.head) DESC, e.conv_id) AS k FROM t q JOIN t e ON starts_with(q.body, e.head) AND e.head <> '') SELECT conv_id, entry_id, matched_bytes FROM c WHERE k = 1",
        "content_digest": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS byte_length, sha256(text) AS end_digest, CAST(len(list_filter(range(0, 19), lambda k: 4096 * (1::BIGINT << k) < strlen(text))) AS BIGINT) AS n_marks FROM documents",
        "vocab_byte_lengths": f"SELECT CAST(length(k) AS BIGINT) AS n_bytes, count(*) AS n_tokens FROM (SELECT unnest(json_keys(content, '$.model.vocab')) AS k FROM read_text('{VOCABULARY}') UNION SELECT unnest(json_extract_string(content, '$.added_tokens[*].content')) FROM read_text('{VOCABULARY}')) GROUP BY 1",
        "unsafe_merges": f"WITH l AS (SELECT from_json(json_extract(content, '$.model.merges'), '[\"json\"]') AS ms FROM read_text('{VOCABULARY}')), m AS (SELECT unnest(range(1, len(ms) + 1)) AS rank, unnest(ms) AS x FROM l), p AS (SELECT rank, CASE WHEN json_type(x) = 'ARRAY' THEN x ->> 0 ELSE split_part(x ->> '$', ' ', 1) END AS a, CASE WHEN json_type(x) = 'ARRAY' THEN x ->> 1 ELSE split_part(x ->> '$', ' ', 2) END AS b FROM m), made AS (SELECT a || b AS t, min(rank) AS made FROM p GROUP BY 1) SELECT count(*) AS n_merges FROM p LEFT JOIN made l ON l.t = p.a LEFT JOIN made r ON r.t = p.b WHERE l.made > p.rank OR r.made > p.rank",
        "conversion_splits": f"WITH r AS (SELECT hex(from_base64(token)) AS h, rank FROM read_csv('{RANKS}', delim=' ', header=false, quote='', escape='', columns={{'token': 'VARCHAR', 'rank': 'BIGINT'}})), s AS (SELECT h, unnest(range(1, length(h) // 2)) AS k FROM r) SELECT CAST(length(s.h) // 2 AS BIGINT) AS n_bytes, count(*) AS n_splits, CAST(sum(a.rank) AS BIGINT) AS sum_left, CAST(sum(b.rank) AS BIGINT) AS sum_right FROM s JOIN r a ON a.h = substr(s.h, 1, 2 * k) JOIN r b ON b.h = substr(s.h, 2 * k + 1) GROUP BY 1",
        "block_chain": "WITH b AS (SELECT doc_id, text, list_transform(range(0, length(text) // 4096), lambda i: substr(text, 4096 * i + 1, 4096)) AS bs FROM documents), k AS (SELECT doc_id, bs, unnest(range(1, len(bs) + 1)) AS k FROM b) SELECT doc_id, k - 1 AS block, list_reduce([''] || bs[1:k], lambda a, x: sha256(a || x)) AS node FROM k",
        "chain_prefix_blocks": "WITH t AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS body, first(text ORDER BY turn) AS head FROM conversations GROUP BY conv_id), h AS (SELECT DISTINCT substr(head, 1, 16 * k) AS p FROM (SELECT head, unnest(range(1, length(head) // 16 + 1)) AS k FROM t)), p AS (SELECT conv_id, substr(body, 1, 16 * k) AS p FROM (SELECT conv_id, body, unnest(range(1, length(body) // 16 + 1)) AS k FROM t)) SELECT t.conv_id, count(h.p) AS n_blocks FROM t LEFT JOIN p USING (conv_id) LEFT JOIN h USING (p) GROUP BY t.conv_id",
        "serve_paths": oracles.merged(RANKS, "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id", key="conv_id")
        + ", i AS (SELECT conv_id, flatten(list(ids ORDER BY pos)) AS ids FROM p JOIN b USING (piece) GROUP BY conv_id), h AS (SELECT conv_id, first(text ORDER BY turn) AS head FROM conversations GROUP BY conv_id), x AS (SELECT t.conv_id, max(strlen(head)) AS n, any_value(strlen(t.text)) AS size FROM t JOIN h ON head <> '' AND starts_with(t.text, head) GROUP BY t.conv_id) "
        + f"SELECT t.conv_id, CASE WHEN x.n IS NULL THEN 'miss' WHEN x.n = x.size THEN 'exact' ELSE 'extension' END AS path, CASE WHEN x.n IS NOT NULL THEN CAST(len(ids) AS BIGINT) END AS n_tokens, CASE WHEN x.n IS NOT NULL THEN {_SHA.format('ids')} END AS ids_sha256 FROM t LEFT JOIN x USING (conv_id) LEFT JOIN i USING (conv_id)",
        "store_keep": "SELECT doc_id, n AS byte_length FROM (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id DESC) AS s FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE strlen(text) >= 4096 ORDER BY doc_id DESC LIMIT 1024)) WHERE s <= 134217728",
        "record_store": _IDS + f"SELECT doc_id, CAST(200 + 4 * len(ids) + strlen(text) AS BIGINT) AS n_bytes, true AS ok, sha256(text) AS text_sha256, CAST(len(ids) AS BIGINT) AS n_tokens, {_SHA.format('ids')} AS ids_sha256 FROM d",
        "record_damage": _IDS + "SELECT damaged, NOT damaged AS ok, count(*) AS n_records, CAST(sum(CASE WHEN damaged THEN 0 ELSE len(ids) END) AS BIGINT) AS n_tokens FROM d, (VALUES (true), (false)) x(damaged) GROUP BY damaged",
        "session_transcript": _GROWN + "SELECT CASE WHEN delta = '' THEN 'hit' WHEN len(old) = 0 THEN 'seed' ELSE 'append' END AS path, count(*) AS n_rows, CAST(sum(len(new)) AS BIGINT) AS n_replaced, CAST(sum(coalesce(list_sum(new), 0)) AS BIGINT) AS sum_replaced FROM s GROUP BY 1",
        "session_fold": _GROWN + f"SELECT conv_id, revision, token_count AS n_tokens, {_SHA.format('ids')} AS ids_sha256 FROM s WHERE nth = turns",
        "encode_spread": _IDS + f"SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, {_SHA.format('ids')} AS ids_sha256 FROM d",
        "ragged_offsets": _IDS + "SELECT lang, doc_id, CAST(coalesce(sum(len(ids)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", CAST(len(ids) AS BIGINT) AS n FROM d JOIN documents USING (doc_id)",
        "mark_positions": "SELECT doc_id, k, pos, sha256(array_slice(encode(text), 1, pos)) AS digest FROM (SELECT doc_id, text, k, 4096 * (1::BIGINT << k) AS pos FROM (SELECT doc_id, text, unnest(range(0, 19)) AS k FROM documents)) WHERE pos < strlen(text)",
        "letter_runs_topk": r"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS piece FROM documents) GROUP BY piece ORDER BY n DESC, piece LIMIT 100",
        "block_slices": "SELECT doc_id, k - 1 AS block, sha256(substr(text, 1, k * 4096)) AS digest FROM (SELECT doc_id, text, unnest(range(1, length(text) // 4096 + 1)) AS k FROM documents)",
    }

"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, mpegts
from .exact import exact_dedup
from .licenses import license_scan
from .lm import lm_scores
from .minhash import near_dups
from .packing import pack
from .pieces import Pieces, decode_column, encode_column
from .substring import remove_repeats
from .tables import materialise, remainder
from .warc import round_trip

#: Where public vocabularies lie; a parameter of the operators.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge-dropout ids of every text, decoded again: the digests tell that the text came back."""
    pieces = Pieces.load(VOCABULARY)
    return decode_column(encode_column(table(spark, sf_dir, "documents"), pieces, rate=0.1, seed=17), pieces)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("intact")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as written media columns, read back; the feature tells timestamps and random-access points of their units."""
    media = materialise(mpegts.mux_column(table(spark, sf_dir, "documents")), "media")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return mpegts.demux_column(media).select(*names, mpegts.feature().alias("feature"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = (remainder("doc_id", 4) == 2).alias("held_out")
    model = langid.fit(docs, learn=remainder("doc_id", 4) != 2)
    return langid.predict(docs.select("doc_id", "text", held), model).drop("text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents"))


#: SHA-1 in base32: five bits of its 160 for each letter.
OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), d AS (
  SELECT page_id, top, strlen(body) AS n,
         list_reduce(list_transform(range(0, 40), lambda i: printf('%04d', CAST(bin(strpos('0123456789abcdef', substr(sha1(body), i + 1, 1)) - 1) AS INTEGER))), lambda a, b: a || b) AS bits
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
           + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER)
           + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER), 1)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top = page_id THEN NULL ELSE top END AS refers_to
FROM d
"""

OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: Exact over whole tables: windows are compared as lists of words. Each row is a document, also where ids repeat or are null.
OP5_SQL = r"""
WITH w AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) AS r, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT r, s, array_to_string(words[s : s + 19], ' ') AS body
  FROM (SELECT r, words, unnest(range(1, len(words) - 18)) AS s FROM w)
), again AS (
  SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY body ORDER BY r, s) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 20)) AS p FROM again
), each AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
), kept AS (
  SELECT e.r, count(*) AS n_words, count(g.p) AS n_removed,
         coalesce(string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL), '') AS body
  FROM each e LEFT JOIN gone g USING (r, p) GROUP BY e.r
)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

#: Exact over whole tables: every pair that shares a shingle is compared on its full sets, links are closed by recursion.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), k AS (
  SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id
), c AS (
  SELECT k, min(doc_id) AS rep FROM k GROUP BY k
), sr AS (
  SELECT s.doc_id, s.g FROM s JOIN c ON s.doc_id = c.rep
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS x FROM sr a JOIN sr b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), both_ways AS (
  SELECT u, v FROM links JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * x >= 75 * (a.n + b.n - x)
), edges AS (
  SELECT u, v FROM both_ways UNION ALL SELECT v, u FROM both_ways
), reach AS (
  SELECT rep AS u, rep AS v FROM c UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u
), low AS (
  SELECT u, min(v) AS m FROM reach GROUP BY u
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.m, w.doc_id) AS component_id, coalesce(low.m, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN c USING (k) LEFT JOIN low ON low.u = c.rep
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_warc": op3_warc,
        "op4_media_columns": op4_media_columns,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_language_id": op6_language_id,
        "op7_license_scan": op7_license_scan,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op5_substring_dedup": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op10_minhash_near_dedup": OP10_SQL}

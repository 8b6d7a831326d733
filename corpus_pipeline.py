"""The corpus pipeline: language, exact copies, near copies, repeated passages, packing.

Each stage takes the documents that the one before it kept, with the columns of ``documents``. The last
one returns the packed pieces.

A null text has no letter and goes in the first stage. Null ids: each such row is a document of its own, exact copies among
them fold into one, near copies of them are not sought. A null lang, source or n_chars stays as it is; without any lang there
is no model, and every document with a letter goes on. A column of ``documents`` that a table lacks counts as null, further
columns are left out. Repeated rows fold into one. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm import langid
from lexiform.llm.exact import exact_dedup
from lexiform.llm.minhash import near_dups
from lexiform.llm.packing import pack
from lexiform.llm.substring import remove_repeats
from lexiform.llm.tables import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A prediction below it is no language. A guess among four languages has at least a quarter; with more languages
#: the bound is as far above an even guess as it is there.
CONFIDENCE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language go on: not those without a letter or without a confident prediction. Without a
    labelled document there is no prediction, and all with a letter go on."""
    model = langid.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    least = min(CONFIDENCE, 4 * CONFIDENCE / len(model.langs))
    found = langid.predict(docs.select(*COLUMNS), model, lang_out="_pred", score_out="_score")
    return found.filter((F.col("_pred") != langid.UNKNOWN) & (F.col("_score") >= least)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts goes on, that of the largest id; one also of rows that repeat text and id."""
    # A null id gets a value of its own, so that the join and the last step deal texts out by the same keys, once.
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")
    kept = exact_dedup(docs).filter("kept").select(key, F.col("text_sha256").alias("_own"))
    rows = docs.select(*COLUMNS, key, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_own"))
    rows = rows.join(kept, ["_key", "_own"], "left_semi")
    return rows.dropDuplicates(["_key", "_own"]).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component goes on, that of the smallest id."""
    gone = near_dups(docs).filter("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat an earlier one; a text that was nothing else goes."""
    out = remove_repeats(docs, with_text=True, carry=["lang", "source", "n_chars"])
    out = out.filter("n_removed = 0 or n_removed < n_words")
    count = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", count.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in training sequences."""
    return pack(docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("substring dedup", passages),
    ("best-fit packing", packing),
]

#: The language model and the hash-ordered packing have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    docs = docs.select(*(F.col(c) if c in docs.columns else F.lit(None).cast(kinds[c]).alias(c) for c in COLUMNS))
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

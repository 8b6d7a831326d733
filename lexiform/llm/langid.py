"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased characters in a space of fixed size, so document
frequencies, weights and whatever else is sent around have a bound that no input raises. Document
frequencies cover all learning rows. The weights are trained by follow-the-regularised-leader with
elastic-net penalties, which leaves most of them zero, on at most ``fit_rows`` learning rows: those with the
smallest hashes of their ids. A temperature fitted on a tenth of them, held out from training, calibrates
the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import batch, bound_batches, lean

BITS = 15
SPACE = 1 << BITS
FIT_ROWS = 3000
#: Rows that a language has in the sample at least.
LEAST = 20
#: Characters of one text worked on at a time.
SPAN = 1 << 18
UNKNOWN = "und"


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text and how often each occurs, over the whole text."""
    total = np.zeros(SPACE, np.int64) if len(text) > SPAN else None
    found = None
    for at in range(0, max(1, len(text)), SPAN):
        part = text[max(0, at - 2) : at + SPAN].lower()
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        skip = min(2, at)
        h = [c * np.uint32(0x9E3779B1)]
        for _ in range(2):
            h.append(h[-1][:-1] * np.uint32(0x85EBCA6B) + c[len(h) :] * np.uint32(0xC2B2AE35) + np.uint32(len(h)))
        h = np.concatenate([x[max(0, skip - k) :] for k, x in enumerate(h)])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        found = np.bincount(h >> np.uint32(32 - BITS), minlength=SPACE)
        if total is not None:
            total += found
    found = found if total is None else total
    where = np.flatnonzero(found)
    return where, found[where]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (features, languages)
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        where, n = counts(text)
        x = (1 + np.log(n)) * self.idf[where]
        return where, x / (np.sqrt((x * x).sum()) or 1.0)

    def probabilities(self, text: str) -> np.ndarray:
        where, x = self.features(text)
        return _softmax((x @ self.weights[where] + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], idf: np.ndarray, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """Follow-the-regularised-leader over (features, values, label) rows in their order."""
    k = len(langs)
    z, n = np.zeros((SPACE + 1, k)), np.zeros((SPACE + 1, k))  # the last feature is the bias

    def weights(at):
        step = (beta + np.sqrt(n[at])) / alpha + l2
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / step)

    held = [r for i, r in enumerate(rows) if i % 10 == 9]
    learn = [r for i, r in enumerate(rows) if i % 10 != 9] or rows
    for _ in range(epochs):
        for where, x, label in learn:
            at, v = np.append(where, SPACE), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(v @ w)
            p[label] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(SPACE + 1))
    model = Model(langs, w[:-1].astype(np.float32), w[-1], idf)
    if held:
        logits = np.stack([x @ model.weights[where] + model.bias for where, x, _ in held])
        labels = np.array([y for _, _, y in held])
        loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()
        low, high = np.log(0.05), np.log(20.0)  # golden section over log temperature
        for _ in range(40):
            a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
            low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for kv in values.items() for x in kv))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, fit_rows: int = FIT_ROWS, max_langs: int = 1024) -> Model | None:
    """A model of the rows of ``docs`` where ``learn`` holds and text and language are not null; None without such rows.

    Document frequencies cover all these rows. The classifier is fitted on ``fit_rows`` of them, languages by their shares and
    each with ``LEAST`` rows where it has so many: a bounded sample, chosen by hash, of rows that differ. Over ``max_langs`` distinct values of
    ``lang_col`` are an error. In the frequencies rows that repeat count each; long texts are read whole; further columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.lit(True) if learn is None else learn))
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("order"))

    def frequencies(batches):
        df, n = np.zeros(SPACE, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df[counts(t)[0]] += 1
                n += 1
        if n:
            where = np.flatnonzero(df)
            yield batch(pa.schema([("f", pa.int32()), ("n", pa.int64())]), [np.append(where, SPACE).astype(np.int32), np.append(df[where], n)])

    # At most SPACE + 1 rows whatever the input: the space of features is fixed.
    df = {r["f"]: r["n"] for r in rows.select("text").mapInArrow(lean(frequencies), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(SPACE, 0)
    if not total:
        return None
    seen = np.zeros(SPACE)
    seen[list(df)] = list(df.values())
    idf = np.log((1 + total) / (1 + seen)) + 1
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"over {max_langs} languages: the model is a number for each of them and each feature")
    langs = sorted(r["lang"] for r in sizes)

    def vectors(batches):
        schema = pa.schema([("order", pa.int64()), ("lang", pa.string()), ("f", pa.binary()), ("x", pa.binary())])
        for b in batches:
            fx = [counts(t) for t in b.column(0).to_pylist()]
            yield batch(schema, [b.column(2), b.column(1), [f.astype(np.uint16).tobytes() for f, _ in fx], [n.astype(np.int32).tobytes() for _, n in fx]])

    # Each language's learning rows of the smallest hashes of id and text: its share of ``fit_rows``, ``LEAST`` at least, each text
    # of an id once. Hashes are even, so that thrice the wanted share of them is enough unless rows repeat; for languages where
    # it isn't the share is widened until it is, or all rows are in.
    quota = {r["lang"]: max(LEAST, round(fit_rows * r["n"] / total)) for r in sizes}
    share = {r["lang"]: min(1.0, 3 * quota[r["lang"]] / r["n"]) for r in sizes}
    lacking, last = langs, {}
    while lacking:
        ends = _map({lang: min(int(share[lang] * 2**64), 2**64 - 1) - 2**63 for lang in lacking})
        few = rows.filter(F.col("order") <= ends[F.col("lang")]).select("lang", "order").distinct()
        ranked = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).filter(F.col("k") <= _map(quota)[F.col("lang")])
        found = {r["lang"]: r for r in ranked.groupBy("lang").agg(F.max("order").alias("last"), F.max("k").alias("k")).collect()}
        enough = [lang for lang in lacking if share[lang] >= 1 or (lang in found and found[lang]["k"] >= quota[lang])]
        last |= {lang: found[lang]["last"] for lang in enough}
        lacking = [lang for lang in lacking if lang not in enough]
        share |= {lang: min(1.0, 8 * share[lang]) for lang in lacking}
    chosen = rows.filter(F.col("order") <= _map(last)[F.col("lang")]).dropDuplicates(["lang", "order"])
    got = chosen.select("text", "lang", "order").mapInArrow(lean(vectors), "order long, lang string, f binary, x binary").collect()
    index = {lang: i for i, lang in enumerate(langs)}
    model = Model(langs, np.zeros((SPACE, len(langs)), np.float32), np.zeros(len(langs)), idf)
    data = []
    for r in sorted(got, key=lambda r: (r["order"], r["lang"], bytes(r["f"]))):
        where, n = np.frombuffer(r["f"], np.uint16).astype(np.int64), np.frombuffer(r["x"], np.int32)
        x = (1 + np.log(n)) * idf[where]
        data.append((where, x / (np.sqrt((x * x).sum()) or 1.0), index[r["lang"]]))
    return train(data, model.langs, idf)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability.

    ``und`` with score 0 for a null text or one without a letter, or without a model. Only the text is read, all of it; of equal
    scores the first language in order is told. Columns of ``docs`` called ``lang_out`` or ``score_out`` are replaced, all
    others stay. Repeated rows stay each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # SPACE * languages numbers

    @F.pandas_udf("struct<lang string, score double>")
    def guess(texts):
        import pandas as pd

        m, out = shared.value, []
        for t in texts:
            if m is None or t is None:
                out.append((UNKNOWN, 0.0))
                continue
            p = m.probabilities(t)
            best = int(np.argmax(p))
            out.append((m.langs[best], float(p[best])))
        return pd.DataFrame(out, columns=["lang", "score"])

    text = F.col(text_col).cast("string")
    found = guess(F.when(text.rlike(r"\p{L}"), text))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (lang_out, score_out)]
    out = docs.select(F.struct(*kept).alias("row"), found.alias("found")) if kept else docs.select(found.alias("found"))
    return out.select(*["row.*"] * bool(kept), F.col("found.lang").alias(lang_out), F.col("found.score").alias(score_out))

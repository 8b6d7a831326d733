import corpus_pipeline as pipeline
import numpy as np
from brute import near, repeats

from lexiform.llm import langid
from lexiform.llm.packing import SIZES


def plain(docs):
    """(id, text) through the four filtering stages, one document at a time."""
    docs = [(i, t) for i, t in docs if t and any(map(str.isalpha, t))]
    best = {}
    for i, t in docs:
        best[t] = max(best.get(t, i), i)
    docs = [(i, t) for t, i in best.items()]
    group = near(docs)
    docs = sorted((i, t) for i, t in docs if group[i] == i)
    gone = {i: (n, k) for i, n, k, _ in repeats(docs)}
    first = {}
    for i, t in docs:
        w = t.encode().split()
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    out = []
    for i, t in docs:
        n, k = gone[i]
        if k == 0:
            out.append((i, t))
        elif k < n:
            w = t.encode().split()
            off = set()
            for s in range(len(w) - 19):
                if first[tuple(w[s : s + 20])] < (i, s):
                    off.update(range(s, s + 20))
            out.append((i, b" ".join(x for p, x in enumerate(w) if p not in off).decode()))
    return out


def test_pipeline(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = [(9001, "", "en", "s", 0), (9002, "12 34 !?", "en", "s", 8), (9003, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(plain(rows))
    step, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, step, str(tmp_path))
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        step = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(step.count())
    got = {r.doc_id: r for r in step.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    packed = pipeline.run(spark, str(tmp_path)).collect()
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    longest = max(SIZES)
    assert {i: sorted(p) for i, p in pieces.items()} == {i: [(s, min(longest, n - s)) for s in range(0, n, longest)] for i, t in want.items() for n in [len(t.encode().split()) + 1]}


def test_language_of_many_or_none(spark, monkeypatch):
    """A document is not rejected because there are many languages, or no labelled document."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12 34", None, "s", 5), (3, None, None, "s", 0)], schema)
    assert [r.doc_id for r in pipeline.language(spark, docs, "").collect()] == [1]
    k = 20
    bias = np.zeros(k)
    bias[7] = np.log(5)  # 5 of 24: far above one of 20, below 0.3
    model = langid.Model([f"l{i:02}" for i in range(k)], np.zeros((langid.SPACE, k), np.float32), bias, np.ones(langid.SPACE))
    monkeypatch.setattr(langid, "fit", lambda docs: model)
    assert [r.doc_id for r in pipeline.language(spark, docs, "").collect()] == [1]


def test_pipeline_odd_tables(spark, tmp_path):
    """Null ids and values, repeated rows, a missing and a further column with a clashing name; then an empty table."""
    rows = [(None, "a null id", 1), (None, "a null id", 1), (None, "another null id", 1), (1, "one text", 2), (1, "one text", 2), (2, "one text", 2), (3, None, 3), (4, "12", 4), (5, "w " * 9000, 5)]
    docs = spark.createDataFrame([(i, t, "en" if t else None, n, "k") for i, t, n in rows], "doc_id long, text string, lang string, n_chars long, key string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted(str(r.doc_id) for r in got if r.start == 0) == ["2", "5", "None", "None"]
    assert sorted(r.length for r in got if r.doc_id is None) == [4, 4]
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/b").collect() == []

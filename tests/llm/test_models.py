import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from test_dedup import frame, odd_rows

from lexiform.llm import langid, licenses, lm, pieces

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load(public.path("piece_bpe_32k.model"))


TEXTS = ["", " ", "a", "Hello  world\n\tfoo", "▁x ▁ \0\0▁ \0", "é🙂 ﬁ　ü " * 3, "   lead and trail   ", "x" * 500, "日本語テキスト", "á b\x00c", "the " * 50]


def test_pieces_equal_library(model, spark, small):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    texts = [t for t in TEXTS if pieces.MARK not in t and "\0" not in t] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for t in texts:
        assert model.encode(t) == lib.encode(t), t


def test_pieces_dropout(model):
    for t in TEXTS + ["Some words that repeat: words words words words words"]:
        seen = {tuple(model.encode(t, rate, seed)) for rate in (0.0, 0.1, 0.5, 1.0) for seed in range(4)}
        assert all(model.decode(ids) == t for ids in seen)
    many = {tuple(model.encode("internationalization of words", 0.3, s)) for s in range(50)}
    assert len(many) > 10
    fresh = pieces.Pieces.load(public.path("piece_bpe_32k.model"))
    assert all(fresh.encode(t, 0.3, 7) == model.encode(t, 0.3, 7) for t in TEXTS)
    assert [model.surface[i] for i in model.encode("ab cd", 1.0)] == [b" ", b"a", b"b", b" ", b"c", b"d"]
    with pytest.raises(ValueError):
        model.decode([1])


def test_pieces_dropout_of_each_occurrence(model, monkeypatch):
    """A word's segmentations grow with its occurrences, and each is that of its own key, worked out alone."""
    word, n = "internationalization", 2000
    seen: Counter = Counter()
    one: list[int] = []
    for i in model.encode(" ".join([word] * n), 0.1, 17):
        if one and model.surface[i][:1] == b" ":
            seen[tuple(one)] += 1
            one = []
        one.append(i)
    assert sum(seen.values()) == n - 1 and len(seen) > 100
    assert seen.most_common(1)[0][0] == tuple(model.encode(word))
    texts = TEXTS + ["the theatre thesis " * 300 + "日本 é🙂 " * 50 + "x" * 80]
    want = [model.encode(t, r, 5) for t in texts for r in (0.1, 0.5)]
    monkeypatch.setattr(pieces, "_skips", lambda unit, *_: np.ones(len(unit), bool))  # no occurrence takes the common result
    assert [model.encode(t, r, 5) for t in texts for r in (0.1, 0.5)] == want


def test_pieces_heap_equals_steps(model, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("theanionrsdé") for _ in range(rng.randrange(1, 40))) for _ in range(60)) for _ in range(20)]
    want = [model.encode(t, r, s) for t in texts for r in (0.0, 0.2) for s in (1, 2)]
    monkeypatch.setattr(pieces, "WIDE", 0)
    assert [model.encode(t, r, s) for t in texts for r in (0.0, 0.2) for s in (1, 2)] == want


def plain_dropout(model, text, rate, seed):
    """Merge-dropout by its definition: the best merge that isn't skipped, leftmost of equals, one after another in each unit."""
    mask, cut, out = (1 << 64) - 1, round(rate * 2**32), []
    key = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
    for place, unit in enumerate(re.findall(" *[^ ]+| +", " " + text) if text else []):
        base = (place * 0x9E3779B97F4A7C15 & mask ^ key) * 0xD6E8FEB86659FD93 & mask
        base = ((base ^ base >> 32) * 0xA0761D6478BD642F + seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & mask

        def skipped(at, i):
            h = (base + at * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F) & mask
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask
            h = (h ^ h >> 32) * 0x94D049BB133111EB & mask
            return h >> 32 < cut

        parts = [(at, {" ": pieces.MARK, pieces.MARK: pieces.LITERAL}.get(c, c)) for at, c in enumerate(unit)]
        while True:
            found = [(-model.merge[a + b][1], at, k) for k, ((at, a), (_, b)) in enumerate(zip(parts, parts[1:])) if a + b in model.merge and not skipped(at, model.merge[a + b][0])]
            if not found:
                break
            k = min(found)[2]
            parts[k : k + 2] = [(parts[k][0], parts[k][1] + parts[k + 1][1])]
        for _, p in parts:
            out += [model.merge[p][0]] if p in model.merge else [model.byte[b] for b in p.replace(pieces.LITERAL, pieces.MARK).encode()]
    return out


def test_pieces_dropout_against_a_plain_version(model, spark, small):
    rng = random.Random(3)
    unspaced = ["".join(rng.choice("日本語中文的一是ab1é▁🙂") for _ in range(400)), "QUJDRGVmZ2hpamtsbW5vcA" * 12, "aaaaaaaa" * 9, "abcdefghijklmnopqrstuvwxyz" * 4 + "語" + "the" * 20]
    texts = TEXTS + unspaced + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(25).collect() if len(r.text) <= 3000]
    for rate, seed in ((0.0, 0), (0.1, 17), (0.4, 3)):
        got, at = model.encode_many(texts, rate, seed)
        for k, t in enumerate(texts):
            assert got[at[k] : at[k + 1]].tolist() == plain_dropout(model, t, rate, seed), t


def test_pieces_unspaced_texts_become_short_parts(model, monkeypatch):
    """A long text without a space is no single heap: few of its characters are in parts longer than a step takes."""
    rng = random.Random(4)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(50_000))
    seen = []
    monkeypatch.setattr(pieces.Pieces, "_unit", lambda self, unit, *a, f=pieces.Pieces._unit: seen.append(len(unit)) or f(self, unit, *a))
    assert model.decode(model.encode(text, 0.1, 1)) == text
    assert max(seen, default=0) <= 64


def test_pieces_work_in_python_does_not_follow_units_or_ids(model):
    """Units are told apart, encoded and decoded as whole arrays: many times the text makes about the same number of Python calls."""

    def calls(work):
        seen = [0]
        sys.setprofile(lambda _, event, __: seen.__setitem__(0, seen[0] + (event in ("call", "c_call"))))
        try:
            got = work()
        finally:
            sys.setprofile(None)
        return got, seen[0]

    rng = random.Random(8)
    words = ["".join(rng.choice("theanionrsdé語🙂") for _ in range(rng.randrange(1, 14))) for _ in range(8000)]
    text = " ".join(words)
    model.encode(text, 0.1, 17)  # tables are made once
    (ids, stops), n_encode = calls(lambda: model.encode_many([text], 0.1, 17))
    back, n_decode = calls(lambda: model.decode(ids))
    assert back == text and stops.tolist() == [0, len(ids)]
    assert n_encode < len(words) / 2 and n_decode < len(words) / 2


def test_pieces_pairs_are_found_without_a_search():
    """Every pair and no other is found, also where few left ids have very many right ones; scores that tie go to the left."""
    rng = np.random.default_rng(2)
    for keys in (np.zeros(0, np.int64), np.arange(3) << 24 | 5, np.unique(rng.integers(0, 60, 20_000) << 24 | rng.integers(0, 30_000, 20_000))):
        found = pieces._Pairs(keys, np.arange(len(keys), dtype=np.int32))
        to, ok = found.find((keys >> 24).astype(np.int32), (keys & 0xFFFFFF).astype(np.int32))
        assert ok.all() and to.tolist() == list(range(len(keys)))
        left, right = rng.integers(-1, 70, 50_000).astype(np.int32), rng.integers(-1, 31_000, 50_000).astype(np.int32)
        known = set(keys.tolist())
        assert found.find(left, right)[1].tolist() == [a >= 0 and b >= 0 and a << 24 | b in known for a, b in zip(left.tolist(), right.tolist())]
    names = ["a", "b", "c", pieces.MARK, "ab", "bc", "ca", "aa", "abc", "bca", pieces.MARK + "a", "aab", "caa"]
    small = pieces.Pieces({p: (256 + i, -float(i // 4)) for i, p in enumerate(names)}, list(range(256)), [bytes([i]) for i in range(256)] + [p.replace(pieces.MARK, " ").encode() for p in names], frozenset())
    spell = random.Random(5)
    for _ in range(200):
        text = "".join(spell.choice("aabbcc é") for _ in range(40))
        for rate in (0.0, 0.3):
            ids = small.encode(text, rate, 1)
            assert ids == plain_dropout(small, text, rate, 1) and small.decode(ids) == text


def test_pieces_columns(model, spark):
    rows = odd_rows()
    got = pieces.decode_column(pieces.encode_column(frame(spark, rows), model, rate=0.2, seed=3), model, with_text=True).collect()
    assert sorted((r.doc_id, r.decoded) for r in got) == sorted((i, t or "") for i, t in rows)
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in got)
    assert pieces.decode_column(pieces.encode_column(frame(spark, []), model), model).collect() == []


def brute_lm(rows, order=3, block_of=lambda i, t: 0, modulus=10):
    """The smoothed model by its formulas, a word after another; continuations count once in each block of documents."""
    docs = [(i, t or "", zlib.crc32(str(i).encode() if i is not None else b"") % modulus != 0, (t or "").encode().lower().split() + [0]) for i, t in rows]
    c, follow = Counter(), set()
    for i, t, learn, w in docs:
        if learn:
            w = [1, *w]  # the start mark
            c[(1,)] += 1
            for at in range(1, len(w)):
                for k in range(1, order + 1):
                    if at - k + 1 >= (k == 1):
                        gram = tuple(w[at - k + 1 : at + 1])
                        c[gram] += 1
                        follow.add((block_of(i, t), gram))
    types = Counter(gram[:-1] for _, gram in follow)
    n, v = sum(k for g, k in c.items() if len(g) == 1 and g != (1,)), sum(len(g) == 1 for g in c if g != (1,))

    def p(w, h):
        if not h:
            return (c[(w,)] or v) / (n + v)
        if not c[h]:
            return p(w, h[1:])
        return (c[h + (w,)] + types[h] * p(w, h[1:])) / (c[h] + types[h])

    out = []
    for i, _, learn, w in docs:
        base = sum(math.log10((c[(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        full = [1, *w]
        score = sum(math.log10(p(full[at], tuple(full[max(0, at - order + 1) : at]))) for at in range(1, len(full))) if n else 0.0
        out.append((i, not learn, len(w), sum(c[(x,)] > 0 for x in w), n, base, score))
    return out


def check_lm(spark, rows, parts=3, order=3, block_of=lambda i, t: 0):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    got = sorted((tuple(r) for r in lm.lm_scores(frame(spark, rows).repartition(parts), order=order).collect()), key=key)
    want = sorted(brute_lm(rows, order, block_of), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_lm_odd(spark):
    check_lm(spark, odd_rows() + [(None, "a b"), (None, None)])
    check_lm(spark, [])
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    check_lm(spark, [(i, "never learnt") for i in held])


def test_lm_documents(spark, small, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_lm(spark, rows, order=2)
    scores = {}
    for order in (2, 3, 4):
        got = lm.lm_scores(docs, order=order).collect()
        held = [r for r in got if r.held_out]
        scores[order] = sum(r.score for r in held)
        assert scores[order] > sum(r.base_score for r in held)
    assert scores[3] > scores[2]
    monkeypatch.setattr(lm, "BLOCK", 7_000)  # many blocks and buckets
    monkeypatch.setattr(lm, "BUCKET", 30_000)
    blocks = -(-sum(len((t or "").split()) + 1 for _, t in rows) // 7_000)
    dealt = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit("")).cast("binary")), F.lit(blocks)).alias("b"))
    home = {r.doc_id: r.b for r in dealt.collect()}
    assert blocks > 5
    check_lm(spark, rows, block_of=lambda i, t: home[i])


def test_lm_continuations_are_distinct_in_all_blocks(spark, small, monkeypatch):
    """However many blocks and buckets the size of the input makes, T(h) counts a continuation once."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    odd = odd_rows() + [(None, "a b"), (None, None)] + [(1000 + i, "the same few words in many blocks the same") for i in range(40)]
    monkeypatch.setattr(lm, "BLOCK", 7_000)
    monkeypatch.setattr(lm, "BUCKET", 30_000)
    check_lm(spark, rows)
    monkeypatch.setattr(lm, "BLOCK", 60)  # most blocks hold a few texts
    monkeypatch.setattr(lm, "BUCKET", 500)
    for order in (2, 4):
        check_lm(spark, odd, order=order)
    check_lm(spark, [])


def test_lm_is_a_distribution():
    """The probabilities of all words and the unknown one add up to one after every history."""
    rng = random.Random(1)
    text = [f"w{rng.randrange(12)}" for _ in range(400)]
    asked = [*{*text}, "never"]
    histories = [[], ["w1"], ["w1", "w2"], ["w2", "never"], ["never"]]
    docs = [(0, True, " ".join(text))] + [(1 + k, False, " ".join([*h, w])) for k, (h, w) in enumerate((h, w) for h in histories for w in asked)]
    raw = [d[2].encode() for d in docs]
    body = lm.squeeze(np.array([d[0] for d in docs]), np.array([d[1] for d in docs], np.uint8), np.array([len(r) for r in raw]), np.frombuffer(b"".join(raw), np.uint8))
    x = lm.Block([body], 3)
    c, follow = x.counts()
    tokens, types = len(text) + 1, len({*text}) + 1
    steps = [None, *(x.history(k) for k in (1, 2))]
    arc, fail = lm.automaton(c, follow, x.gram, steps, tokens, types)
    each = lm.traverse(arc, fail, steps, c, x.first)
    ends = each[x.stops - 2][1:].reshape(len(histories), len(asked))  # the last word's weight, and the end's after the same history
    own = [i for i, h in enumerate(histories)]
    for i in own:
        h = histories[i]
        end = brute_end(text, h)
        assert (10 ** ends[i]).sum() + end == pytest.approx(1, abs=1e-9)


def brute_end(text, h):
    """The end mark's probability after history h, by the formulas."""
    full, c, follow = ["<s>", *text, "</s>"], Counter(), set()
    for at in range(1, len(full)):
        for k in range(1, 4):
            if at - k + 1 >= (k == 1):
                c[tuple(full[at - k + 1 : at + 1])] += 1
    c[("<s>",)] = 1
    follow = Counter(g[:-1] for g in c if len(g) > 1)
    n, v = len(text) + 1, len({*text}) + 1
    p = c[("</s>",)] / (n + v)
    for s in [("<s>", *h)[-k:] for k in range(1, 3) if k <= len(h) + 1]:
        if c[s]:
            p = (c[(*s, "</s>")] + follow[s] * p) / (c[s] + follow[s])
    return p


def test_langid(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from lexiform.llm.tables import remainder

    m = langid.fit(docs, learn=remainder("doc_id", 4) != 2)
    got = langid.predict(docs.withColumn("held", remainder("doc_id", 4) == 2), m).filter("held").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    assert (m.weights == 0).mean() > 0.5  # elastic net leaves most out
    right = [r.lang == r.lang_pred for r in got]
    assert abs(np.mean([r.score for r in got]) - np.mean(right)) < 0.1


def test_langid_odd(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 40 + [(None, "en"), ("", "de"), ("123 !?", "en"), ("the the", None), ("x" * 600_000, "en")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    m = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, m, score_out="conf").collect()}
    assert len(got) == len(rows) and got[0].score == 1
    assert [got[i].lang_pred for i in (0, 1, 80, 81, 82, 83)] == ["en", "de", "und", "und", "und", "en"]
    empty = docs.limit(0)
    assert langid.fit(empty) is None
    assert langid.predict(docs, None).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.predict(empty, m).collect() == []


def plain_score(m, text):
    """A text's logits by the definition: TF-IDF of its hashed 1- to 3-grams of characters, a dictionary and loops."""
    c = [ord(x) for x in text.lower()]
    n: Counter = Counter()
    for size in (1, 2, 3):
        for at in range(len(c) - size + 1):
            h = c[at] * 0x9E3779B1
            for k in range(1, size):
                h = h * 0x85EBCA6B + c[at + k] * 0xC2B2AE35 + k
            h &= 0xFFFFFFFF
            h ^= h >> 15
            n[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - langid.BITS)] += 1
    x = {f: (1 + math.log(k)) * m.idf[f] for f, k in n.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
    z = [(sum(v / norm * float(m.weights[f, j]) for f, v in x.items()) + float(m.bias[j])) / m.temperature for j in range(len(m.langs))]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_langid_against_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    m = langid.fit(docs)
    for r in langid.predict(docs.limit(60), m).collect():
        p = plain_score(m, r.text)
        assert r.lang_pred == m.langs[p.index(max(p))] and r.score == pytest.approx(max(p), abs=1e-5)


def test_langid_rare_languages_and_clashing_columns(spark):
    """Each language is in the sample, whatever its share and however often rows or ids repeat; a caller's columns stay."""
    rows = [(None, "the cat and the dog", "en")] * 3000 + [(7, "der Hund und die Katze", "de")] * 900 + [(i, f"le chat et le chien {i}", "fr") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    m = langid.fit(docs, fit_rows=300)
    assert m.langs == ["de", "en", "fr"]
    asked = spark.createDataFrame([("the cat", "mine", 1, "x", 2), ("der Hund", "mine", 1, "x", 2), ("le chat et le chien 9", "mine", 1, "x", 2)], "text string, lang_pred string, _guess int, found string, row int")
    got = langid.predict(asked, m).collect()
    assert [r.lang_pred for r in got] == ["en", "de", "fr"]
    assert all((r._guess, r.found, r.row) == (1, "x", 2) for r in got)
    assert langid.predict(asked, m).columns == ["text", "_guess", "found", "row", "lang_pred", "score"]


def test_counts_long_text_in_spans(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcé ") for _ in range(5000))
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "SPAN", 700)
    parts = langid.counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert whole[1].sum() == 5000 * 3 - 3


def plain_align(a, b):
    """Recursive patience alignment, straight from its definition."""
    ca, cb = Counter(a), Counter(b)
    pairs = [(i, b.index(x)) for i, x in enumerate(a) if ca[x] == 1 and cb[x] == 1]
    best = [[]]
    for k, p in enumerate(pairs):
        before = [c for c in best[1:] if c[-1][1] < p[1]] or [[]]
        best.append(max(before, key=len) + [p])
    return max(best, key=len)


def test_align():
    rng = random.Random(5)
    for _ in range(300):
        b = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 14))]
        a = list(b)
        for _ in range(rng.randrange(0, 5)):
            a.insert(rng.randrange(len(a) + 1), rng.choice("abcxyz"))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) >= len(plain_align(a, b))
        if a == b and any(c == 1 for c in Counter(a).values()):
            assert len(got) == len(a)
    for _ in range(300):
        pairs = list(enumerate(rng.sample(range(30), rng.randrange(0, 12))))
        best = max((len(c) for c in _chains(pairs)), default=0)
        assert len(licenses._increasing(pairs)) == best


def _chains(pairs):
    out = []
    for p in pairs:
        out.append(max((c for c in out if c[-1][1] < p[1]), key=len, default=[]) + [p])
    return out


def test_licenses(spark):
    filler = "the of under this work version and in to a " * 300
    rows = odd_rows() + [
        (50, filler + "Licensed under the Apache License, Version 2.0.\n" + filler),
        (51, "x This work is licensed under the GNU General Public License, version 3. y"),
        (52, "Released under the MIT License."),
        (53, "Licensed under CC BY-NC 4.0."),
        (54, filler),
        (55, "this work, long ago, was licensed " + "q " * 50 + " under the GNU"),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert {i: r.license for i, r in got.items() if r.license} == {50: "Apache-2.0", 51: "GPL-3.0", 52: "MIT", 53: "CC-BY-NC-4.0"}
    assert (got[51].first_word, got[51].end_word, got[51].coverage) == (1, 13, 1.0)
    assert licenses.license_scan(frame(spark, [])).collect() == []


def test_licenses_documents(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.license for r in licenses.license_scan(docs).collect()}
    for r in docs.collect():
        plain = " ".join(r.text.lower().split())
        for name in ("Apache-2.0", "GPL-3.0", "MIT", "CC-BY-NC-4.0"):
            if licenses.TEMPLATES[name].lower() in plain:
                assert got[r.doc_id], r.doc_id
        if "licen" not in plain:
            assert got[r.doc_id] is None


def test_licenses_repeated(spark):
    """A notice whose words are not unique in the text is found all the same."""
    notice = "This work is licensed under the GNU General Public License, version 3."
    words = notice.split()
    rows = [
        (60, notice + "\n" + "prose " * 100 + "\n" + notice),
        (61, notice + "\n" + notice),
        (62, " prose ".join(reversed(words)) + " prose " * 40 + notice + " prose " * 40 + " prose ".join(reversed(words))),
        (63, "the MIT group released under the sun a License. " * 40 + "Released under the MIT License. " + "the License of MIT. " * 40),
        (64, " prose ".join(words[::-1] * 50)),
        (65, words[0] + " prose" * 30 + " " + " ".join(words[1:7]) + " prose" * 30 + " " + " ".join(words[7:])),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert {i: r.license for i, r in got.items()} == {60: "GPL-3.0", 61: "GPL-3.0", 62: "GPL-3.0", 63: "MIT", 64: None, 65: None}
    assert [(got[i].first_word, got[i].end_word, got[i].coverage) for i in (60, 61)] == [(0, 12, 1.0)] * 2
    assert (got[62].end_word - got[62].first_word, got[62].coverage) == (12, 1.0)


def test_license_windows():
    """The best of all windows, against every window by the plain recurrence."""

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(8)
    hits = 0
    for _ in range(400):
        template = [rng.choice("abcdef") for _ in range(rng.randrange(1, 9))]
        text = [rng.choice("abcdefxyz") for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            text[5:5] = template * rng.randrange(1, 3)
        at = [i for i, w in enumerate(text) if w in template]
        got = licenses._window([text[i] for i in at], at, template)
        span = int(licenses.SPREAD * len(template))
        want = max((plain(text[i : i + span], template) for i in range(len(text))), default=0)
        assert len(got) == (want if want >= licenses.COVERAGE * len(template) else 0)
        assert all(text[at[i]] == template[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        hits += bool(got)
    assert hits > 100


def test_license_near_misses(spark):
    """Another name or version than a template's is never that template."""
    rows = [
        (70, "Released under the BSD License.", "BSD"),
        (71, "Licensed under CC BY 4.0", "CC-BY-4.0"),
        (72, "Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
        (73, "This work is licensed under the GNU General Public License, version 2, see section 3.", "GPL-2.0"),
        (74, "This work is licensed under the GNU General Public License, version 7.", None),
        (75, "Released under the Foo License", None),
        (76, "Licensed under CC BY-NC 9.0", None),
        (77, "Released under the MIT No Attribution License", "MIT-0"),
        (78, "Licensed under the Apache License, Version 1.1", "Apache-1.1"),
        (79, "This work is licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
        (80, "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General\n# Public License as published by\n# the Free Software Foundation, either version 2 of the License, or\n# (at your option) any later version.", "GPL-2.0-or-later-header"),
        (81, "// SPDX-License-Identifier: MPL-2.0\nint main() {}", "MPL-2.0-spdx"),
    ]
    got = {r.doc_id: r.license for r in licenses.license_scan(frame(spark, [r[:2] for r in rows])).collect()}
    assert got == {i: want for i, _, want in rows}


def test_license_texts(spark):
    """Every template is found as its license, alone and twice with prose before."""
    from lexiform.llm.notices import notices

    every, kind = notices(), re.compile("-(name|spdx|header|text|full|only|or-later)\\b.*|\\+-spdx$")
    names = sorted(every)
    filler = "some prose of the version and this license " * 30
    rows = [(2 * i + k, f"{filler if k else ''}{every[n][0]}\n{every[n][0] if k else ''}") for i, n in enumerate(names) for k in (0, 1)]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    for i, n in enumerate(names):
        for k in (0, 1):
            r = got[2 * i + k]
            assert kind.sub("", r.license or "") == kind.sub("", n), (n, k)
            assert r.n_aligned == len([t for t in licenses.tokens(every[n][0]) if t]) or r.license != n

import hashlib
import random

import pytest
from brute import near, repeats, shingles
from pyspark.sql import functions as F

from lexiform.llm.exact import exact_dedup, heavy_digests, digest_rows
from lexiform.llm.minhash import near_dups
from lexiform.llm.substring import remove_repeats

SCHEMA = "doc_id long, text string, id string, digest int, u int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "k") for i, t in rows], SCHEMA)


def odd_rows():
    long = " ".join(f"w{i % 977}q{i}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "A"), (6, "a b c d e"), (7, "A b c d e"), (7, "A b c d e"), (8, long), (9, long), (10, long + " tail"), (11, "x y z\x1f q"), (12, None), (13, "é" * 200), (14, "é" * 200)]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def family_rows(seed):
    rng, rows, i = random.Random(seed), [], 0
    shared = words(rng, 70)
    for _ in range(12):
        base = words(rng, rng.choice([3, 5, 8, 30, 120, 300]))
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w[at:at] = shared[rng.randrange(30) :]
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


def check_exact(spark, rows):
    got = exact_dedup(frame(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((x for x in ids if x is not None), default=None)
    for sha, ids in by_sha.items():
        own = [r for r in got if r.text_sha256 == sha]
        assert sorted(map(repr, (r.doc_id for r in own))) == sorted(map(repr, ids))
        assert [r.doc_id for r in own if r.kept] == [own[0].keep_id]


def test_exact(spark):
    check_exact(spark, odd_rows())
    check_exact(spark, [(i, "same" if i % 3 else f"t{i // 2}") for i in range(600)])
    check_exact(spark, [(None, "a"), (None, "a"), (3, "a"), (None, "b")])
    check_exact(spark, [(5, "hot")] * 50 + [(6, "cold")])
    assert exact_dedup(frame(spark, [])).collect() == []


def test_exact_repeated_rows_of_a_heavy_digest(spark):
    """Copies of a frequent text under one id: one stays, and none goes through the shuffle."""
    got = exact_dedup(frame(spark, [(5, "hot")] * 400 + [(4, "hot")] * 30 + [(6, "cold")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.kept) == [(5, 5, 430, True), (6, 6, 1, True)]
    assert len(got) == 431


def test_exact_heavy_are_verified(spark):
    rows = digest_rows(frame(spark, [(i, "hot" if i < 300 else f"t{i}") for i in range(900)]), "doc_id", "text", None)
    heavy = heavy_digests(rows, share=64).collect()
    assert [(r.top.id, r.group_size) for r in heavy] == [(299, 300)]


def test_exact_normalised(spark):
    got = exact_dedup(frame(spark, [(1, "A b"), (2, "a b")]), normalise=F.lower).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(1, 2, False), (2, 2, True)}


def check_near(spark, rows):
    got = near_dups(frame(spark, rows)).collect()
    want = near(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, len(shingles(t))) for i, t in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, seed):
    check_near(spark, family_rows(seed))


def test_near_recall():
    """Buckets that linked sets share: exact for small sets, and far above 0.999 at the least similarity for all others."""
    import numpy as np

    from lexiform.llm.minhash import bucket_keys

    rng = np.random.default_rng(5)
    missed = tried = 0
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, 75, 150, 300):
        for m in range(n, n * 4 // 3 + 1):
            both = -(-75 * (n + m) // 175)  # the fewest shared shingles of linked sets
            if both > n:
                continue
            for _ in range(60 if m <= 9 else 1200 // (m - n + 1) // (1 + n // 20)):
                h = np.unique(rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                a, b = np.sort(h[rng.permutation(len(h))]), None
                pick = rng.permutation(len(h))
                a, b = np.sort(h[pick[:n]]), np.sort(np.r_[h[pick[:both]], h[pick[n:]]])
                found = len(np.intersect1d(bucket_keys(a, 75), bucket_keys(b, 75))) > 0
                if n <= 6 and m <= 9:
                    assert found
                tried += 1
                missed += not found
    assert tried > 5000 and missed <= 2


def test_near_rim(spark):
    """A large family of one text, each with its own changes: members that its centre doesn't link meet in later rounds."""
    rng = random.Random(11)
    base = words(rng, 200, 10**6)
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    check_near(spark, rows)


def test_near_shared_ids(spark):
    """Rows of one id are one document with the links of all its texts."""
    rng = random.Random(12)
    texts = [" ".join(words(rng, 60, 10**6)) for _ in range(6)]
    check_near(spark, [(7, texts[0]), (7, texts[1]), (3, texts[0] + " x"), (9, texts[1] + " y"), (4, texts[2]), (4, texts[2]), (2, texts[3])])


def test_near_chain(spark):
    """Each text differs from the next by one word in a sliding window, so links form a path."""
    base = [f"c{i}" for i in range(140)]
    check_near(spark, [(100 - k, " ".join(base[k * 4 : k * 4 + 50])) for k in range(20)])


def test_near_odd(spark):
    check_near(spark, odd_rows())
    assert near_dups(frame(spark, [])).collect() == []
    got = near_dups(frame(spark, [(None, "a b"), (None, "a b"), (2, "a b")])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("2", 2, True), ("None", None, True), ("None", None, True)]


def test_near_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = near(rows)
    assert {r.doc_id: r.component_id for r in near_dups(docs).collect()} == want


def check_repeats(spark, rows, **more):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(frame(spark, rows).repartition(5), **more).collect()]
    assert sorted(got, key=repr) == sorted(repeats(rows), key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats(spark, seed):
    check_repeats(spark, family_rows(seed))


@pytest.mark.parametrize("bits", [1, 6])
def test_repeats_unequal_words_of_one_fingerprint(spark, monkeypatch, bits):
    """Fingerprints of a few bits collide all the time: the words decide, in blocks and between them."""
    from lexiform.llm import substring

    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    check_repeats(spark, family_rows(6), bits=bits)


def test_repeats_shared_and_null_ids(spark, monkeypatch):
    from lexiform.llm import substring

    w, x = " ".join(f"w{i}" for i in range(30)), " ".join(f"x{i}" for i in range(60))
    rows = [(1, w), (2, w), (2, x), (2, x), (2, x + " y"), (None, "z " + w), (None, "z " + w), (None, x[:100]), (None, None)]
    check_repeats(spark, rows)
    monkeypatch.setattr(substring, "BLOCK_BYTES", 100)
    check_repeats(spark, rows)


def test_repeats_odd(spark):
    check_repeats(spark, [r for r in odd_rows()])
    check_repeats(spark, [(1, "a " * 50), (2, "a " * 19), (3, "a " * 20), (4, "b a " * 40), (5, "a b " * 40)])
    assert remove_repeats(frame(spark, [])).collect() == []


def test_repeats_between_blocks(spark, monkeypatch):
    """Every document in a block of its own: all repeats meet by their anchors, parts of a bucket at a time."""
    from lexiform.llm import substring

    rng = random.Random(9)
    text = words(rng, 3000, 5000)
    rows = [(1, " ".join(text)), (2, " ".join(text[1000:1500] + words(rng, 10) + text[1500:1519])), (3, "a  b\t" * 30), (4, "a b\n" * 40)]
    monkeypatch.setattr(substring, "BLOCK_BYTES", 64)
    check_repeats(spark, rows)


def test_repeats_sql(spark):
    """The query's SQL gives the same, also where ids repeat or are null."""
    import duckdb

    from lexiform.llm.queries import OP5_SQL

    rows = family_rows(8) + [(2, "x " * 30), (2, "x " * 30), (None, "x " * 25), (None, None), (None, "")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(OP5_SQL).fetchall(), key=repr) == sorted(repeats(rows), key=repr)


def test_repeats_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = remove_repeats(docs, with_text=True, carry=["lang", "n_chars"]).collect()
    assert {(r.doc_id, r.lang, r.n_chars) for r in got} == {(r.doc_id, r.lang, r.n_chars) for r in docs.collect()}
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(repeats(rows))
    text = dict(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 if r.n_removed else r.kept_text == text[r.doc_id] for r in got)

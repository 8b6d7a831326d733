import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexiform.errors import LexiformError, SessionStateMismatch, StoreCorrupt, StoreFormatUnsupported
from lexiform.operators import lookup
from lexiform.operators.tokens import Tokenizer
from lexiform.sources import records
from lexiform.sources.artifact import byte_artifact
from lexiform.sources.records import Record

KEY = hashlib.sha256(b"key").digest()


def test_record_round_trip_and_every_flipped_bit():
    r = Record(KEY, 0, (1, 2, 70000), "é z")
    data = records.encode(r)
    back = records.decode(data, KEY)
    assert len(data) == 200 + 12 + 4 and back.ids == r.ids and back.tail == r.tail and back.link == records.link_of(data)
    for bit in range(8 * len(data)):
        bad = bytearray(data)
        bad[bit // 8] ^= 1 << bit % 8
        with pytest.raises(LexiformError):
            records.decode(bytes(bad), KEY)
    for n in (0, 199, len(data) - 1):
        with pytest.raises(StoreCorrupt):
            records.decode(data[:n])
    with pytest.raises(StoreCorrupt):
        records.decode(data + b"\0")
    with pytest.raises(SessionStateMismatch):
        records.decode(data, bytes(32))
    with pytest.raises(StoreCorrupt):
        records.decode(records.encode(r, tag=b"another"))
    with pytest.raises(StoreFormatUnsupported):
        records.decode(records.encode(Record(KEY, 0, (), "", witness=9)))
    with pytest.raises(StoreCorrupt):
        records.decode(records.encode(Record(KEY, 0, (1,), "", stable=3)))
    nxt = Record(KEY, 1, (1,), "x", previous=back.link)
    assert records.decode(records.encode(nxt), KEY, back).revision == 1
    with pytest.raises(StoreCorrupt):
        records.decode(records.encode(Record(KEY, 2, (1,), "x", previous=back.link)), KEY, back)


def test_chains_in_tables(spark, tmp_path):
    rows = [(s, v, "ab"[: v + 1] * s, [s, v]) for s in (1, 2, 3) for v in range(3)]
    written = records.write(spark.createDataFrame(rows, "session long, revision long, text string, ids array<int>"), KEY)
    records.save(written, str(tmp_path / "store"))
    table = records.load(spark, str(tmp_path / "store"))
    good = records.chain(table, KEY).collect()
    assert all(r.ok for r in good) and {(r.session, r.revision, r.text) for r in good} == {r[:3] for r in rows}
    broken = table.filter("not (session = 2 and revision = 1)").withColumn("record", F.when((F.col("session") == 3) & (F.col("revision") == 1), F.concat("record", F.lit(b"x"))).otherwise(F.col("record")))
    got = {(r.session, r.revision): (r.ok, r.failure) for r in records.chain(broken, KEY).collect()}
    assert got == {(1, 0): (True, None), (1, 1): (True, None), (1, 2): (True, None), (2, 0): (True, None), (2, 2): (False, "chain"), (3, 0): (True, None), (3, 1): (False, "size"), (3, 2): (False, "chain")}
    assert {r.code for r in records.chain(table, bytes(32)).collect()} == {"SESSION_STATE_MISMATCH"}
    null = spark.createDataFrame([(1, 0, None)], "session long, revision long, record binary")
    assert [r.ok for r in records.chain(null).collect()] == [False]


def test_chain_lookup(spark):
    texts = ["abcdefgh", "abcdXfgh", "abcdefg", "", None, "abcdefghijkl"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    nodes = lookup.chain(df.filter("i = 0"), "i", "t", 4)
    assert {r.i: r.n_blocks for r in lookup.chain_prefix(df, nodes, "i", "t", 4).collect()} == {0: 2, 1: 1, 2: 1, 3: 0, 4: 0, 5: 2}
    gone = nodes.filter("block > 0")  # an evicted first node ends every match
    assert {r.n_blocks for r in lookup.chain_prefix(df, gone, "i", "t", 4).collect()} == {0}


def test_entries_are_kept_and_served(spark):
    rng = random.Random(8)
    tok = Tokenizer(spark, byte_artifact())
    base = ["the cat sat", "the cat", "the cat sat on", "x" * 20]
    store = lookup.entries(tok, spark.createDataFrame(list(enumerate(base)), "n long, t string"), "n", "t")
    queries = ["the cat sat", "the cat sat on a mat", "the cats", "dog", "", None] + ["the cat" + "".join(rng.choice("ab ") for _ in range(9)) for _ in range(20)]
    q = spark.createDataFrame(list(enumerate(queries)), "q long, body string")
    for r in lookup.serve(tok, q, store, "q", "body").collect():
        t = queries[r.q]
        best = max((x for x in base if t and t.startswith(x)), key=len, default=None)
        assert r.path == ("miss" if best is None else "exact" if best == t else "extension")
        assert r.ids == (None if best is None else list(t.encode()))
    auto = store.select("name", F.lit("auto").alias("kind"), F.col("name").alias("used"), "byte_length", "end_digest", "marks", "text", "ids")
    kept = lambda **k: {r.name for r in lookup.keep(auto, **k).collect()}
    assert kept(least=8) == {0, 2, 3} and kept(least=0, most=2) == {3, 2} and kept(least=0, budget=34) == {3, 2} and kept() == set()
    assert lookup.keep(store).count() == 4


def test_many_entries_that_begin_alike(spark):
    head = "h" * 64
    e = spark.range(3000).select("id", F.concat(F.lit(head), F.lpad((F.col("id") % 100).cast("string"), 3, "0")).alias("t"))
    q = spark.createDataFrame([(0, head + "042 more"), (1, head), (2, head + "999")], "q long, body string")
    got = lookup.longest_prefix(q, e, "q", "body", "id", "t").collect()
    assert [(r.q, r.id, r.matched_bytes) for r in got] == [(0, 42, 67)]

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexiform import api, config
from lexiform.errors import SessionStateMismatch, UnsupportedConfig
from lexiform.functions import schemes
from lexiform.operators import lookup, store
from lexiform.operators.tokens import Engine, Tokenizer, byte_spans, checkpoints, offsets
from lexiform.plans import routing
from lexiform.sources import records
from lexiform.sources.artifact import Added, byte_artifact


def texts(seed, n=40):
    rng = random.Random(seed)
    past = "".join(rng.choice("aé中🙂 b.") for _ in range(300))
    return [(i, past[: rng.randrange(300)] + "".join(rng.choice("xyz é") for _ in range(rng.randrange(60)))) for i in range(n)] + [(n, ""), (n + 1, None), (n + 2, past)]


def test_nodes_are_shared_and_put_together_again(spark):
    rows = texts(1)
    nodes, heads = store.export(spark.createDataFrame(rows, "s long, t string"), "s", "t", 16)
    assert {r.session: r.text for r in store.restore(nodes, heads).collect()} == {i: t or "" for i, t in rows}
    held = nodes.collect()
    assert len(held) == len({(t or "")[: 16 * k] for _, t in rows for k in range(1, len(t or "") // 16 + 1)})
    assert store.checked(nodes).agg(F.min("ok")).first()[0]


def test_a_lost_or_damaged_node_ends_a_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(100))
    nodes, heads = store.export(spark.createDataFrame([("a", text), ("b", "short")], "s string, t string"), "s", "t", 16)
    for bad in (nodes.filter("block <> 3"), nodes.withColumn("body", F.when(F.col("block") == 3, F.lit("x" * 16)).otherwise(F.col("body")))):
        got = {r.session: (r.text, r.n_blocks, r.whole) for r in store.restore(bad, heads).collect()}
        assert got == {"a": (text[:48], 3, False), "b": ("short", 0, True)}


def test_prefix_digests(spark):
    rows = [("",), ("é" * 3000,), ("a" * 20_000,), (None,)]
    got = spark.createDataFrame(rows, "t string").select("t", store.prefix_digest(F.col("t")).alias("d")).collect()
    for r in got:
        if r.t is None:
            assert r.d is None
            continue
        data = r.t.encode()
        stops = [4096 << k for k in range(10) if 4096 << k < len(data)] + [len(data)]
        assert [(d.pos, d.digest) for d in r.d] == [(n, hashlib.blake2b(data[:n], digest_size=16, person=store.PERSON).hexdigest()) for n in stops]


def test_index_is_bound_to_records(spark):
    tok = Tokenizer(spark, byte_artifact())
    key = bytes.fromhex(byte_artifact().fingerprint())
    states = spark.createDataFrame([(i, 0, f"text {i}") for i in range(6)], "session long, revision long, text string").withColumn("ids", tok.encode(F.col("text")))
    held = records.write(states, key)
    side = store.bind(held).filter("session <> 1").withColumn("bound", F.when(F.col("session") == 2, F.lit("no")).otherwise(F.col("bound")))
    bad = held.withColumn("record", F.when(F.col("session") == 4, F.substring("record", 1, 150)).otherwise(F.col("record")))
    got = {r.session: (r.rebuilt, r.end_digest) for r in store.index(bad, side).collect()}
    assert got == {i: (i in (1, 2), hashlib.sha256(f"text {i}".encode()).hexdigest()) for i in (0, 1, 2, 3, 5)}


def test_shape_and_witness(spark):
    states = spark.createDataFrame([("a", 0, "ab", [1, 2]), ("a", 1, "abc", [1, 3, 4]), ("a", 2, "x", [1, 3]), ("b", 0, "", [])], "session string, revision long, text string, ids array<int>")
    got = {(r.session, r.revision): (r.replace_from, r.kept) for r in records.appended(states).collect()}
    assert got == {("a", 0): (0, True), ("a", 1): (1, True), ("a", 2): (2, False), ("b", 0): (0, True)}
    data = records.encode(records.Record(b"k" * 32, 0, (1,), "a", witness=1))
    assert records.decode(data, engine=1).ids == (1,)
    with pytest.raises(SessionStateMismatch):
        records.decode(data, engine=2)


@pytest.mark.parametrize("bits", [4, 256])
def test_bytes_decide_a_lookup(spark, bits):
    """With digests of four bits nearly every candidate is a wrong one."""
    rng = random.Random(2)
    past = "".join(rng.choice("ab") for _ in range(60))
    entries = [(i, past[: rng.randrange(1, 60)] + rng.choice(["", "", "c"])) for i in range(60)]
    asked = [(i, past[: rng.randrange(0, 60)] + rng.choice(["", "zz"])) for i in range(60)] + [(60, ""), (61, None)]
    q, e = spark.createDataFrame(asked, "q long, t string"), spark.createDataFrame(entries, "e long, x string")
    got = {r.q: (r.e, r.matched_bytes) for r in lookup.longest_prefix(q, e, "q", "t", "e", "x", bits).collect()}
    want = {}
    for i, t in asked:
        fits = [(-len(x), k) for k, x in entries if t and t.startswith(x)]
        if fits:
            want[i] = (min(fits)[1], -min(fits)[0])
    assert got == want


def test_routes_give_the_same_ids(spark):
    a = byte_artifact(added=[Added(300, "<t>")])
    tok = Tokenizer(spark, a)
    rows = [(0, "short"), (1, "with <t> inside"), (2, "long words. " * 50), (3, "x" * 700), (4, ""), (5, "<t>" * 200)]
    df = spark.createDataFrame(rows, "i long, t string")
    done = routing.execute(routing.plan(threshold=64), tok, df, "i", "t")
    got = {r.i: (r.path, list(r.ids)) for r in done.collect()}
    e = Engine(a)
    assert got == {i: (p, e.encode(t)) for (i, t), p in zip(rows, ["fast", "reference", "split", "split", "fast", "reference"])}
    assert {(r.path, r.n_rows) for r in routing.counters(done).collect()} == {("fast", 2), ("reference", 2), ("split", 2)}
    only = routing.execute(routing.plan("reference"), tok, df, "i", "t").collect()
    assert {r.i: list(r.ids) for r in only} == {i: ids for i, (_, ids) in got.items()} and {r.path for r in only} == {"reference"}


def test_spans_from_checkpoints(spark):
    a = byte_artifact()
    a.vocab |= {256: "é中".encode()[1:4], 257: b"ab"}
    a.__post_init__()
    tok = Tokenizer(spark, a)
    e, rows = Engine(a), []
    rng = random.Random(3)
    for i in range(30):
        t = "".join(rng.choice(["ab", "é", "🙂", "中", "é中"]) for _ in range(rng.randrange(0, 40)))
        ids, data, at = [], t.encode(), 0
        while at < len(data):
            one = next((k for k in (256, 257) if data.startswith(a.vocab[k], at) and rng.random() < 0.7), data[at])
            ids.append(one)
            at += len(a.vocab[one])
        rows.append((i, t, ids))
    df = spark.createDataFrame(rows, "i long, t string, ids array<int>")
    for first, last in ((0, 5), (7, 19), (12, 12), (35, 90)):
        s = df.select("i", "t", "ids", checkpoints(tok.spans(F.col("t"), F.col("ids")), 6).alias("m"))
        got = {r.i: (r.w.starts, r.w.ends) for r in s.select("i", tok.window(F.col("t"), F.col("ids"), F.col("m"), first, last).alias("w")).collect()}
        for i, t, ids in rows:
            starts, ends = e.spans(t, ids)
            assert got[i] == (starts[first:last].tolist(), ends[first:last].tolist())


def test_byte_spans(spark):
    rows = [("a é 中🙂",), ("",), (None,), ("don't  x",)]
    got = spark.createDataFrame(rows, "t string").select("t", byte_spans(schemes.pieces(F.col("t"), "gpt2")).alias("s")).collect()
    for r in got:
        if r.t is not None:
            each = [r.t.encode()[a:b].decode() for a, b in zip(r.s.starts, r.s.ends)]
            assert each == schemes.split(r.t, "gpt2")


def test_offsets_in_two_levels(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(50)) for i in rng.sample(range(10**6), 300)]
    got = offsets(spark.createDataFrame(rows, "g string, k long, n long"), "g", "k", "n", 7).collect()
    want, sums = {}, {}
    for g, k, n in sorted(rows, key=lambda r: r[1]):
        want[k] = sums.get(g, 0)
        sums[g] = want[k] + n
    assert {r.k: r.offset for r in got} == want


def test_encode_with_lookup(spark):
    one = api.Lexiform(spark, byte_artifact(), config.Config())
    held = lookup.entries(one.columns, spark.createDataFrame([("a", "hello "), ("b", "hello wor")], "n string, t string"), "n", "t")
    assert bytes(one.encode("hello world", lookup=held).ids) == b"hello world"
    assert one.encode("nothing", lookup=held) is None and not one.sessions
    assert (one.counts["lookup_hit"], one.counts["lookup_miss"], one.counts["encode"]) == (1, 1, 0)
    with pytest.raises(UnsupportedConfig):
        one.encode("x", lookup=held, session="s")

import random

import pytest
from pyspark.sql import functions as F

from lexiform.errors import SessionStateMismatch
from lexiform.functions import schemes
from lexiform.operators import sessions
from lexiform.operators.sessions import Session, Tail
from lexiform.operators.tokens import Engine, Tokenizer
from lexiform.sources.artifact import Added, byte_artifact

PARTS = ["a", "B ", " c", "the cat", " 1234 x", "é", "中", " 中", "🙂", "̈", " ̈a", " ", "  ", "\n", "\r\n", "\r", "'s", " 'LL", "!", "/ x", "_", "<t>", "<t", "> y", "，", "。中文", "привет", " мир", ", ", ".", "?", "(x)", "=y", "・", "カ", "’s", "ǅ", "ʰ", "٣", "한", "e\u0301", ";\n"]


def words(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


@pytest.mark.parametrize("scheme", list(schemes.SCHEMES))
def test_a_cut_changes_no_piece(scheme):
    rng, seen = random.Random(3), 0
    for _ in range(400):
        t = words(rng, 30)
        at = schemes.last_cut(t, 8)
        seen += at > 0
        assert schemes.split(t[:at], scheme) + schemes.split(t[at:], scheme) == schemes.split(t, scheme)
    assert seen > 300


def test_sessions_of_every_script_seal():
    """What an append encodes again stays short where words are never ASCII, or stand without spaces."""
    e = Engine(byte_artifact())
    for more in ("今天天气很好，我们去公园。", " привет мир снова", "x=f(y);\nif(a){b}\n", "오늘은 날씨가 좋다. "):
        tail = Tail(e)
        for _ in range(200):
            tail.append(more)
            assert len(tail.text) < 64
        assert tail.count == 200 * len(more.encode())


@pytest.mark.parametrize("added", [[], [Added(300, "<t>", lstrip=True)], [Added(300, "<t>", rstrip=True)], [Added(300, "the "), Added(301, "x")], [Added(300, "cat", single_word=True)], [Added(300, "cat", rstrip=True)], [Added(300, ".", single_word=True)], [Added(300, "中，")], [Added(300, "(x)", lstrip=True), Added(301, " мир", single_word=True)], [Added(300, "?", rstrip=True)]])
def test_tail_equals_a_full_encode(added):
    rng = random.Random(4)
    for prefix_space in (False, True):
        a = byte_artifact(added=added)
        a.prefix_space, a.nfc = prefix_space, True
        e = Engine(a)
        for _ in range(30):
            tail, ids, body = Tail(e), [], ""
            for _ in range(20):
                d = words(rng, rng.randrange(0, 6))
                body += d
                _, at, new, n, path = tail.append(d)
                ids = ids if path == "noop" else ids[:at] + new
                assert ids == e.encode(body) and n == len(ids)
                tail = Tail(e, tail.text, tail.sealed, tail.revision)  # the state alone is enough


def test_cost_follows_the_delta():
    e = Engine(byte_artifact())
    tail = Tail(e)
    for _ in range(2000):
        tail.append(" some more words")
        assert len(tail.text) < 64
    assert tail.count == 2000 * 16


def test_claims_snapshots_and_caps(monkeypatch):
    s = Session(Engine(byte_artifact()), "abc", 0)
    with pytest.raises(SessionStateMismatch):
        s.transcript("abd", prefix="ab")
    assert s.transcript("abcd", prefix="abc")[4] == "append"
    assert s.snapshot() == {"text": "abcd", "ids": list(b"abcd"), "revision": 1, "token_count": 4}
    monkeypatch.setattr(sessions, "HARD_CAP", 3)
    assert s.append("e")[4] == "degraded_full_reencode" and s.ids == list(b"abcde")


def test_transcripts_and_fold(spark):
    tok = Tokenizer(spark, byte_artifact())
    rows = [(1, 0, "ab"), (1, 1, "abc d"), (1, 2, "abc d"), (1, 3, "x"), (2, 0, ""), (2, 1, None), (2, 2, "é z")]
    p = sessions.transcripts(tok, spark.createDataFrame(rows, "s long, t long, body string"), "s", "t", "body")
    got = {(r.session, r.path) for r in p.collect()}
    assert {(1, "append"), (1, "hit"), (1, "overwrite"), (2, "seed")} <= got
    ids = {r.session: list(r.ids) for r in sessions.fold(p).collect()}
    assert ids == {1: list(b"x"), 2: list("é z".encode())}


def test_sessions_keep_their_ids(spark):
    """Named sessions, whole numbers beyond what a float holds, and null ones beside them."""
    tok = Tokenizer(spark, byte_artifact())
    for kind, ids in (("string", ["a", "b", None]), ("long", [2**53 + 1, 2**53, None])):
        df = spark.createDataFrame([(s, t, f"{t}") for s in ids for t in range(3)], f"s {kind}, t long, x string")
        got = sessions.patches(tok, df, "s", "t", "x").collect()
        assert sorted(((r.session, r.revision) for r in got), key=repr) == sorted(((s, t) for s in ids for t in range(3)), key=repr)
        assert all(r.token_count == r.revision + 1 for r in got)
        grown = spark.createDataFrame([(s, t, "012"[: t + 1]) for s in ids for t in range(3)], f"s {kind}, t long, x string")
        assert all(r.token_count == r.revision + 1 for r in sessions.transcripts(tok, grown, "s", "t", "x").collect())


COMMANDS = [
    ("a", 0, None, "one", None), ("a", 1, "append", " two", 0), ("a", 2, "append", " lost", 7), ("a", 3, "put", "new", 1), ("a", 4, "put", "lost", 1), ("a", 5, "append", "er", 2),
    ("b", 0, "append", "x", None), ("b", 1, "delete", None, 5), ("b", 2, "delete", None, 0), ("b", 3, "append", "y", -1), ("c", 0, "delete", None, None), ("c", 1, "put", "", None), (None, 0, "put", "z", None),
]
PATHS = ["seed", "append", "revision_conflict", "overwrite", "revision_conflict", "append", "seed", "revision_conflict", "deleted", "seed", "unknown_session", "overwrite", "seed"]


def test_commands_on_tables(spark):
    tok = Tokenizer(spark, byte_artifact())
    df = spark.createDataFrame(COMMANDS, "s string, t long, op string, x string, e long")
    got = [tuple(r) for r in sessions.patches(tok, df, "s", "t", "x", "op", "e").collect()]
    assert sorted(r[5] for r in got) == sorted(PATHS)
    newer = [r for r in got if r[0] == "a"]
    assert [r[5] for r in newer] == PATHS[:6] and newer[3][2:5] == (0, list(b"new"), 3) and newer[2][1:5] == (1, 7, [], 7)


def test_commands_on_streams(spark, tmp_path):
    from lexiform.streaming.sessions import patch_stream

    tok = Tokenizer(spark, byte_artifact())
    schema = "s string, t long, op string, x string, e long"
    for k, part in enumerate((COMMANDS[:4], COMMANDS[4:8], COMMANDS[8:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    turns = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = patch_stream(tok, turns, "s", "t", "x", "op", "e").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(r[5] for r in got) == sorted(PATHS)
    assert {r[0] for r in got} == {"a", "b", "c", None}
    assert [r[3] for r in got if r[0] == "a" and r[5] == "overwrite"] == [list(b"new")]


def test_forks_share_a_past(spark):
    tok = Tokenizer(spark, byte_artifact())
    turns = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("f", 9, "!")], "conv_id string, turn long, text string")
    forks = spark.createDataFrame([("a", "f", 1)], "session string, name string, upto long")
    ids = {r.session: bytes(r.ids) for r in sessions.fold(sessions.patches(tok, sessions.forked(turns, forks))).collect()}
    assert ids == {"a": b"xyz", "f": b"xy!"}


def test_long_texts_are_spread(spark):
    rng = random.Random(6)
    texts = [words(rng, 400), "a" * 5000, "the cat" * 900, "", None, " x"]
    tok = Tokenizer(spark, byte_artifact())
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.ids for r in tok.encode_spread(df, "i", "t", size=64, partitions=3).collect()}
    assert got == {i: None if t is None else list(t.encode()) for i, t in enumerate(texts)}
    parts = df.select(F.col("t"), schemes.ranges(F.col("t"), 64).alias("p")).collect()
    assert all("".join(r.p) == r.t for r in parts if r.t is not None) and len(parts[2].p) > 50

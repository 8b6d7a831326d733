import json
import random

import pytest
from pyspark.sql import functions as F

from lexiform.functions import schemes, text
from lexiform.functions.bpe import _heap, _linear, merge
from lexiform.operators import lookup
from lexiform.operators.sessions import Session, patches
from lexiform.operators.tokens import Engine, Tokenizer, ragged
from lexiform.plans import routing
from lexiform.sources.artifact import Added, byte_artifact, from_json, from_ranks

public = pytest.importorskip("public_tokenizers")
hf = pytest.importorskip("tokenizers")  # the oracle only; the engine doesn't import it

ALPHABET = ["a", "B", "é", "中", "🙂", "̈", "‍", " ", " ", "\n", "\r\n", "\t", "1", "٣", "'s", "'LL", "!", "/", "_", "ǅ", "ʰ", "　", "the", "の"]


def adversarial(n, seed=1):
    rng = random.Random(seed)
    return ["", " ", "\n\n", "1234567", "don't DON'T"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def real():
    with open(public.path("byte_bpe_50k.json"), "rb") as f:
        return from_json(f.read())


@pytest.fixture(scope="module")
def texts(spark, small):
    return [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + adversarial(300)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i long, t string")


def test_merge_orders():
    rng = random.Random(2)
    for _ in range(200):
        ranks = {}
        for r in range(30):
            ranks.setdefault((rng.randrange(12), rng.randrange(12)), (r, rng.randrange(12)))
        ids = [rng.randrange(12) for _ in range(rng.randrange(0, 60))]
        assert _linear(list(ids), ranks) == _heap(list(ids), ranks) == merge(ids, ranks)


def test_encode_equals_oracle(spark, real, texts):
    oracle = hf.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = [oracle.encode(t).ids for t in texts]
    df = frame(spark, texts)
    tok = Tokenizer(spark, real)
    got = {r.i: list(r.ids) for r in df.select("i", tok.encode(F.col("t")).alias("ids")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    again = {r.i: list(r.ids) for r in tok.encode_distinct(df, "i", "t").collect()}
    assert again == got
    assert [tok.local.encode(t) for t in texts] == want
    null = spark.createDataFrame([(1, None)], "i long, t string").select(tok.encode(F.col("t")).alias("x")).first()
    assert null.x is None


@pytest.mark.parametrize("scheme", list(schemes.SCHEMES))
def test_schemes(spark, texts, scheme):
    got = {r.i: list(r.p) for r in frame(spark, texts).select("i", schemes.pieces(F.col("t"), scheme).alias("p")).collect()}
    assert all("".join(got[i]) == t for i, t in enumerate(texts))
    if len(schemes.SCHEMES[scheme]) == 1 and scheme != "kimi":
        split = hf.pre_tokenizers.Split(hf.Regex(schemes.SCHEMES[scheme][0]), "isolated")
        assert all(got[i] == [p for p, _ in split.pre_tokenize_str(t)] for i, t in enumerate(texts))
    assert [got[i] for i in range(len(texts))] == [schemes.split(t, scheme) for t in texts]


def test_scheme_names():
    assert schemes.by_patterns([schemes.GPT4_POSSESSIVE]) == "gpt4" and schemes.by_patterns(list(schemes.DEEPSEEK)) == "deepseek_v3"
    assert schemes.resolve("r50k") == "gpt2"
    with pytest.raises(ValueError):
        schemes.by_patterns(["x+"])


def test_rank_file():
    import base64

    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    a = from_ranks(data, "gpt2")
    ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in data.splitlines())}
    oracle = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = Engine(a)
    assert all(e.encode(t) == oracle.encode_ordinary(t) for t in adversarial(200, 5) + ["internationalization " * 9])


def test_decode_and_spans(spark, real, texts):
    tok = Tokenizer(spark, real)
    df = frame(spark, texts).withColumn("ids", tok.encode(F.col("t")))
    rows = df.select("t", "ids", tok.decode("ids").alias("d"), tok.spans(F.col("t"), F.col("ids")).alias("s")).collect()
    for r in rows:
        assert r.d == r.t
        assert all(a < b for a, b in zip(r.s.starts, r.s.ends))
        assert not r.t or (r.s.starts[0], r.s.ends[-1]) == (0, len(r.t))
    bad = df.select(tok.spans(F.concat("t", F.lit("x")), F.col("ids")).alias("s")).collect()
    assert all(r.s.starts is None for r in bad)
    assert ragged(df, "i", "ids").count() == sum(len(r.ids) for r in rows)


def test_added_tokens():
    added = [Added(300, "<a>"), Added(301, "<a><b>"), Added(302, "<l>", lstrip=True), Added(303, "<r>", rstrip=True, special=True), Added(304, "word", single_word=True)]
    e = Engine(byte_artifact(added=added))
    raw = lambda s: list(s.encode())
    assert e.encode("x<a><b>y<a>") == [*raw("x"), 301, *raw("y"), 300]
    assert e.encode("x  <l> y") == [*raw("x"), 302, *raw(" y")]
    assert e.encode("x <r> \n y") == [*raw("x "), 303, *raw("y")]
    assert e.encode("a word words") == [*raw("a "), 304, *raw(" words")]
    assert e.decode([*raw("x"), 303]) == b"x" and e.decode([*raw("x"), 303], False) == b"x<r>"


def test_added_tokens_in_columns(spark):
    a = byte_artifact(added=[Added(300, "<a>")])
    a.bos, a.eos = [1], [2]
    tok = Tokenizer(spark, a)
    got = {r.i: list(r.x) for r in frame(spark, ["<a>b", "b"]).select("i", tok.encode(F.col("t"), True).alias("x")).collect()}
    assert got == {0: [1, 300, 98, 2], 1: [1, 98, 2]}


def test_loader_refusals_and_forms():
    with pytest.raises(ValueError, match="WordPiece"):
        from_json(json.dumps({"model": {"type": "WordPiece", "vocab": {}}}))
    with pytest.raises(ValueError, match="Unigram"):
        from_json(json.dumps({"model": {"type": "Unigram", "vocab": []}}))
    base = {"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b", "a x", "a b"]}}
    a = from_json(json.dumps(base))
    assert a.ranks == {(0, 1): (0, 2)} and Engine(a).encode("abcab") == [2, 2]  # c has no byte here: dropped
    assert a.unsafe_ranks() == [] and len(a.fingerprint()) == 64
    assert from_json(json.dumps({"model": {**base["model"], "merges": [["a", "b"]]}})).fingerprint() == a.fingerprint()
    with pytest.raises(ValueError, match="normalizer"):
        from_json(json.dumps({**base, "normalizer": {"type": "Lowercase"}}))


def test_sessions_state_machine(real):
    e, rng = Engine(real), random.Random(7)
    for _ in range(10):
        s, ids = Session(e), []
        for _ in range(25):
            body = s.text + rng.choice(adversarial(5, rng.randrange(99))) if rng.random() < 0.75 else rng.choice(adversarial(9, rng.randrange(99)))
            revision, at, new, n, path = s.transcript(body)
            ids = ids[:at] + new if path != "hit" else ids
            assert ids == s.ids == e.encode(body) and n == len(ids) and revision == s.revision
        f = s.fork()
        f.append("more")
        assert f.revision == 1 and s.ids == ids
        assert s.append("x", expected=s.revision + 1)[4] == "revision_conflict" and s.ids == ids
        before = s.revision
        assert s.append("")[4] == "noop" and s.revision == before + 1


def test_session_tables(spark, small, real, tmp_path):
    from lexiform.streaming.sessions import patch_stream

    turns = spark.read.parquet(f"{small}/conversations.parquet")
    tok = Tokenizer(spark, real)
    rows = patches(tok, turns).collect()
    state = {}
    for r in sorted(rows, key=lambda r: (r.session, r.revision)):
        state[r.session] = state.get(r.session, [])[: r.replace_from] + list(r.replacement_ids)
        assert len(state[r.session]) == r.token_count
    bodies = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        bodies[r.conv_id] = bodies.get(r.conv_id, "") + r.text
    assert state == {k: tok.local.encode(v) for k, v in bodies.items()}
    turns.write.parquet(str(tmp_path / "in"))
    stream = patch_stream(tok, spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("patches").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.session, r.revision)
    assert sorted(map(tuple, spark.sql("select * from patches").collect()), key=lambda r: r[:2]) == sorted(map(tuple, rows), key=lambda r: r[:2])
    assert sorted(rows, key=key)


def test_longest_prefix(spark):
    entries = ["", "a", "ab", "abc" * 50, "abc" * 50 + "x", "zé", "ab"]
    queries = ["abc" * 60, "abc" * 50 + "xyz", "b", "zéro", "", "ab"]
    q = spark.createDataFrame(list(enumerate(queries)), "q long, body string")
    e = spark.createDataFrame(list(enumerate(entries)), "e long, head string")
    got = {r.q: (r.e, r.matched_bytes) for r in lookup.longest_prefix(q, e, "q", "body", "e", "head").collect()}
    want = {}
    for i, t in enumerate(queries):
        hits = [(len(x.encode()), -k) for k, x in enumerate(entries) if x and t.startswith(x)]
        if hits:
            want[i] = (-max(hits)[1], max(hits)[0])
    assert got == want


def test_routing():
    assert routing.plan().chain == ("split", "fast", "reference") and routing.plan("auto") == routing.plan()
    assert routing.plan("reference").reasons == ("R_POLICY_REFERENCE",)
    assert routing.plan(certified=False).chain == ("reference",)
    with pytest.raises(ValueError):
        routing.plan("require_accelerated", certified=False)


def test_normalizers(spark):
    cases = ["", " ", "a  b   c", "  a ", "▁a", "　x　"]
    df = frame(spark, cases)
    col = lambda c: [r.x for r in df.select("i", c(F.col("t")).alias("x")).orderBy("i").collect()]
    assert col(text.collapse_spaces) == ["", " ", "a b c", " a ", "▁a", "　x　"]
    assert col(text.strip) == ["", "", "a  b   c", "a", "▁a", "x"]
    assert col(text.metaspace) == ["", "▁", "▁a▁▁b▁▁▁c", "▁▁a▁", "▁a", "▁　x　"]
    assert col(text.add_prefix_space) == ["", " ", " a  b   c", "  a ", " ▁a", " 　x　"]
    assert col(lambda c: text.prepend(c, "▁"))[0] == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


LONG = {"LF": "\n" * 1_000_000, "CRLF": "\r\n" * 500_000, "letters": "a" * 1_000_000, "capitals": "aB" * 500_000, "digits": "7" * 1_000_000, "marks": "!" * 1_000_000, "spaces": " " * 1_000_000, "lines": "ab \n" * 250_000, "returns": "\r" * 1_000_000}


@pytest.mark.parametrize("scheme", list(schemes.SCHEMES))
def test_a_million_characters(spark, scheme):
    """No scheme's expression recurses over a long run; the JVM and Python agree on its pieces."""
    rows = [(name, part) for name, t in LONG.items() for part in (t, t[:6000])]
    df = spark.createDataFrame(rows, "name string, t string").repartition(4)
    p = schemes.pieces(F.col("t"), scheme)
    got = df.select("name", F.length("t").alias("size"), F.size(p).alias("n"), F.when(F.length("t") <= 6000, p).alias("p"), (F.array_join(p, "") == F.col("t")).alias("whole")).collect()
    assert len(got) == len(rows) and all(r.n >= 1 and r.whole for r in got)
    assert all(r.p == schemes.split(LONG[r.name][: r.size], scheme) for r in got if r.size <= 6000)


def test_laguna_in_the_jvm(spark):
    import itertools

    texts = ["".join(x) for n in range(1, 7) for x in itertools.product("a \r\n", repeat=n)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", schemes.pieces(F.col("t"), "laguna").alias("p")).collect()
    assert all(list(r.p) == schemes.split(r.t, "laguna") for r in rows) and len(rows) == len(texts)

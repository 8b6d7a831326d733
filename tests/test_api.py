import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexiform import api, config
from lexiform.__main__ import main
from lexiform.errors import ArtifactHashMismatch, ArtifactNotFound, ConfigInvalid, RegistryInvalid, SessionRevisionConflict, UncertifiedTokenizer, UnsupportedConfig
from lexiform.functions import schemes
from lexiform.operators.tokens import Engine
from lexiform.plans.routing import Policy
from lexiform.sources import convert, manifest
from lexiform.sources.artifact import Added, byte_artifact, from_json, from_ranks, unsafe_frame

public = pytest.importorskip("public_tokenizers")
hf = pytest.importorskip("tokenizers")  # the oracle only
TEXTS = ["", "Hello world's 1234567 things\n\n  x", "é中🙂 don't", "a" * 50, "internationalization"]


def read(name):
    with open(public.path(name), "rb") as f:
        return f.read()


def test_front_door(spark):
    path = "file://" + public.path("byte_bpe_50k.json")
    tok = api.load(spark, path, threshold=10)
    oracle = hf.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert [list(e.ids) for e in tok.encode_batch(TEXTS)] == [oracle.encode(t).ids for t in TEXTS]
    assert [tok.decode(tok.encode(t).ids) for t in TEXTS] == TEXTS
    e = tok.encode("é中 a", offsets=True)
    assert e.starts[0] == 0 and e.ends[-1] == 4
    assert tok.encode("one two", session="s").ids == tok.encode("one two").ids
    assert tok.encode("one two three", session="s").ids == tok.encode("one two three").ids
    revision = tok.sessions["s"].revision
    with pytest.raises(SessionRevisionConflict) as x:
        tok.append("s", "x", expected_revision=revision + 1)
    assert x.value.report()["error"]["code"] == "SESSION_REVISION_CONFLICT"
    tok.append("s", " four", expected_revision=revision)
    tok.fork("s", "t")
    assert tok.sessions["t"].ids == list(tok.encode("one two three four").ids)
    tok.close("t")
    with pytest.raises(UnsupportedConfig):
        tok.encode("a", session="s", add_special_tokens=True)
    assert "append 2" in tok.explain()
    few = api.load(spark, path, max_sessions=2)
    for name in ("a", "b", "a", "c"):
        few.encode("x", session=name)
    assert list(few.sessions) == ["a", "c"] and few.counts["hit"] == 1
    df = spark.createDataFrame([("short",), ("a longer text",), ("x<|endoftext|>",)], "text string")
    assert {(r.path, r.n_rows) for r in tok.explain(df).collect()} == {("fast", 1), ("split", 1), ("reference", 1)}
    with pytest.raises(UncertifiedTokenizer):
        api.load(spark, path, certified=False, policy="require_accelerated")
    with pytest.raises(ArtifactHashMismatch):
        api.load(spark, path, sha256="0" * 64)
    with pytest.raises(ArtifactNotFound):
        api.load(spark, "file:///no/such.json")


def test_sql_functions(spark):
    tok = api.load(spark, "file://" + public.path("byte_bpe_50k.json"))
    tok.register("tk")
    spark.createDataFrame([(0, "Hello world"), (1, None)], "i int, t string").createOrReplaceTempView("texts_of_api")
    rows = spark.sql("select i, tk_count(t) as n, tk_decode(tk_encode(t)) as back from texts_of_api order by i").collect()
    assert [tuple(r) for r in rows] == [(0, 2, "Hello world"), (1, None, None)]
    pieces = spark.sql("select p.* from texts_of_api, lateral tk_pieces(t) p").collect()
    assert [tuple(r) for r in pieces] == [(0, "Hello"), (1, " world")]


def test_byte_fallback_front_door(spark, tmp_path):
    from tests.test_sentencepiece import oracle

    t = oracle(True)
    (tmp_path / "tokenizer.json").write_text(t.to_str())
    tok = api.load(spark, f"file://{tmp_path}/tokenizer.json")
    df = spark.createDataFrame([(0, "the and é"), (1, None)], "i int, t string")
    rows = df.select("i", tok.ids(F.col("t")).alias("x"), tok.text(tok.ids(F.col("t"))).alias("back")).orderBy("i").collect()
    assert list(rows[0].x) == t.encode("the and é", add_special_tokens=False).ids and rows[0].back == "the and é" and rows[1].x is None
    assert tok.encode("the and", session="s").ids == tok.encode("the and").ids


@pytest.mark.parametrize("scheme", ["gpt2", "kimi", "deepseek_v3"])
def test_converted_ranks(spark, scheme):
    data = read("byte_bpe_50k.tiktoken")
    body = convert.to_json(convert.rank_frame(spark, data), scheme, {"<|end|>": 50256})
    a, b = Engine(from_json(body)), Engine(from_ranks(data, scheme))
    assert all(a.encode(t) == b.encode(t) for t in TEXTS) and a.encode("<|end|>") == [50256]
    if scheme == "gpt2":
        oracle = hf.Tokenizer.from_str(body)
        assert all(a.encode(t) == oracle.encode(t).ids for t in TEXTS)
    assert json.loads(body)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == schemes.SCHEMES[scheme][0]


def test_splits_table_equals_merges(spark):
    data = read("byte_bpe_50k.tiktoken")
    table = convert.splits(convert.rank_frame(spark, data).filter("length(token) <= 4 and rank < 3000"))
    every = {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines())}
    ranks = {t: r for t, r in every.items() if len(t) <= 4 and r < 3000}
    want = {(r, k, ranks[t[:k]], ranks[t[k:]]) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
    assert {tuple(r) for r in table.collect()} == want
    assert {bytes(r.token): r.rank for r in convert.rank_frame(spark, data).collect()} == every
    lines = data.splitlines()
    for bad, why in (([b"eA== x"], "no token and rank"), ([*lines, b"one"], "no token and rank"), ([*lines, lines[0]], "more than once"), (lines[:-2] + lines[-1:], "dense"), ([b"YWI= 0"], "every byte")):
        with pytest.raises(RegistryInvalid, match=why):
            convert.rank_frame(spark, b"\n".join(bad))
    long = convert.rank_frame(spark, data).filter("rank < 256").unionByName(spark.createDataFrame([(bytearray(b"abcd"), 256)], "token binary, rank int"))
    with pytest.raises(RegistryInvalid, match="no two tokens"):
        convert.to_json(long, "gpt2")


def test_sql_functions_equal_columns(spark):
    """The SQL functions split in the JVM where they can, and give what the columns give."""
    from lexiform.operators.tokens import Tokenizer

    for scheme in ("gpt2", "deepseek_v3", "laguna"):
        for nfc, added in ((False, []), (True, [Added(300, "it's"), Added(301, "\\d")])):
            a = byte_artifact(scheme, added)
            a.nfc = nfc
            one = api.Lexiform(spark, a, config.Config())
            one.register("x")
            df = spark.createDataFrame([(t,) for t in [*TEXTS, "it's \\d 12345", "a\r\n\nb", None]], "t string")
            df.createOrReplaceTempView("sql_texts")
            got = spark.sql("select t, x_encode(t) as e, x_count(t) as n, x_decode(x_encode(t)) as d from sql_texts").collect()
            want = {r.t: r.e for r in df.select("t", Tokenizer(spark, a).encode(F.col("t")).alias("e")).collect()}
            for r in got:
                assert r.e == want[r.t] and r.n == (None if r.t is None else len(r.e))
                assert r.d == r.t or nfc


def test_unsafe_ranks(spark):
    a = from_json(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3, "ba": 4}, "merges": ["ab b", "a b", "b a"]}}))
    rows = unsafe_frame(a.merges_frame(spark)).collect()
    assert [(r.left, r.right) for r in rows] == a.unsafe_ranks() == [(2, 1)]


def test_manifest(spark, tmp_path):
    for name, body in (("one", b"1"), ("two", b"22"), ("copy", b"1"), ("odd", b"odd")):
        (tmp_path / f"{name}.json").write_bytes(body)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = spark.createDataFrame([("one", sha(b"1"), 1), ("two", sha(b"2x"), 2), ("gone", sha(b"g"), 1), ("odd", sha(b"o"), 1)], "family string, sha256 string, n_bytes long")
    files = manifest.scan(spark, f"file://{tmp_path}")
    names = files.select("path", F.regexp_extract("path", r"(\w+)\.json", 1).alias("family"))
    assert {(r.family, r.status) for r in manifest.check(files, listed, names).collect()} == {("one", "ok"), ("two", "hash_mismatch"), ("gone", "missing"), ("copy", "unlisted"), ("odd", "size_mismatch")}
    got = {r.path.rsplit("/", 1)[1]: r.family for r in manifest.families(files, listed).collect()}
    assert got == {"one.json": "one", "copy.json": "one", "two.json": None, "odd.json": None}
    assert manifest.resolve(spark, f"file://{tmp_path}", listed, "one").endswith(("one.json", "copy.json"))
    with pytest.raises(ArtifactHashMismatch):
        manifest.resolve(spark, f"file://{tmp_path}", listed, "two")
    for name in ("gone", "unknown"):
        with pytest.raises(ArtifactNotFound):
            manifest.resolve(spark, f"file://{tmp_path}", listed, name)


def test_config(spark, tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('policy = "reference"\nthreshold = 5\n')
    spark.conf.set("spark.lexiform.threshold", "7")
    try:
        c = config.load(spark, str(file), diagnostics="on")
    finally:
        spark.conf.unset("spark.lexiform.threshold")
    assert (c.policy, c.threshold, c.diagnostics) == (Policy.REFERENCE, 7, True)
    for bad in ({"threshold": "x"}, {"threshold": 0}, {"nothing": 1}, {"diagnostics": "maybe"}, {"policy": "x"}):
        with pytest.raises(ConfigInvalid):
            config.load(**bad)
    file.write_text("= 1")
    with pytest.raises(ConfigInvalid):
        config.load(path=str(file))


def test_command_line(tmp_path, capsys):
    path = public.path("byte_bpe_50k.tiktoken")
    assert main(["inspect", path]) == 0 and json.loads(capsys.readouterr().out)["vocab"] == 50256
    assert main(["verify", path, "0" * 64]) == 2 and json.loads(capsys.readouterr().err)["error"]["code"] == "ARTIFACT_HASH_MISMATCH"
    assert main(["inspect", "/no/such"]) == 2
    assert main(["convert", path, str(tmp_path / "t.json")]) == 0 and main(["inspect", str(tmp_path / "t.json")]) == 0
    assert main(["doctor"]) == 0 and main(["nothing"]) == 64


def test_validity(spark):
    from lexiform.functions.text import valid

    rows = spark.createDataFrame([(0, bytearray(b"ok")), (1, bytearray(b"\xc3")), (2, bytearray("é".encode())), (3, None)], "i int, b binary")
    assert [r.v for r in rows.orderBy("i").select(valid(F.col("b")).alias("v")).collect()] == [True, False, True, None]

"""Odd and large inputs of the registered queries."""

from pyspark.sql import functions as F

from lexiform import queries


def test_bytes_of_empty_and_null_texts(spark, tmp_path):
    rows = [(1, "ab c"), (2, ""), (3, None), (4, "hé")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.encode_bytes_ids(spark, str(tmp_path)).collect()}
    want = {i: (len(b), sum(b) if b else None, b[-1] if b else None) for i, t in rows if t is not None for b in [t.encode()]}
    assert got == want | {3: (None, None, None)}


def test_recorded_sessions_are_those_written_and_chained(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from lexiform.operators import sessions
    from lexiform.operators.tokens import Tokenizer
    from lexiform.sources import records
    from lexiform.sources.artifact import byte_artifact

    rng = random.Random(5)
    rows = [(s, t, rng.choice(["", None, " mañana", "a b", "\n\n", "x" * 50, " 한 é", "word, word"])) for s in (1, 2, None) for t in range(1, 41)]
    turns = spark.createDataFrame(rows, "s long, t long, x string").repartition(5)
    tok, key = Tokenizer(spark, byte_artifact()), bytes(range(32))
    w = Window.partitionBy("s").orderBy("t")
    states = turns.select(F.col("s").alias("session"), (F.row_number().over(w) - 1).cast("long").alias("revision"), F.array_join(F.collect_list("x").over(w.rowsBetween(Window.unboundedPreceding, 0)), "").alias("text"))
    states = states.withColumn("ids", tok.encode(F.col("text")))
    held = {(r.session, r.revision): (r.ok, len(r.ids)) for r in records.chain(records.write(states, key), key).collect()}
    shape = {(r.session, r.revision): (r.kept, r.replace_from) for r in records.appended(states).collect()}
    got = {(r.session, r.revision): (r.ok, r.n_tokens, r.kept, r.replace_from) for r in sessions.recorded(tok, turns, "s", "t", "x", key).collect()}
    assert len(got) == len(rows) and got == {k: (*held[k], *shape[k]) for k in held}
    # Only the turns' texts are moved: no row holds what all turns before it have said.
    plan = sessions.recorded(tok, turns, "s", "t", "x", key)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_nodes_come_in_bounded_batches_without_each_others_names(spark):
    from pyspark.sql import functions as F

    from lexiform.operators import store

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        rows = [(i, "añb " * (i % 50)) for i in range(120)] + [(120, None), (121, "x" * 32)]
        nodes, heads = store.export(spark.createDataFrame(rows, "s long, t string"), "s", "t", 16)
        assert int(spark.conf.get(key).rstrip("b")) <= 4 << 20
        assert {r.session: r.n_blocks for r in heads.collect()} == {i: len(t or "") // 16 for i, t in rows}
        assert store.checked(nodes).agg(F.min("ok")).first()[0]
        plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
        assert "EvalPython" not in plan(heads.select("n_blocks"))
        assert "nodes#" not in plan(nodes).split("Generate")[0]
    finally:
        spark.conf.set(key, before)


def test_verified_records_stay_arrays(spark, monkeypatch):
    import pyarrow as pa

    from lexiform.sources import records

    assert not hasattr(records, "pd")  # rows went through a frame of Python numbers
    key = bytes(32)
    data = records.encode(records.Record(key, 0, (1, 2**32 - 1), "é"))
    monkeypatch.setattr(records, "decode", None)  # which makes a tuple of numbers
    empty = records.encode(records.Record(key, 0, (), ""))
    bad = data[:-1] + b"x"
    run = records.F.arrow_udf
    held = {}
    monkeypatch.setattr(records.F, "arrow_udf", lambda kind: lambda f: held.setdefault("f", f) and run(kind)(f))
    records.verify(records.F.lit(b""), key)
    got = held["f"](pa.array([data, None, bad, empty], pa.binary())).to_pylist()
    assert [(r["ok"], r["failure"], r["text"], r["ids"]) for r in got] == [(True, None, "é", [1, 2**32 - 1]), (False, None, None, None), (False, "checksum", None, None), (True, None, "", [])]


def test_rows_of_one_revision_are_not_moved_or_linked(spark):
    from lexiform.sources import records

    rows = spark.createDataFrame([(7, 0, "a", [1]), (7, 0, "b", [2])], "session long, revision long, text string, ids array<int>")
    held = records.write(rows, bytes(32), single=True)
    assert "Repartition" not in held._jdf.queryExecution().optimizedPlan().toString()
    assert [r.v.ok for r in held.select(records.verify(records.F.col("record"), bytes(32)).alias("v")).collect()] == [True, True]


def test_offsets_encode_texts_once(spark, small):
    plan = queries.ragged_offsets(spark, small)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan


def test_routes_read_whole_rows_once_and_join_nothing(spark, small):
    plan = queries.route_execute(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 3  # whole, short and long ones


def test_pieces_are_weighed_by_compiled_code(spark, tmp_path):
    rows = [(1, "it's 12 a\n\nb"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.pieces_by_scheme(spark, str(tmp_path))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.scheme: (r.n_pieces, r.weight) for r in df.collect()}
    for name in queries.schemes.SCHEMES:
        p = queries.schemes.split(rows[0][1], name)
        assert got[name] == (len(p), sum(k * len(x) for k, x in enumerate(p, 1)))


def test_index_makes_records_once(spark, small):
    plan = queries.index_rebuild(spark, small)._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") >= 3


def test_spread_keeps_short_rows_and_checkpoints_need_no_spans(spark):
    from pyspark.sql import functions as F

    from lexiform.operators.tokens import Tokenizer, checkpoints
    from lexiform.sources.artifact import byte_artifact

    tok = Tokenizer(spark, byte_artifact())
    rows = [(1, "añ b " * 9), (2, ""), (3, None), (4, "short")]
    df = spark.createDataFrame(rows, "i long, t string")
    spread = tok.encode_spread(df, "i", "t", 8)
    assert {r.i: r.ids for r in spread.collect()} == {i: None if t is None else list(t.encode()) for i, t in rows}
    assert "Union" in spread._jdf.queryExecution().optimizedPlan().toString()
    with_ids = df.withColumn("ids", F.when(F.col("i") == 4, F.array(F.lit(1))).otherwise(tok.encode(F.col("t"))))
    for r in with_ids.select(tok.checkpoints(F.col("t"), F.col("ids"), 4).alias("a"), checkpoints(tok.spans(F.col("t"), F.col("ids")), 4).alias("b")).collect():
        assert r.a == r.b

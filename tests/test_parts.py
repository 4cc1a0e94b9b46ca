"""Schedules, embedding requests, token parts, chunk digests and method orders."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import parts
from tessera.operators import joins, resolution
from tessera.plans import stages
from tessera.sources import embeddings
from tessera.sources.sql import Refused


def stage(name, reads, writes):
    return stages.Stage(name, tuple(reads), tuple(writes), lambda r: {})


def test_schedules():
    a, b, c = stage("a", ["x"], ["y"]), stage("b", ["y", "z"], ["w"]), stage("c", ["x"], ["z"])
    assert [[s.name for s in w] for w in stages.schedule([b, a, c], {"x"})] == [["a", "c"], ["b"]]
    assert not stages.ready(b, [a, b, c], {"a"}) and stages.ready(b, [a, b, c], {"a", "c"})
    for bad in ([stage("a", ["w"], ["y"]), stage("b", ["y"], ["w"])], [stage("a", ["q"], ["y"])], [a, stage("d", ["x"], ["y"])], [stage("e", [], ["x"])]):
        with pytest.raises(Refused):
            stages.schedule(bad, {"x"})


def test_a_stage_writes_what_it_declares(spark):
    wrong = stages.Stage("w", (), ("y",), lambda r: {"z": spark.range(1)})
    with pytest.raises(Refused):
        stages.execute([wrong], {})
    with pytest.raises(Refused):
        stages.refuse_rows(spark.range(1), "a row")
    stages.refuse_rows(spark.range(0), "a row")


def test_embedding_batches(spark):
    def call(body):
        texts = json.loads(body)["input"]
        assert len(texts) <= embeddings.BATCH
        return json.dumps({"data": [{"index": i, "embedding": [1.0, 0.0] if len(t) % 2 else [0.0, 1.0]} for i, t in enumerate(texts)][::-1]}).encode()

    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(300)], "key long, text string")
    got = {r.key: r.vector for r in embeddings.embed(df, call, "m", 2).collect()}
    assert len(got) == 300 and all(v == ([1.0, 0.0] if (k % 7) % 2 else [0.0, 1.0]) for k, v in got.items())
    for data in ([], [{"index": 0, "embedding": [1.0]}], [{"index": 0, "embedding": [1.0, 1.0]}], [{"index": 0, "embedding": [float("nan"), 0.0]}], [{"index": 1, "embedding": [1.0, 0.0]}]):
        with pytest.raises(ValueError):
            embeddings.parse_response(json.dumps({"data": data}).encode(), 1, 2)


def test_embedding_cache(spark):
    p = spark.createDataFrame([("s", "a", 2, [0.0, 1.0], 5), ("s", "a", 1, [1.0, 0.0], 5), ("s", "b", 1, [1.0, 0.0], 5), ("s", "b", 2, [1.0, 0.0], 6)], "spec string, input string, sequence int, vector array<float>, tokens int")
    got = {r.input: (r.vector, r.error) for r in embeddings.winners(p).collect()}
    assert got == {"a": ([1.0, 0.0], None), "b": ([1.0, 0.0], "receipts_disagree")}
    wanted = spark.createDataFrame([("s", "a"), ("s", "c"), ("s", "c")], "spec string, input string")
    assert [tuple(r) for r in embeddings.missing(wanted, p).collect()] == [("s", "c")]


def test_token_parts(spark):
    rows = [("u", "c", i, n) for i, n in enumerate([500, 500, 30, 3000, 10, 1024])] + [("u", "d", 0, 7)]
    df = spark.createDataFrame(rows, "unit string, context string, ordinal int, tokens int")
    got = {(r.context, r.ordinal): (r.part, r.lexical_only) for r in parts.token_parts(df).collect()}
    assert [got["c", i][0] for i in range(6)] == [0, 0, 1, 2, 3, 4] and got["d", 0] == (0, False)
    assert [got["c", i][1] for i in range(6)] == [False, False, False, True, False, False]


def test_chunk_digests_do_not_depend_on_layout(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 13).alias("v"))
    key = lambda d: sorted(map(tuple, parts.chunk_digests(d, "id", 300).collect()))
    one = key(df)
    assert [n for _, n, _ in one] == [300, 300, 300, 100] and one == key(df.repartition(7))
    other = key(df.withColumn("v", F.when(F.col("id") == 500, -1).otherwise(F.col("v"))))
    assert [a == b for a, b in zip(one, other, strict=True)] == [True, False, True, True]


def test_method_orders(spark):
    c = spark.createDataFrame([("A", ["A", "B", "C"], True), ("B", ["B", "C"], True), ("B", ["B"], True), ("D", None, False)], "class string, order array<string>, complete boolean")
    orders = resolution.linearized(c)
    assert {r["class"]: r.reason for r in orders.collect()} == {"A": None, "B": "conflicting", "D": "incomplete"}
    m = spark.createDataFrame([("C", "f"), ("B", "f"), ("C", "g")], "owner string, name string")
    assert [tuple(r) for r in resolution.dispatch(m, orders, "f").collect()] == [("A", "B")]


def test_innermost_span(spark):
    outer = spark.createDataFrame([("s", 1, 0, 100), ("s", 2, 10, 50), ("s", 3, 60, 90), ("s", 4, 62, 92)], "source string, id int, start int, stop int")
    inner = spark.createDataFrame([("s", 9, 20, 30), ("s", 8, 70, 80), ("s", 7, 0, 5), ("s", 6, 99, 101)], "source string, id int, start int, stop int")
    got = {r.inner_id: (r.outer_id, r.status) for r in joins.innermost(joins.contained(outer, inner, "source")).collect()}
    assert got == {9: (2, "resolved"), 8: (None, "ambiguous"), 7: (1, "resolved")}

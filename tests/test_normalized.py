"""Demand of filters, routing, contracts and codecs on small inputs; the queries themselves are held against SQL in test_catalog."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as V
from tessera.operators import demand, graph, resolution, validation


def test_demand_is_what_all_filters_have_in_common():
    filters = [("in", "id", [1, 2, 3, None]), ("and", ("in", "id", [2, 3, 4]), ("compare", "x", ">", 0)), ("or", ("eq", "id", 9), ("eq", "id", 2))]
    keys, rest = demand.demanded(filters, "id")
    assert keys == {2, 3} and rest == filters[1:]
    assert demand.demanded([("not", ("eq", "id", 1))], "id") == (None, [("not", ("eq", "id", 1))])
    assert demand.demanded([("eq", "id", None)], "id") == (frozenset(), [])
    assert demand.columns(filters[1]) == {"id", "x"}


def test_demand_reaches_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = demand.scan(orders, [("in", "o_orderkey", [1, 2]), ("eq", "o_orderkey", 2)], "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,2)]" in plan or "In(o_orderkey, [2])" in plan
    assert demand.scan(orders, [("eq", "o_orderkey", None)], "o_orderkey").count() == 0


def test_every_predicate_has_a_domain():
    assert sum(map(len, demand.DOMAINS.values())) + 2 == 29
    assert demand.domain("facet_membership", "scenarios") == "scenarios" and demand.domain("deployment_declaration", field="launch") == "source_artifacts"
    assert demand.domain("deployment_declaration", field="dependency") == "release_declarations"
    for bad in (("no_such",), ("facet_membership", "nowhere")):
        with pytest.raises(ValueError):
            demand.domain(*bad)


def test_typed_names_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "id long, name string")
    assert validation.typed(df, T.StructType([T.StructField("name", T.StringType())])).collect() == [("a",), ("b",)]
    with pytest.raises(TypeError, match="id: bigint, not int; gone: missing"):
        validation.typed(df, T.StructType([T.StructField("id", T.IntegerType()), T.StructField("gone", T.LongType())]))
    with pytest.raises(Exception, match="id: null"):
        validation.typed(df, T.StructType([T.StructField("id", T.LongType(), False)])).collect()


def test_codecs_round_trip(spark):
    arcs = spark.createDataFrame([(1, 2), (-5, 2**62), (1, 2), (0, -1)], "src long, dst long")
    chunks = graph.encoded(arcs, 2)
    assert sorted(r.n for r in chunks.collect()) == [1, 2]
    assert sorted(map(tuple, graph.decoded(chunks).collect())) == [(-5, 2**62), (0, -1), (1, 2)]
    v = spark.createDataFrame([([1.5, -2.0],), (None,), ([],)], "v array<float>")
    got = [(r.b, r.back) for r in v.select(V.encoded(v["v"]).alias("b")).select("b", V.decoded("b").alias("back")).collect()]
    assert got == [(bytes.fromhex("0000c03f000000c0"), [1.5, -2.0]), (None, None), (b"", [])]
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([float("nan")],)], "v array<float>").select(V.encoded("v")).collect()


def test_ambiguous_binders_and_overloads_stay_visible(spark):
    d = spark.createDataFrame([("outer", 1, 0, 90, 0), ("in1", 1, 10, 50, 1), ("in2", 1, 12, 60, 1)], "declaration string, source long, start long, stop long, depth int")
    v = spark.createDataFrame([("a", 1, 20, 30, "scoped", 100), ("b", 1, 55, 70, "declared", 100), ("c", 1, 20, 30, "other", 100), ("d", 1, 20, 30, "scoped", 25), ("e", 2, 20, 30, "scoped", 100)], "variable string, source long, start long, stop long, origin string, captured_bytes long")
    got = sorted((r.variable, str(r.declaration), r.status, r.reason) for r in resolution.type_binders(v, d).collect())
    assert got == [
        ("a", "in1", "ambiguous", "conflicting_candidates"), ("a", "in2", "ambiguous", "conflicting_candidates"), ("b", "outer", "resolved", "explicit_identity"), ("c", "None", "unresolved", "unsupported_native_origin"),
        ("d", "None", "unresolved", "outside_captured_scope"), ("e", "None", "unresolved", "missing_correspondence"),
    ]


def test_a_full_chunk_is_decoded_in_one_pass(spark):
    """65,536 arcs in one chunk: seconds, where a cost of the square would take minutes."""
    import time

    arcs = spark.range(graph.CHUNK_ARCS).select(F.col("id").alias("src"), (F.col("id") * -7).alias("dst"))
    chunks = graph.encoded(arcs).cache()
    assert chunks.count() == 1
    began = time.monotonic()
    assert graph.decoded(chunks).join(arcs, ["src", "dst"]).count() == graph.CHUNK_ARCS
    assert time.monotonic() - began < 30

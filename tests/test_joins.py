"""Containment over dyadic levels against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.plans import catalog

KIND = "g string, id long, start long, stop long"


def some_spans(seed, n, least):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randint(-600, 600)
        out.append((r.choice(["a", "b", None]), i, s, s + r.choice([least, 0, 1, 2, 7, 8, 9, 63, 64, r.randint(0, 900)])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_spans(spark, seed):
    outer, inner = some_spans(seed, 150, -3), some_spans(seed + 9, 150, 0)
    outer.append(("a", 1_000, -(2**40), 2**40))  # one over everything
    want = {(o[1], i[1]) for o in outer for i in inner if o[0] is not None and o[0] == i[0] and o[2] <= i[2] and i[3] <= o[3]}
    got = joins.contained(spark.createDataFrame(outer, KIND), spark.createDataFrame(inner, KIND), "g")
    rows = [(r.outer_id, r.inner_id) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    best = {}
    for o, i in want:
        width = next(x[3] - x[2] for x in outer if x[1] == o)
        best.setdefault(i, []).append((width, o))
    status = {i: min(ws)[1] if sum(w == min(ws)[0] for w, _ in ws) == 1 else None for i, ws in best.items()}
    assert {r.inner_id: r.outer_id for r in joins.innermost(got).collect()} == status
    assert {r.status for r in joins.innermost(got).collect()} <= {"resolved", "ambiguous"}


def test_spans_are_stored_once(spark):
    """However long they are; a query meets at most two cells a level."""
    spans = spark.range(500).select(F.lit("a").alias("g"), "id", (F.col("id") * 10).alias("start"), (F.col("id") * 10 + F.when(F.col("id") == 0, 2**40).otherwise(3)).alias("stop"))
    index = joins.span_index(spans, "g")
    assert index.count() == 500 and {r.level for r in index.select("level").distinct().collect()} == {2, 41}
    inner = spans.filter("id > 0").withColumn("stop", F.col("start"))
    assert joins.contained(spans, inner, "g").count() == 499 * 2
    assert joins.contained(spans.limit(0), inner, "g").count() == 0


def test_look_ups_are_never_broadcast(spark):
    """Spark believes exploded rows to be as few as before. Levels below the inner span's own aren't asked."""
    outer = spark.range(64).select(F.lit("a").alias("g"), "id", F.lit(0).alias("start"), F.pow(F.lit(2), F.col("id") % 32).cast("long").alias("stop"))
    inner = spark.range(100).select(F.lit("a").alias("g"), "id", F.lit(0).alias("start"), F.lit(2**30).alias("stop"))
    for got in (joins.contained(outer, inner, "g"), joins.innermost(joins.contained(outer, inner, "g"))):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joins.contained(outer, inner, "g").count() == 4 * 100  # two of each of the widths 2**30 and 2**31


@pytest.mark.parametrize("name", ["join_span_contains", "join_innermost_span"])
def test_queries_broadcast_no_look_ups(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

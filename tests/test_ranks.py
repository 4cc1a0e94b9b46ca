"""Ranks and sums over whole relations without one task that sorts everything, and rankings kept for their pages."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import parts
from tessera.operators import paging, ranking
from tessera.sources.sql import Refused


def some_rows(n=500):
    r = random.Random(4)
    return [(r.choice(["a", "a", "a", "b", None]), i, r.randint(0, 20)) for i in range(n)]


def test_ranks_inside_groups(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "g string, id long, x int").repartition(6)
    got = {r.id: r["rank"] for r in parts.ranked_within(df, ["g"], F.desc("x"), "id").collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert [got[r[1]] for r in mine] == list(range(len(mine)))
    every = {r.id: r["rank"] for r in ranking.promoted_first(df, F.col("x") == 7, F.desc("x"), F.col("id")).collect()}
    assert [every[r[1]] for r in sorted(rows, key=lambda r: (r[2] != 7, -r[2], r[1]))] == list(range(1, len(rows) + 1))


def test_running_sums(spark):
    rows = some_rows()
    df = spark.createDataFrame([(*r[:2], None if r[2] == 3 else r[2]) for r in rows], "g string, id long, x int").repartition(6)
    total, want = 0, {}
    for _, i, x in sorted(rows, key=lambda r: -r[1]):
        total += 0 if x == 3 else x
        want[i] = total
    assert {r.id: r.running for r in parts.running(df, F.col("x"), F.desc("id")).collect()} == want
    assert {r.id for r in paging.packed(df, [F.desc("id")], F.col("x"), 400).collect()} == {i for i, t in want.items() if t <= 400}
    assert parts.running(df.limit(0), F.col("x"), "id").count() == 0 and parts.ranked_within(df.limit(0), ["g"], "id").count() == 0


def test_no_window_gathers_everything(spark):
    df = spark.createDataFrame(some_rows(), "g string, id long, x int")
    scores = df.select(F.coalesce("g", F.lit("c")).alias("family"), F.lit("one").alias("channel"), F.col("id").alias("target"), F.lit(0).alias("occurrence"), F.col("x").cast("double").alias("score"))
    for out in (ranking.promoted_first(df, F.col("x") == 7, F.desc("x"), F.col("id")), ranking.fuse(scores), paging.packed(df, [F.col("id")], F.col("x"), 9)):
        assert "Exchange SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_retained_rankings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paging, "BUCKET_ROWS", 32)
    df = spark.createDataFrame(some_rows(100), "g string, id long, x int")
    path, request = f"file://{tmp_path}/r", {"query": "x", "min": 1}
    sections = {"up": (df, ["x", "id"]), "down": (df.filter("g = 'b'"), [F.desc("x"), "id"])}
    where = paging.retain(sections, path, request, "s1")
    for name, order in (("up", lambda r: (r[2], r[1])), ("down", lambda r: (-r[2], r[1]))):
        want, seen, token, pages = [r[1] for r in sorted((r for r in some_rows(100) if name == "up" or r[0] == "b"), key=order)], [], None, 0
        while True:
            rows, token = paging.retained_page(spark, path, request, "s1", name, 20, token)
            got = rows.collect()
            plan = rows._jdf.queryExecution().executedPlan().toString()
            pruned = plan[plan.index("PartitionFilters") :].split("]")[0]
            assert len(got) <= 20 and "bucket" in pruned and " = " in pruned
            seen += [r.id for r in got]
            pages += 1
            if token is None:
                break
        assert seen == want and (name == "down" or pages == 7)  # pages end where a bucket does: 20, 12, 20, 12, 20, 12, 4
    rows, token = paging.retained_page(spark, path, request, "s1", "up", 5)
    for bad in (lambda: paging.retained_page(spark, path, request, "s1", "down", 5, token), lambda: paging.retained_page(spark, path, request | {"min": 2}, "s1", "up", 5, token), lambda: paging.retained_page(spark, path, request, "s2", "up"), lambda: paging.retained_page(spark, path, request, "s1", "up", 5, "x")):
        with pytest.raises(Refused):
            bad()
    assert paging.retain({"up": (df.limit(0), ["x"])}, path, request, "s1") == where  # kept as it is
    assert paging.retained_page(spark, path, request, "s1", "up", 5)[0].count() == 5
    none = paging.retain({"none": (df.limit(0), ["x", "id"])}, path, request, "s3")
    assert none != where and paging.retained_page(spark, path, request, "s3", "none")[1] is None


def test_configured_seeds_keep_their_order(spark):
    requests = spark.createDataFrame([(1, ["b", "none", "a", "b", "two", "no", None]), (2, [])], "plan int, names array<string>")
    known = spark.createDataFrame([("a", 10, True), ("b", 20, True), ("b", 20, True), ("two", 30, True), ("two", 31, True), ("no", 40, False), (None, 50, True)], "name string, target int, eligible boolean")
    got = sorted((r.ordinal, r.name, r.target, r.matches, r.status) for r in ranking.configured_seeds(requests, known).collect())
    assert got == [(0, "b", 20, 1, "selected"), (1, "none", None, 0, "missing"), (2, "a", 10, 1, "selected"), (3, "b", 20, 1, "selected"), (4, "two", None, 2, "ambiguous"), (5, "no", 40, 1, "ineligible"), (6, None, None, 0, "missing")]

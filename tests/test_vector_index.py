"""The stored vector index against exact search: bands, completion, recall, what is left out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import search, vector_index

KIND = "item long, vector array<float>"


def clusters(seed, groups=30, size=20, d=24):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, d))
    x = (centers[:, None] + 0.25 * r.normal(size=(groups, size, d))).reshape(-1, d)
    return [(i, [float(v) for v in row]) for i, row in enumerate(x * r.uniform(0.1, 9, (len(x), 1)))]


def rows(df):
    return sorted((r.query, r.target, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = spark.createDataFrame(clusters(1), KIND).repartition(5)
    path = f"file://{tmp_path_factory.mktemp('index')}/v"
    vector_index.write(df, path)
    return df, vector_index.Index(spark, path), path


def test_index_is_exact(stored):
    df, index, _ = stored
    asked = df.filter("item % 20 = 0")
    exact = rows(search.knn(asked, df, 7))
    assert rows(index.nearest(asked, 7, 2)) == exact
    assert rows(index.nearest(asked, 7, 1)) == exact
    every = rows(search.knn(asked, df, 10_000, floor=0.6))
    assert every and rows(index.within(asked, 0.6)) == every


def test_recall_over_a_small_share_of_cells(stored):
    df, index, _ = stored
    asked = df.filter("item % 20 = 0")
    got = index.recall(asked, search.knn(asked, df, 7), 7, 3).first()
    assert got.recall >= 0.95 and got.cells <= 0.15 and got.rows <= 0.3
    assert index.recall(asked, search.knn(asked, df, 7), 7, len(index.cells)).first().recall == 1.0


def test_every_row_is_in_one_cell_in_order(spark, stored):
    df, index, path = stored
    assert index.rows.count() == index.rows.select("item").distinct().count() == df.count() == int(index.n.sum())
    one = spark.read.parquet(f"{path}/vectors").filter("bucket = 3")
    assert {r.cell % vector_index.BUCKETS for r in one.select("cell").collect()} <= {3}


def test_what_has_no_direction_is_left_out(spark, tmp_path):
    odd = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [1.0]), (7, []), (8, [0.6, 0.8]), (9, [1.0, None]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(odd, KIND)
    vector_index.write(df, f"file://{tmp_path}/v", cells=2)
    index = vector_index.Index(spark, f"file://{tmp_path}/v")
    assert sorted(r.item for r in index.rows.select("item").collect()) == [1, 8, 10]
    got = index.nearest(df.filter("item in (1, 2)"), 5, 1).collect()
    assert [(r.query, r.target, round(r.score, 6), r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 8, 0.6, 1), (1, 10, -1.0, 2)]
    with pytest.raises(ValueError):
        vector_index.write(df.filter("item = 3"), f"file://{tmp_path}/w")


def test_blocks_agree_with_every_pair(spark):
    """Copies tie exactly, and pairs without a cosine come last, as where every pair is a row; no row is a pair any more."""
    odd = [(900, [0.0] * 24), (901, None), (902, [math.nan] * 24), (903, [1.0]), (904, [])]
    data = clusters(5, groups=6, size=15)
    data += [(200 + i, v) for i, v in data[:40]] + [(300 + i, v) for i, v in data[:40]] + odd
    df = spark.createDataFrame(data, KIND).repartition(3)
    q = df.filter("item % 20 = 0 or item > 900")
    pairs = q.select(F.col("item").alias("query"), F.col("vector").alias("qv")).crossJoin(df.select(F.col("item").alias("target"), F.col("vector").alias("tv"))).filter("query <> target")
    plain = search._ranked_best(pairs.select("query", "target", V.cosine(F.col("qv"), F.col("tv")).alias("score")), 4)
    every = lambda d: sorted((r.query, r["rank"], r.target, r.score) for r in d.collect())
    got = search.knn(q, df, 4)
    assert every(got) == every(plain)
    assert "FlatMapCoGroupsInArrow" in search.knn(q, df, 4, 0.5)._jdf.queryExecution().executedPlan().toString()
    few = df.filter("item in (3, 203, 900, 901, 903)")
    some = search.knn(q.filter("item = 0"), few, 4).orderBy("rank").collect()
    assert [(r.target, r.score is None) for r in some] == [(3, False), (203, False), (900, True), (901, True)]


def test_projection_makes_no_row_a_pair(spark):
    df = spark.createDataFrame(clusters(6, groups=8, size=12), KIND)
    q = df.filter("item % 20 = 0")
    got = search.projection_losses(q, df, 8, 3)
    pairs = search._blocks_best(q, df, 3, -1.0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in pairs and "CartesianProduct" not in pairs and "NestedLoop" not in pairs
    data = {r.item: np.array(r.vector, float) for r in df.collect()}
    unit = lambda x: x / np.linalg.norm(x)
    want = set()
    for a in (i for i in data if i % 20 == 0):
        best = lambda n: sorted((i for i in data if i != a), key=lambda i: -unit(data[a][:n]) @ unit(data[i][:n]))[:3]  # noqa: B023, E731
        small = best(8)
        want |= {(a, i, r, i in small) for r, i in enumerate(best(24), 1)}
    assert {tuple(r) for r in got.select("query", "target", "rank", "found").collect()} == want


def test_cells_meet_their_bands_as_matrices(stored, monkeypatch):
    """No row is a pair of vectors; large cells are cut into pieces."""
    df, index, _ = stored
    asked = df.filter("item % 20 = 0")
    for pieces in (vector_index.CELL_ROWS, 7):
        monkeypatch.setattr(vector_index, "CELL_ROWS", pieces)
        got = index.within(asked, 0.6)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
        assert rows(got) == rows(search.knn(asked, df, 10_000, floor=0.6))
        assert rows(index.nearest(asked, 7, 2)) == rows(search.knn(asked, df, 7))


def test_best_between_labels(spark):
    data = [(i, i % 7 if i % 11 else None, v) for i, v in clusters(8, groups=9, size=11)] + [(500, 9, [0.0] * 24), (501, 9, None)]
    df = spark.createDataFrame(data, "item long, label long, vector array<float>")
    got = search.best_between(df, df)
    pairs = df.select(F.col("label").alias("a"), F.col("vector").alias("qv")).join(df.select(F.col("label").alias("b"), F.col("vector").alias("tv")), F.expr("a < b"))
    plain = pairs.groupBy("a", "b").agg(F.max(V.cosine(F.col("qv"), F.col("tv"))).alias("score"))
    every = lambda d: sorted((r.a, r.b, r.score is None, r.score or 0) for r in d.collect())
    assert every(got) == every(plain) and got.filter("score is null").count() == 7
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_a_projection_computes_its_norm_once_a_row(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0, 5.0]), (2, [0.0, 0.0, 1.0]), (3, []), (4, None), (5, [float("inf"), 1.0])], "item long, vector array<float>")
    out = df.select("item", V.project_prefix(F.col("vector"), 2).alias("p"), V.norm(F.col("vector")).alias("n"))
    for call, times in ((V.project_prefix(F.col("vector"), 2), 1), (V.cosine(F.col("vector"), F.col("vector")), 3)):
        plan = df.select(call.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(") == times  # one sum of products each
    got = {r.item: (r.p, r.n) for r in out.collect()}
    assert got[1] == (pytest.approx([0.6, 0.8]), pytest.approx(math.sqrt(50)))
    assert got[2] == ([None, None], 1.0) and got[3] == ([], None) and got[4] == (None, None) and got[5] == ([None, None], None)


def test_a_query_is_sent_once_to_a_tile(stored, monkeypatch):
    """Not once for each cell it asks: the cells are bits. Tiles of any size give the same, also where a query asks a few cells."""
    df, index, _ = stored
    asked = df.filter("item % 20 = 0")
    exact, every = rows(search.knn(asked, df, 7)), rows(search.knn(asked, df, 10_000, floor=0.6))
    sent = index.within(asked, -1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "cells" in sent and "FlatMapCoGroupsInArrow" in sent
    for cells, queries, batch in ((32_768, 3, 1 << 20), (40, 16_384, 50)):
        for name, size in (("CELL_ROWS", cells), ("QUERY_ROWS", queries), ("BATCH", batch)):
            monkeypatch.setattr(vector_index, name, size)
        assert rows(index.within(asked, 0.6)) == every
        assert rows(index.nearest(asked, 7, 2)) == exact
    met = index.met(asked, 3).toPandas()
    assert set(met["cells"]) == {3} and len(met) == 30 and met["rows"].between(3, int(index.n.sum())).all()


def test_tiles_hold_runs_of_cells():
    first, pieces, starts = vector_index._tiles(np.array([3, 4, 2, 21, 1, 9, 1]), 9)
    assert first.tolist() == [0, 0, 0, 1, 4, 5, 6] and pieces.tolist() == [1, 1, 1, 3, 1, 1, 1] and starts.tolist() == [0, 3, 3, 3, 4, 5, 6]

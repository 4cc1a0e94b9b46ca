"""Strong components against a plain search, and how many rounds chains take."""

import random

import pytest

from tessera.operators import graph


def plain(arcs, n):
    out = {}
    for a, b in arcs:
        out.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    to = {x: reach(x) for x in range(n)}
    return {x: min(y for y in to[x] if x in to[y]) for x in range(n)}


def found(spark, arcs, n):
    rows = graph.strong_components(spark.createDataFrame(arcs, "src long, dst long"), spark.range(n).withColumnRenamed("id", "node")).collect()
    assert len(rows) == n
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 40, 45), (2, 40, 70), (3, 60, 200), (4, 30, 0)])
def test_components_of_random_graphs(spark, seed, n, m):
    r = random.Random(seed)
    arcs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + ([(5, 5)] if m else [])
    assert found(spark, arcs, n) == plain(arcs, n)


def test_chains_and_circles(spark):
    ring = lambda at, k: [(at + i, at + (i + 1) % k) for i in range(k)]
    arcs = ring(0, 1) + ring(1, 2) + ring(3, 17) + [(20 + i, 21 + i) for i in range(10)] + [(19, 20), (30, 3), (31, 32), (32, 31), (31, 33), (33, 34), (34, 31), (34, 35)]
    r = random.Random(5)
    names = r.sample(range(40), 40)
    arcs = [(names[a], names[b]) for a, b in arcs]
    assert found(spark, arcs, 40) == plain(arcs, 40)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A component of 10,000 nodes in a ring, with a tail as long and a short cut: tables written, not steps walked."""
    written, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: written.append(1) or cut(df))
    n = 10_000
    arcs = [(i, (i + 1) % n) for i in range(n)] + [(n + i, n + i + 1) for i in range(n - 1)] + [(0, n), (0, n // 2)]
    got = found(spark, arcs, 2 * n)
    assert all(got[i] == 0 for i in range(n)) and all(got[i] == i for i in range(n, 2 * n)) and len(written) < 40


def test_what_waits_for_nobody_leaves_the_schedule(spark, monkeypatch):
    arcs = [(i, 0) for i in range(100, 150)] + [(i + 1, i) for i in range(10)] + [(9, 2)]
    parts = spark.range(151).selectExpr("id AS node", "id AS component").filter("node < 12 or node > 99")
    rows, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: rows.append(cut(df)) or rows[-1])
    got = {r.component: r.level for r in graph.callee_first(spark.createDataFrame(arcs, "src long, dst long"), parts).collect()}
    assert got == {i: i for i in range(11)} | {11: 0, 150: 0} | {i: 1 for i in range(100, 150)}
    assert [r.count() for r in rows if r.columns == ["p", "q"]] == [61, 10, 9, 7, 6, 5, 4, 3, 2, 1, 0]

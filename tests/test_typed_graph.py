"""Typed multigraphs: reachability for many starts against plain search, traversals against a queue."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import typed_graph as G

ARCS = "arc long, src long, dst long, role string, definite boolean"


def some_graph(seed, n=40, m=90):
    r = random.Random(seed)
    arcs = [(i, r.randrange(n), r.randrange(n), r.choice(["call", "define", "bind"]), r.random() < 0.5) for i in range(m)]
    return arcs + [(m + i, a[1], a[2], "call", True) for i, a in enumerate(arcs[:10])]  # parallel ones


def frames(spark, arcs, n=40):
    return G.snapshot(spark.createDataFrame([(i, i % 3) for i in range(n)], "node long, kind long"), spark.createDataFrame(arcs, ARCS))


def plain(arcs, start, direction, roles):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for _, s, d, role, _ in arcs:
            a, b = (s, d) if direction == "out" else (d, s)
            if a == x and b not in seen and (roles is None or role in roles):
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize(("seed", "direction", "roles"), [(1, "out", None), (2, "in", ["call"]), (3, "out", ["define", "bind"])])
def test_reach_of_all_nodes(spark, seed, direction, roles):
    arcs = some_graph(seed, 100, 120)
    g = frames(spark, arcs, 100)  # a hundred starts: two words
    words, places = G.reach_words(g, g.vertices, direction, roles)
    assert words.count() <= 200 and words.select("node", "word").distinct().count() == words.count()
    got = {(r.start, r.node) for r in G.reachable(g, g.vertices, direction, roles, F.col("kind") != 1).collect()}
    assert got == {(s, x) for s in range(100) for x in plain(arcs, s, direction, roles) if x % 3 != 1}
    assert {r.node for r in G.selected(g, g.vertices.filter("node in (3, 4)")).collect()} == plain(arcs, 3, "out", None) | plain(arcs, 4, "out", None)


def test_snapshots_refuse_what_does_not_fit(spark):
    v = spark.createDataFrame([(1, 0), (2, 0)], "node long, kind long")
    for arcs in ([(1, 1, 3, "call", True)], [(1, 3, 1, "call", True)], [(1, 1, 2, "call", True), (1, 2, 1, "call", True)]):
        with pytest.raises(G.Refused):
            G.snapshot(v, spark.createDataFrame(arcs, ARCS))
    with pytest.raises(G.Refused):
        G.snapshot(v.union(v), spark.createDataFrame([], ARCS))
    g = G.snapshot(v, spark.createDataFrame([(1, 1, 2, "call", True), (2, 1, 2, "call", True)], ARCS))
    assert g.outgoing(v.filter("node = 1")).count() == 2 and g.incoming(v.filter("node = 1")).count() == 0
    with pytest.raises(G.Refused):
        G.reachable(g, spark.createDataFrame([(9,)], "node long"))
    with pytest.raises(G.Refused):
        G.Bounds(depth=0)


def by_queue(arcs, seed, bounds, boundary, unresolved):
    """The traversal with a queue: (reached, open, stop, vertices, arcs)."""
    out = {}
    for a in sorted(arcs):
        out.setdefault(a[1], []).append(a)
    depth, parent, queue, into, done, used, stop, deep = {seed: 0}, {}, deque([seed]), {}, [], 0, None, False
    while queue and not stop:
        x = queue.popleft()
        if depth[x] >= bounds.depth:
            deep |= bool(out.get(x)) or x in unresolved
            continue
        for a in out.get(x, []):
            if used == bounds.arcs:
                stop = "arcs"
                break
            used += 1
            if a[2] not in boundary and a[2] not in depth:
                if len(depth) >= bounds.vertices:
                    stop = "vertices"
                    break
                depth[a[2]], parent[a[2]] = depth[x] + 1, a
                queue.append(a[2])
            into.setdefault(a[2], []).append(a)
        else:
            done.append(x)

    def way(x):
        return (*way(parent[x][1]), parent[x][0]) if x in parent else ()

    reached = set()
    for target, steps in into.items():
        if target == seed:
            continue
        least = min(depth[a[1]] + 1 for a in steps)
        finals = sorted(a for a in steps if depth[a[1]] + 1 == least)
        direct = target not in boundary and least == 1 and any(a[4] for a in finals)
        first = next(a for a in finals if a[4]) if direct else finals[0] if target in boundary else parent[target]
        chosen = [first, *[a for a in finals if a != first][: bounds.witnesses - 1]]
        kind = "boundary" if target in boundary else "direct" if direct else "path"
        reached |= {(target, kind, least, i, (*way(a[1]), a[0]), len(finals) > bounds.witnesses) for i, a in enumerate(chosen, 1)}
    opened = {(e, depth[x] + 1, way(x)) for x in done for e in unresolved.get(x, [])}
    return reached, opened, stop or ("depth" if deep else None), len(depth), used


@pytest.mark.parametrize("bounds", [G.Bounds(3, 1000, 1000, 2), G.Bounds(9, 1000, 1000, 1), G.Bounds(4, 6, 1000, 3), G.Bounds(4, 1000, 11, 3), G.Bounds(2, 4, 5, 2), G.Bounds(3, 5, 0, 2)])
def test_traversals_agree_with_a_queue(spark, bounds):
    arcs = some_graph(bounds.depth + bounds.vertices + bounds.arcs)
    boundary, unresolved, seeds = {3, 5, 8}, {1: [10, 11], 7: [12], 20: [13]}, [0, 1, 2, 7, 39]
    got = G.traverse(
        spark.createDataFrame(arcs, ARCS), spark.createDataFrame([(s,) for s in seeds], "seed long"), bounds, spark.createDataFrame([(b, "dependency") for b in boundary], "node long, boundary string"),
        spark.createDataFrame([(x, e) for x, es in unresolved.items() for e in es], "node long, event long"),
    )
    reached, opened, ended = got.reached.collect(), got.open.collect(), {r.seed: r for r in got.ended.collect()}
    for s in seeds:
        want = by_queue(arcs, s, bounds, boundary, unresolved)
        assert {(r.target, r.kind, r.depth, r.witness, tuple(r.path), r.omitted) for r in reached if r.seed == s} == want[0]
        assert {(r.event, r.depth, tuple(r.path)) for r in opened if r.seed == s} == want[1]
        assert (ended[s].stop, ended[s].vertices, ended[s].arcs) == want[2:]


def test_a_seed_is_no_boundary(spark):
    with pytest.raises(G.Refused):
        G.traverse(spark.createDataFrame([], ARCS), spark.createDataFrame([(1,)], "seed long"), G.Bounds(), spark.createDataFrame([(1, "x")], "node long, boundary string"))


def test_a_long_way_does_not_write_all_that_is_known_each_round(spark, monkeypatch):
    arcs = [(i, i, i + 1, "call", True) for i in range(30)] + [(30, 30, 5, "call", True)]
    g = frames(spark, arcs, 400)
    written, cut = [], G._cut
    monkeypatch.setattr(G, "_cut", lambda df: written.append(cut(df)) or written[-1])
    got = {(r.start, r.node) for r in G.reachable(g, g.vertices).collect()}
    assert got == {(s, x) for s in range(400) for x in plain(arcs, s, "out", None)}
    assert sum(w.count() for w in written) < 5_000  # 400 places of starts, 400 rows of nodes, at most 31 a round move


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    """Whatever Spark takes their size for; small ones that were counted are."""
    arcs = some_graph(4, 100, 120)
    g = frames(spark, arcs, 100)
    want = {(s, x) for s in range(100) for x in plain(arcs, s, "out", None) if x % 3 == 1}
    cuts, cut = [], G._cut
    monkeypatch.setattr(G, "_cut", lambda df: cuts.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    for most in (0, 100_000):
        monkeypatch.setattr(G, "SMALL", most)
        cuts.clear()
        got = G.reachable(g, g.vertices, "out", None, F.col("kind") == 1)
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert any("BroadcastHashJoin" in plan for plan in cuts[3:]) == bool(most)
        assert {tuple(r) for r in got.collect()} == want

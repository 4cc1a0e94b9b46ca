"""Concepts by branches against enumeration over all sets of attributes."""

import itertools
import random

import pytest

from tessera.operators import concepts as C

KIND = "scope string, object long, attribute string"


def brute(pairs, least):
    objects, attributes = sorted({o for o, _ in pairs}), sorted({a for _, a in pairs})
    out = set()
    for k in range(len(attributes) + 1):
        for want in itertools.combinations(attributes, k):
            extent = tuple(o for o in objects if all((o, a) in pairs for a in want))
            if len(extent) >= least:
                out.add((extent, tuple(a for a in attributes if all((o, a) in pairs for o in extent))))
    return out


@pytest.mark.parametrize(("seed", "least", "steps"), [(1, 2, 20_000), (2, 1, 3), (3, 0, 7), (4, 5, 1)])
def test_all_concepts_of_all_scopes(spark, monkeypatch, seed, least, steps):
    """Tasks that stop after a few sets hand the rest on: nothing is lost or found twice."""
    r = random.Random(seed)
    scopes = {s: {(o, f"a{a}") for o in range(r.randint(1, 14)) for a in range(r.randint(1, 8)) if r.random() < p} for s, p in (("x", 0.6), ("y", 0.3), ("z", 0.95))}
    df = spark.createDataFrame([(s, o, a) for s, pairs in scopes.items() for o, a in pairs] + [("one", 1, "b")] * 3, KIND)
    scopes["one"] = {(1, "b")}
    rows = [(x.scope, tuple(x.objects), tuple(x.attributes), x.support) for x in C.concepts(df, least, steps).collect()]
    assert len(rows) == len(set(rows)) and all(len(o) == n for _, o, _, n in rows)
    assert {x[:3] for x in rows} == {(s, *c) for s, pairs in scopes.items() if pairs for c in brute(pairs, least)}


def test_contexts_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(C, "CONTEXT_BYTES", 0)
    r = random.Random(6)
    pairs = {(o, f"a{a}") for o in range(60) for a in range(7) if r.random() < 0.5}
    got = C.concepts(spark.createDataFrame([("s", o, a) for o, a in pairs], KIND), 2)
    assert {(tuple(x.objects), tuple(x.attributes)) for x in got.collect()} == brute(pairs, 2)
    assert C.concepts(spark.createDataFrame([], KIND)).count() == 0


def test_implications_stop_on_request_only(spark):
    r = random.Random(7)
    df = spark.createDataFrame([("s", o, f"a{a}") for o in range(12) for a in range(9) if r.random() < 0.5], KIND)
    whole = C.implications(df, 1).collect()
    assert whole and not any(x.budget_reached for x in whole)
    part = C.implications(df, 1, 5).collect()
    assert len(part) < len(whole) and all(x.budget_reached for x in part)


def test_implications_see_distinct_rows_whatever_the_objects(spark):
    r = random.Random(8)
    rows = {o: [a for a in range(7) if r.random() < 0.6] for o in range(15)}
    one = spark.createDataFrame([("s", o, f"a{a}") for o, has in rows.items() for a in has], KIND)
    many = one.crossJoin(spark.range(3000)).selectExpr("scope", "object + 100 * id as object", "attribute")
    found = lambda df, least: sorted((tuple(x.premise), tuple(x.conclusion), x.support) for x in C.implications(df, least).collect())
    assert found(many, 3000) == [(p, q, 3000 * n) for p, q, n in found(one, 1)] and len(found(one, 1)) > 1
    assert "collect_set" in C.implications(one)._jdf.queryExecution().optimizedPlan().toString()
    c = C.Context([(0, "a"), (1, "a"), (1, "b")], weights={0: 5, 1: 6})
    assert [c.size(e) for e in (0, 1, 2, 3)] == [0, 5, 6, 11] and c.closed(2) == 3

"""Witness expressions against trying every choice of evidence."""

import itertools
import random

import pytest

from tessera.operators import witness as W

NODES = "case long, node int, parent int, ordinal int, kind string, predicate string, variables array<string>"
LEAVES = f"case long, predicate string, assignment {W.ASSIGNMENT}"


def plain(tree, leaves):
    """(assignments, bound) of a nested expression; leaves: predicate to a list of dictionaries."""
    kind, *rest = tree
    if kind == "leaf":
        return {tuple(sorted(a.items())) for a in leaves.get(rest[0], [])}, len(leaves.get(rest[0], []))
    if kind == "exists":
        got, n = plain(rest[1], leaves)
        return {tuple(kv for kv in a if kv[0] not in rest[0]) for a in got}, n
    parts = [plain(c, leaves) for c in rest[0]]
    if kind == "any":
        return set().union(*(p for p, _ in parts)), sum(n for _, n in parts)
    out, bound = set(), 1
    for _, n in parts:
        bound *= n
    for choice in itertools.product(*(p for p, _ in parts)) if parts else ():
        whole = {}
        if all(whole.setdefault(k, v) == v for a in choice for k, v in a):
            out.add(tuple(sorted(whole.items())))
    return out, bound


def tree_of(r, depth):
    kind = r.choice(["leaf", "all", "any", "exists"]) if depth else "leaf"
    if kind == "leaf":
        return ("leaf", r.choice("pqrs"))
    if kind == "exists":
        return ("exists", [r.choice("xyz")], tree_of(r, depth - 1))
    return (kind, [tree_of(r, depth - 1) for _ in range(r.randint(1, 3))])


def rows_of(case, tree):
    out, todo = [], [(tree, None, 0)]
    while todo:
        t, parent, at = todo.pop()
        node = len(out)
        out.append((case, node, parent, at, t[0], t[1] if t[0] == "leaf" else None, t[1] if t[0] == "exists" else None))
        kids = [t[2]] if t[0] == "exists" else t[1] if t[0] in ("all", "any") else []
        todo += [(c, node, i) for i, c in enumerate(kids)]
    return out


def test_proofs_of_random_expressions(spark):
    r = random.Random(3)
    nodes, leaves, want, bounds = [], [], {}, {}
    for case in range(40):
        tree = tree_of(r, 3)
        found = {p: [{k: r.choice("12") for k in r.sample("xyz", r.randint(0, 2))} for _ in range(r.randint(0, 4))] for p in "pqrs"}
        nodes += rows_of(case, tree)
        leaves += [(case, p, sorted(a.items())) for p, rows in found.items() for a in rows]
        want[case], bounds[case] = plain(tree, found)
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(leaves, LEAVES)
    got = {}
    for x in W.proofs(n, e).collect():
        got.setdefault(x.case, []).append(tuple((kv.key, kv.value) for kv in x.assignment))
    assert all(len(v) == len(set(v)) for v in got.values())
    assert {c: set(v) for c, v in got.items()} == {c: v for c, v in want.items() if v}
    assert {x.case: x.proofs for x in W.proof_bounds(n, e).collect()} == {c: min(b, W.MOST_PROOFS + 1) for c, b in bounds.items()}


def test_evidence_has_to_fit(spark):
    predicates = spark.createDataFrame([(1, "p", "role", ["t", "u"], ["a"], "known", [("k", "v")], [("q", ["yes"])])], f"case long, predicate string, role string, texts array<string>, anchors array<string>, status string, context {W.ASSIGNMENT}, qualifications array<struct<id: string, texts: array<string>>>")
    good = (1, "role", "t", "a", "known", [("k", "v"), ("z", "1")], [("q", "yes"), ("x", "no")])
    rows = [good]
    for i, other in ((0, 2), (1, "else"), (2, "x"), (2, None), (3, "b"), (4, "unknown"), (4, None), (5, [("k", "w")]), (5, None), (6, [("q", "no")]), (6, None)):
        rows.append((*good[:i], other, *good[i + 1 :]))
    evidence = spark.createDataFrame(rows, f"case long, role string, text string, anchor string, status string, context {W.ASSIGNMENT}, qualifications array<struct<id: string, text: string>>")
    assert W.readable(predicates, evidence).count() == 1
    ask = lambda value: spark.createDataFrame([(1, [("z", value)])], f"case long, context {W.ASSIGNMENT}")
    assert W.readable(predicates, evidence, ask("1")).count() == 1 and W.readable(predicates, evidence, ask("2")).count() == 0


@pytest.mark.parametrize(("n", "want"), [(64, ("sufficient", None, 64)), (65, ("inconclusive", "work_bound", 0))])
def test_too_many_proofs_are_told(spark, n, want):
    """64 x 64 proofs are at the bound; one more a side is past it."""
    cases = spark.createDataFrame([(1, "answer", None)], f"case long, intent string, context {W.ASSIGNMENT}")
    predicates = spark.createDataFrame([(1, "p", "r", ["t"], ["a"], None, None, None)], f"case long, predicate string, role string, texts array<string>, anchors array<string>, status string, context {W.ASSIGNMENT}, qualifications array<struct<id: string, texts: array<string>>>")
    evidence = spark.createDataFrame([(1, "r", "t", "a", None, [("k", str(i))], None) for i in range(n)], f"case long, role string, text string, anchor string, status string, context {W.ASSIGNMENT}, qualifications array<struct<id: string, text: string>>")
    nodes = spark.createDataFrame(rows_of(1, ("all", [("leaf", "p"), ("leaf", "p")])), NODES)
    got = W.witnessed(cases, predicates, evidence, nodes).first()
    assert (got.epistemic, got.reason, got.assignments) == want

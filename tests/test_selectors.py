"""Selection predicates of all kinds against facts in plain Python."""

import random

import pytest

from tessera.operators import demand
from tessera.operators import selectors as S

FIELD_VALUES = {"path": [["a"], ["a", "b"]], "owner": [["x"], None], "exact": [True, False], "required": [True, False]}


def world(seed):
    r = random.Random(seed)
    columns = {}
    for relation, cols in S.KINDS.values():
        columns.setdefault(relation, set()).update(cols)
    values = lambda c: FIELD_VALUES.get(c, ["u", "v", None])
    return {rel: [{"entity": r.randrange(12), **{c: r.choice(values(c)) for c in sorted(cols)}} for _ in range(25)] for rel, cols in columns.items()}, values


def ddl(rows):
    kind = lambda c: "long" if c == "entity" else "array<string>" if c in ("path", "owner") else "boolean" if c in ("exact", "required") else "string"
    return ", ".join(f"`{c}` {kind(c)}" for c in rows[0])


def holds(tree, entity, facts):
    op, *rest = tree
    if op in ("all", "any"):
        return (all if op == "all" else any)(holds(t, entity, facts) for t in rest)
    if op == "not":
        return not holds(rest[0], entity, facts)
    relation, cols = S.KINDS[op]
    return any(f["entity"] == entity and all(f[c] == rest[0][c] for c in cols) for f in facts[relation])


def test_every_kind_and_trees_of_them(spark):
    facts, values = world(1)
    relations = {k: spark.createDataFrame([tuple(r.values()) for r in rows], ddl(rows)) for k, rows in facts.items()}
    people = spark.createDataFrame([(i,) for i in range(12)] + [(3,)], "entity long")
    members, r = dict.fromkeys(demand.DOMAINS, people), random.Random(2)

    def predicate(kind):
        fields = {c: r.choice(values(c)) for c in S.KINDS[kind][1]}
        return (kind, fields | ({"domain": "relationships"} if kind == "facet_membership" else {}))

    assert len(S.KINDS) == 29
    by = {}
    for kind in S.KINDS:
        t = predicate(kind)
        got = S.selected(t, members, relations)
        assert sorted(x.entity for x in got.collect()) == [e for e in range(12) if holds(t, e, facts)]
        by.setdefault(next(iter(S.domains(t))), []).append(kind)
    for kinds in by.values():
        for _ in range(2):
            leaf = lambda: predicate(r.choice(kinds))  # noqa: B023, E731
            t = ("any", ("all", leaf(), ("not", leaf())), ("not", ("any", leaf(), leaf())), leaf())
            assert sorted(x.entity for x in S.selected(t, members, relations).collect()) == [e for e in range(12) if holds(t, e, facts)]


def test_what_is_refused(spark):
    members = {"scenarios": spark.createDataFrame([(1,)], "entity long")}
    for bad in [("nothing", {}), ("scenario_intent", {}), ("scenario_intent", {"intent": 1, "more": 2}), ("all", ("scenario_intent", {"intent": 1}), ("source_alignment", {"exact": True})), ("scenario_intent", {"intent": 1}), ("source_alignment", {"exact": True}), ("all",)]:
        with pytest.raises(S.Refused):
            S.selected(bad, members, {})
    assert S.domains(("deployment_declaration", {"field": "launch", "name": "x"})) == {"source_artifacts"}


def test_a_selection_shuffles_its_domain_once(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "a"), (2, None), (None, "a")], "entity long, exception string")
    members = {"public_exposures": spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "entity long")}
    at = lambda x: ("behavioral_raises", {"exception": x})
    got = lambda tree: S.selected(tree, members, {"raises": facts})
    assert sorted((r.entity for r in got(("all", at("a"), ("not", at(None)))).collect()), key=str) == [1]
    assert sorted((r.entity for r in got(("not", at("a"))).collect()), key=str) == [3, None]
    assert got(("all", at("a"), ("any",))).count() == 0 and got(("any", at("b"), ("all",))).count() == 4
    plan = got(("any", ("all", at("a"), ("not", at(None))), ("not", ("any", at("b"), at("c")))))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1

"""Substitution over a relation of terms against a recursive one."""

import hashlib
import random

import pytest

from tessera.operators import terms as T

TERMS, BINDINGS, ROOTS = "term string, kind string, name string, args array<string>", "env long, name string, term string", "env long, root string"


def tid(kind, name, args=()):
    return hashlib.sha256(f"{kind}:{len(name.encode())}:{name}:{len(args)}:{','.join(args)}".encode()).hexdigest()[:32]


class Pool:
    def __init__(self):
        self.rows = {}

    def add(self, kind, name, args=()):
        key = tid(kind, name, args)
        self.rows[key] = (key, kind, name, list(args))
        return key


def plain(pool, term, env):
    """(new id, unbound names) where nothing is circular."""
    _, kind, name, args = pool.rows[term]
    if kind == "var":
        return plain(pool, env[name], env) if name in env else (term, {name})
    parts = [plain(pool, a, env) for a in args]
    return tid("con", name, [p[0] for p in parts]), set().union(*(p[1] for p in parts))


def test_many_environments_at_a_time(spark):
    r = random.Random(4)
    pool, known = Pool(), []
    names = ["A", "B", "C", "é"]
    known += [pool.add("var", n) for n in names] + [pool.add("con", n) for n in ("int", "str")]
    for _ in range(40):
        known.append(pool.add("con", r.choice(["list", "pair", "f"]), [r.choice(known) for _ in range(r.randint(1, 3))]))
    ground = lambda t, below: all(n < below for n in plain(pool, t, {})[1])
    envs = {e: {n: r.choice([t for t in known if ground(t, n)]) for n in r.sample(names, r.randint(0, 3))} for e in range(15)}  # only to lesser variables: no circles
    roots = {(e, r.choice(known[10:])) for e in envs for _ in range(3)}
    got, all_, edges = T.substituted(spark.createDataFrame(list(pool.rows.values()), TERMS).repartition(3), spark.createDataFrame([(e, n, t) for e, b in envs.items() for n, t in b.items()], BINDINGS), spark.createDataFrame(list(roots), ROOTS))
    rows = {(x.env, x.root): (x.term, x.status) for x in got.collect()}
    have = {x.term: x for x in all_.collect()}
    missing = {}
    for x in edges.collect():
        assert x.reason == "unbound_variable"
        missing.setdefault((x.env, x.root), set()).add(have[x.term].name)
    assert len(rows) == len(roots)
    for e, root in roots:
        want, unbound = plain(pool, root, envs[e])
        assert rows[e, root] == (want, "resolved" if not unbound else "partial" if envs[e] else "unknown") and missing.get((e, root), set()) == unbound
        todo = [want]
        while todo:  # all of the new term is there
            todo += have[todo.pop()].args
    assert all(tid(x.kind, x.name, x.args) == k for k, x in have.items())


def test_circles_stay_as_they_are(spark):
    pool = Pool()
    a, b, c, i = pool.add("var", "A"), pool.add("var", "B"), pool.add("var", "C"), pool.add("con", "int")
    la, lb, lc = (pool.add("con", "list", [x]) for x in (a, b, c))
    both = pool.add("con", "pair", [la, lc])
    got, all_, edges = T.substituted(spark.createDataFrame(list(pool.rows.values()), TERMS), spark.createDataFrame([(1, "A", lb), (1, "B", la), (1, "C", i), (2, "A", a)], BINDINGS), spark.createDataFrame([(1, both), (1, lc), (2, la)], ROOTS))
    text = {x.term: x.text for x in T.spelled(all_).collect()}
    assert sorted((x.env, text[x.root], text[x.term], x.status) for x in got.collect()) == [(1, "list(C)", "list(int)", "resolved"), (1, "pair(list(A), list(C))", "pair(list(A), list(int))", "partial"), (2, "list(A)", "list(A)", "partial")]
    assert {(x.env, x.reason) for x in edges.collect()} == {(1, "recursive"), (2, "recursive")}


def test_refusals(spark):
    pool = Pool()
    a, i = pool.add("var", "A"), pool.add("con", "int")
    t = spark.createDataFrame(list(pool.rows.values()), TERMS)
    for binds, roots in (([(1, "A", i), (1, "A", a)], [(1, a)]), ([(1, "A", "none")], [(1, a)]), ([(1, "A", i)], [(1, "none")])):
        with pytest.raises(T.Refused):
            T.substituted(t, spark.createDataFrame(binds, BINDINGS), spark.createDataFrame(roots, ROOTS))
    empty = T.substituted(t, spark.createDataFrame([], BINDINGS), spark.createDataFrame([], ROOTS))
    assert empty[0].count() == 0 and empty[1].count() == 2


def test_environments_that_bind_alike_are_one_class(spark, monkeypatch):
    pool = Pool()
    a, b, i, s = pool.add("var", "A"), pool.add("var", "B"), pool.add("con", "int"), pool.add("con", "str")
    pair = pool.add("con", "pair", [a, b])
    binds = [(e, "A", i if e % 2 else s) for e in range(1, 60)] + [(e, "B", i) for e in range(1, 60) if e % 3 == 0] + [(7, "A", i), (None, "A", i)]
    worked, plain_ = [], T._substituted
    monkeypatch.setattr(T, "_substituted", lambda t, b, r: worked.append((b.count(), r.count())) or plain_(t, b, r))
    got, all_, edges = T.substituted(spark.createDataFrame(list(pool.rows.values()), TERMS), spark.createDataFrame(binds, BINDINGS), spark.createDataFrame([(e, pair) for e in [*range(60), None]], ROOTS))
    text = {x.term: x.text for x in T.spelled(all_).collect()}
    want = {e: (f"pair({'int' if e % 2 else 'str'}, {'B' if e % 3 else 'int'})", "partial" if e % 3 else "resolved") for e in range(1, 60)}
    assert {x.env: (text[x.term], x.status) for x in got.collect()} == want | {0: ("pair(A, B)", "unknown"), None: ("pair(int, B)", "partial")}
    open_ = [(x.env, text[x.term]) for x in edges.collect()]
    assert sorted(open_, key=str) == sorted([(e, "B") for e in range(1, 60) if e % 3] + [(0, "A"), (0, "B"), (None, "B")], key=str)
    assert worked == [(6, 5)]  # four ways to bind (two bind both variables), and one that binds nothing

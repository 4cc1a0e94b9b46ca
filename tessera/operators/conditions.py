"""Boolean conditions as reduced ordered decision diagrams with a budget; beyond it the answer is unknown."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ATOMS, MAX_NODES, MAX_PAIRS = 128, 50_000, 1_000_000


class Boundary(Exception):
    """The budget of nodes, of combinations or of depth is spent: the result is unknown, never false."""


class Diagrams:
    """Hash-consed diagrams over atoms in the order of their names; 0 and 1 are the constants."""

    def __init__(self, max_nodes: int = MAX_NODES):
        self.nodes: list[tuple[str, int, int]] = [("", 0, 0), ("", 1, 1)]
        self.ids: dict[tuple[str, int, int], int] = {}
        self.memo: dict[tuple, int] = {}
        self.max_nodes = max_nodes

    def node(self, atom: str, low: int, high: int) -> int:
        if low == high:
            return low
        key = (atom, low, high)
        if key not in self.ids:
            if len(self.nodes) >= self.max_nodes:
                raise Boundary
            self.ids[key] = len(self.nodes)
            self.nodes.append(key)
        return self.ids[key]

    def atom(self, name: str) -> int:
        return self.node(name, 0, 1)

    def choose(self, f: int, g: int, h: int) -> int:
        """if f then g else h."""
        if f == 1 or g == h:
            return g
        if f == 0:
            return h
        if g == 1 and h == 0:
            return f
        key = (f, g, h)
        if key not in self.memo:
            if len(self.memo) >= MAX_PAIRS:
                raise Boundary
            top = min(self.nodes[x][0] for x in key if x > 1)
            part = lambda x, k: self.nodes[x][k] if x > 1 and self.nodes[x][0] == top else x
            self.memo[key] = self.node(top, self.choose(*(part(x, 1) for x in key)), self.choose(*(part(x, 2) for x in key)))
        return self.memo[key]

    def both(self, f: int, g: int) -> int:
        return self.choose(f, g, 0)

    def either(self, f: int, g: int) -> int:
        return self.choose(f, 1, g)

    def negated(self, f: int) -> int:
        return self.choose(f, 0, 1)

    def substituted(self, f: int, replacement: Callable[[str], int]) -> int:
        """All atoms replaced at once."""
        done: dict[int, int] = {0: 0, 1: 1}

        def walk(x: int) -> int:
            if x not in done:
                atom, low, high = self.nodes[x]
                done[x] = self.choose(replacement(atom), walk(high), walk(low))
            return done[x]

        return walk(f)

    def restricted(self, f: int, values: dict[str, bool]) -> int:
        return self.substituted(f, lambda a: int(values[a]) if a in values else self.atom(a))

    def exists(self, f: int, atoms: list[str]) -> int:
        for a in atoms:
            f = self.either(self.restricted(f, {a: False}), self.restricted(f, {a: True}))
        return f

    def implies(self, f: int, g: int) -> bool:
        return self.both(f, self.negated(g)) == 0

    def compatible(self, f: int, g: int) -> bool:
        return self.both(f, g) != 0

    def terms(self, f: int, most: int) -> tuple[list[list[str]], bool]:
        """Up to `most` cubes, and whether there are more. A negated atom is written with !."""
        out: list[list[str]] = []

        def walk(x: int, cube: list[str]) -> bool:
            if x == 0:
                return True
            if x == 1:
                if len(out) == most:
                    return False
                out.append(cube)
                return True
            atom, low, high = self.nodes[x]
            return walk(low, [*cube, "!" + atom]) and walk(high, [*cube, atom])

        whole = walk(f, [])
        return out, not whole

    def build(self, tree) -> int:
        """From JSON: an atom's name, true, false, or ["and"|"or", ...] and ["not", x]."""
        if isinstance(tree, bool):
            return int(tree)
        if isinstance(tree, str):
            return self.atom(tree)
        op, *args = tree
        parts = [self.build(a) for a in args]
        if op == "not":
            return self.negated(parts[0])
        out = int(op == "and")
        for p in parts:
            out = self.both(out, p) if op == "and" else self.either(out, p)
        return out


def _atoms(tree) -> set[str]:
    if isinstance(tree, bool):
        return set()
    return {tree} if isinstance(tree, str) else set().union(*(_atoms(a) for a in tree[1:]))


def _decide(a: str | None, b: str | None, question: str) -> bool | None:
    if a is None or b is None:
        return None
    try:
        x, y = json.loads(a), json.loads(b)
        if len(_atoms(x) | _atoms(y)) > MAX_ATOMS:
            return None
        d = Diagrams()
        return getattr(d, question)(d.build(x), d.build(y))
    except (Boundary, RecursionError):
        return None


def _decided(a: pd.Series, b: pd.Series, question: str) -> pd.Series:
    """Answers by row; each distinct pair of a batch is decided once."""
    pairs = list(zip(a, b, strict=True))
    known = {p: _decide(*p, question) for p in set(pairs)}
    return pd.Series([known[p] for p in pairs], dtype=object)


@F.pandas_udf(T.BooleanType())
def implies(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether condition a (JSON) implies b; null where that is unknown."""
    return _decided(a, b, "implies")


@F.pandas_udf(T.BooleanType())
def compatible(a: pd.Series, b: pd.Series) -> pd.Series:
    return _decided(a, b, "compatible")


def rendered(most: int):
    @F.pandas_udf(T.StructType([T.StructField("terms", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("truncated", T.BooleanType())]))
    def render(a: pd.Series) -> pd.DataFrame:
        rows = []
        for x in a:
            d = Diagrams()
            try:
                rows.append(d.terms(d.build(json.loads(x)), most) if x is not None else (None, None))
            except (Boundary, RecursionError):
                rows.append((None, True))
        return pd.DataFrame(rows, columns=["terms", "truncated"])

    return render


def pareto(rows, by: str, a: str, b: str):
    """Rows of each key that no other row of it beats in both measures (smaller is better); equal rows stay.

    One sorted pass: a row is beaten if a smaller `a` had a `b` as small, or an equal `a` a smaller `b`.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(by).orderBy(a).rangeBetween(Window.unboundedPreceding, -1)
    equal = Window.partitionBy(by, a)
    out = rows.withColumn("__m", F.min(b).over(before)).withColumn("__e", F.min(b).over(equal))
    return out.filter((F.col("__m").isNull() | (F.col(b) < F.col("__m"))) & (F.col(b) == F.col("__e"))).drop("__m", "__e")


#: A narrowing graph's leaves, and how deep and how large it may be; beyond that its value is unknown.
ALWAYS, NEVER, MAX_DEPTH, MAX_VISITED = -1, -2, 256, 4096
_UNKNOWN = "\0unknown"


def _in_order(nodes: list, root: int) -> list[tuple[int, int]]:
    """(node, level) of the inner nodes under root, parents first; a level is the longest way from the root. What lies on a circle is left out."""
    inner = lambda x: [w for w in nodes[x][1:] if w >= 0]
    parents, todo = {root: 0}, [root]
    while todo:
        for w in inner(todo.pop()):
            if w not in parents:
                todo.append(w)
            parents[w] = parents.get(w, 0) + 1
    level, out = {root: 0}, []
    ready = [root] if not parents[root] else []
    for x in ready:  # grows
        out.append((x, level[x]))
        for w in inner(x):
            level[w] = max(level.get(w, 0), level[x] + 1)
            parents[w] -= 1
            if not parents[w]:
                ready.append(w)
    return sorted(out, key=lambda xl: (xl[1], xl[0]))


def _narrowed(graph: str | None, most: int) -> tuple:
    if graph is None:
        return None, None, None, None, None
    g = json.loads(graph)
    d, values = Diagrams(), {}

    def value(way: int, level: int) -> int:
        if level > MAX_DEPTH:
            return d.atom(_UNKNOWN)
        known = {ALWAYS: 1, NEVER: 0}.get(way, values.get(way))
        return d.atom(_UNKNOWN) if known is None else known

    try:
        # The first MAX_VISITED nodes are decided, children before their parents: by the time of a node all its ways have values.
        order = _in_order(g["nodes"], g["root"]) if g["root"] >= 0 else []
        for x, level in reversed(order[:MAX_VISITED]):
            atom, *ways = g["nodes"][x]
            yes, either, no = (value(w, level + 1) for w in ways)
            values[x] = d.either(either, d.choose(d.atom(atom), yes, no))
        f = value(g["root"], 0)
        unknown = d.exists(f, [_UNKNOWN]) != f
        terms, more = d.terms(f, most)
    except Boundary:
        return None, True, None, True, bool(g.get("lost"))
    always = None if f > 1 else bool(f)
    return (None if unknown else terms), more, always, unknown, bool(g.get("lost"))


def narrowed(most: int):
    """Lower a narrowing graph, JSON {"nodes": [[atom, if true, if uncertain, if false], ...], "root": n, "lost": bool}, to a condition.

    A leaf is ALWAYS or NEVER. The uncertain way is a disjunct of its own, not an unknown verdict: it holds whatever the
    atom's value. `always` is true, false, or null where the atoms decide; a graph that lost precision is approximated.
    """

    fields = [T.StructField("terms", T.ArrayType(T.ArrayType(T.StringType()))), *[T.StructField(n, T.BooleanType()) for n in ("truncated", "always", "unknown", "approximated")]]

    @F.pandas_udf(T.StructType(fields))
    def lower(graph: pd.Series) -> pd.DataFrame:
        known = {x: _narrowed(x, most) for x in graph.drop_duplicates()}  # each distinct graph of a batch once
        return pd.DataFrame([known[x] for x in graph], columns=[f.name for f in fields], dtype=object)

    return lower


def summaries(sources, calls, max_depth: int, max_steps: int, max_members: int | None = None):
    """Least costs of proofs through calls: (key, depth, steps), the Pareto frontier of each key, and what was refused.

    sources: key, depth, steps; calls: caller, callee, depth, steps (the caller's own part). A proof through a call is one
    deeper than the callee's, or as deep as the caller's part, and one step longer than both together. Returns two
    relations, frontier and refused (key, reason): a proof over a limit that no admitted proof of its key dominates.
    Each round extends only what the last one added; costs grow with each call, so max_steps bounds the rounds.
    max_members bounds the keys that have proofs: of the keys that a round would add, the least are admitted while there
    is room, the others are refused (proof_limit), and what is known of admitted keys still gets better.
    """
    from tessera.operators.graph import _cut

    step = _cut(calls.select("caller", "callee", F.col("depth").alias("own_depth"), F.col("steps").alias("own_steps")).distinct())
    over = F.when(F.col("depth") > max_depth, "depth_limit").when((F.col("steps") == 0) | (F.col("steps") > max_steps), "proof_limit")
    new = sources.select("key", F.col("depth").cast("long").alias("depth"), F.col("steps").cast("long").alias("steps"))
    best = refused = None
    while True:
        judged = new.distinct().withColumn("reason", over)
        fresh = pareto(judged.filter("reason is null").drop("reason"), "key", "depth", "steps")
        no = judged.filter("reason is not null")
        if max_members is not None:
            fresh = _cut(fresh)
            keys = fresh.select("key").distinct() if best is None else fresh.select("key").distinct().join(best.select("key"), "key", "left_anti")
            room = max_members - (0 if best is None else best.select("key").distinct().count())
            if keys.count() > room:
                late = _cut(keys.join(keys.orderBy("key").limit(max(0, room)), "key", "left_anti"))
                no = no.union(fresh.join(late, "key", "left_semi").withColumn("reason", F.lit("proof_limit")).select(*no.columns))
                fresh = fresh.join(late, "key", "left_anti")
        refused = no if refused is None else refused.union(no)
        refused = _cut(pareto_any(refused))
        if best is None:
            best = added = _cut(fresh)
        else:
            added = fresh.withColumn("fresh", F.lit(True)).unionByName(best.withColumn("fresh", F.lit(False))).groupBy("key", "depth", "steps").agg(F.min("fresh").alias("fresh"))
            kept = _cut(pareto(added, "key", "depth", "steps"))
            best, added = kept.drop("fresh"), kept.filter("fresh").drop("fresh")
        if added.isEmpty():
            break
        new = added.join(step, F.col("key") == F.col("callee")).select(
            F.col("caller").alias("key"), F.greatest("own_depth", F.col("depth") + 1).cast("long").alias("depth"), (F.col("own_steps") + F.col("steps") + 1).cast("long").alias("steps")
        )
    covered = refused.join(best.select(F.col("key").alias("k"), F.col("depth").alias("d"), F.col("steps").alias("s")), (F.col("key") == F.col("k")) & (F.col("d") <= F.col("depth")) & (F.col("s") <= F.col("steps")), "left_anti")
    return best, covered.select("key", "reason").distinct()


def pareto_any(rows):
    """Refused proofs, the least of each key and reason in both measures: what a later admission has to dominate."""
    return pareto(rows.withColumn("__k", F.struct("key", "reason")), "__k", "depth", "steps").drop("__k").distinct()

"""Formal concepts and implications of contexts.

Concepts: the tree of closed attribute sets is searched in branches. A set is reached from its parent by one more attribute,
and only if the closure adds none before that one (a canonicity test on the set alone), so branches share nothing
and nothing is found twice. A task takes branches as they come; after STEPS sets it hands back what it hasn't entered, and the next round spreads
that over tasks again. So no branch, however large, is one task's work, and nothing is cut. A context travels as
bit columns over its distinct rows (objects with the same attributes are one class), a row a scope; contexts together are
broadcast up to CONTEXT_BYTES and joined by a shuffle beyond.

Implications: the Duquenne-Guigues basis goes through closed and pseudo-closed sets in lectic order, each judged by those
before it, so that a scope is one task's work, over its distinct rows; scopes spread. max_examined stops it early on request, which shows as `budget_reached`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import _cut

STEPS = 20_000  # sets that a task enters in a round
CONTEXT_BYTES = 64 << 20


def _bits(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def _mask(bits) -> int:
    """A long mask from its bits, the least first: a bit at a time would copy it as often."""
    return int("".join("1" if b else "0" for b in bits)[::-1] or "0", 2)


class Context:
    """Incidence of objects and attributes as bit masks. weights: how many objects each stands for, 1 where not named."""

    def __init__(self, pairs: list[tuple], objects: list | None = None, attributes: list | None = None, weights: dict | None = None):
        self.objects = sorted(set(objects or []) | {o for o, _ in pairs})
        self.attributes = sorted(set(attributes or []) | {a for _, a in pairs})
        at_o, at_a = {o: i for i, o in enumerate(self.objects)}, {a: i for i, a in enumerate(self.attributes)}
        held = [bytearray(len(self.objects)) for _ in self.attributes]
        for o, a in pairs:
            held[at_a[a]][at_o[o]] = 1
        self.columns = [_mask(h) for h in held]
        self.all_objects, self.all_attributes = (1 << len(self.objects)) - 1, (1 << len(self.attributes)) - 1
        each = [(weights or {}).get(o, 1) for o in self.objects]
        self.planes = [_mask(w >> b & 1 for w in each) for b in range(max(each, default=1).bit_length())]  # binary digits of the weights

    def extent(self, intent: int) -> int:
        out = self.all_objects
        for a in _bits(intent):
            out &= self.columns[a]
        return out

    def intent(self, extent: int) -> int:
        return sum(1 << a for a, column in enumerate(self.columns) if extent & ~column == 0)

    def size(self, extent: int) -> int:
        return sum((extent & plane).bit_count() << b for b, plane in enumerate(self.planes))

    def closed(self, intent: int) -> int:
        return self.intent(self.extent(intent))


def implied(mask: int, basis: list[tuple[int, int]], strict: bool = False) -> int:
    """Closure of an attribute set under implications; strict ones need a proper subset of the set given."""
    given, changed = mask, True
    while changed:
        changed = False
        for p, q in basis:
            if p & ~mask == 0 and q & ~mask and not (strict and p == given):
                mask |= q
                changed = True
    return mask


def analyse(context: Context, min_support: int, max_examined: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]], int, bool]:
    """(concepts as (extent, intent), implications as (premise, conclusion, support), examined, budget reached).

    Closed and pseudo-closed sets in lectic order. Sets of fewer than min_support objects are passed over: their
    supersets have no more objects, so none is a concept of enough support.
    """
    n = len(context.attributes)
    basis: list[tuple[int, int]] = []
    concepts, implications, examined = [], [], 0
    current: int | None = implied(0, basis)
    while current is not None:
        if max_examined is not None and examined >= max_examined:
            return concepts, implications, examined, True
        examined += 1
        extent = context.extent(current)
        support = context.size(extent)
        full = context.intent(extent)
        if full == current:
            if support >= min_support:
                concepts.append((extent, current))
        else:
            basis.append((current, full))
            if support >= min_support:
                implications.append((current, full & ~current, support))
        following = None
        for i in reversed(range(n)):  # attribute 0 is the largest in lectic order
            if current >> i & 1:
                continue
            lower = current & ((1 << i) - 1)
            if context.size(context.extent(lower | 1 << i)) < min_support:
                continue
            nxt = implied(lower | 1 << i, basis, strict=True)
            if nxt & ((1 << i) - 1) & ~lower == 0:
                following = nxt
                break
        current = following
    return concepts, implications, examined, False


# ---------------------------------------------------------------- concepts, branch by branch


def _packed(mask: int, n: int) -> bytes:
    return mask.to_bytes((n + 7) // 8, "little")


def contexts(incidence: DataFrame) -> DataFrame:
    """A row a scope: attributes in order, classes (the objects of each distinct row), columns (for each attribute the bits of its classes), n objects."""
    rows = incidence.select("scope", "object", "attribute").distinct().groupBy("scope", "object").agg(F.array_sort(F.collect_set("attribute")).alias("has"))
    classes = rows.groupBy("scope", "has").agg(F.array_sort(F.collect_list("object")).alias("objects"))
    kinds = dict(incidence.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[o[0] for o in pdf["objects"]]).sort_values("first")
        attributes = sorted({a for has in pdf["has"] for a in has})
        columns = dict.fromkeys(attributes, 0)
        for i, has in enumerate(pdf["has"]):
            for a in has:
                columns[a] |= 1 << i
        return pd.DataFrame({"scope": [pdf["scope"].iloc[0]], "attributes": [attributes], "classes": [[list(o) for o in pdf["objects"]]], "columns": [[_packed(columns[a], len(pdf)) for a in attributes]]})

    return classes.groupBy("scope").applyInPandas(run, f"scope {kinds['scope']}, attributes array<{kinds['attribute']}>, classes array<array<{kinds['object']}>>, columns array<binary>")


def _children(columns: list[int], sizes, extent: int, intent: int, after: int, least: int):
    """(extent, intent, attribute) of the canonical children of a closed set, attributes from `after` on."""
    for j in range(after, len(columns)):
        if intent >> j & 1:
            continue
        e = extent & columns[j]
        if sizes(e) < least:
            continue
        c = 0
        for k, col in enumerate(columns):
            if col & e == e:
                c |= 1 << k
                if k < j and not intent >> k & 1:
                    break
        else:
            yield e, c, j


def _searched(least: int, steps: int, kinds: dict):
    """Rows of open sets with their context to rows of found concepts and of sets that are still open."""

    def run(batches):
        held: dict = {}
        left = steps
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.scope not in held:
                    columns = [int.from_bytes(c, "little") for c in row.columns]
                    weights = [len(o) for o in row.classes]
                    held[row.scope] = columns, weights, {}
                columns, weights, known = held[row.scope]
                n, m = len(weights), len(columns)

                def size(e, weights=weights, known=known):
                    if e not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[e] = sum(w for i, w in enumerate(weights) if e >> i & 1)
                    return known[e]

                stack = [(int.from_bytes(row.extent, "little"), int.from_bytes(row.intent, "little"), row.after)]
                while stack and left > 0:
                    e, c, after = stack.pop()
                    left -= 1
                    out.append((row.scope, _packed(e, n), _packed(c, m), None, sorted(o for i in _bits(e) for o in row.classes[i]), [row.attributes[i] for i in _bits(c)], size(e)))
                    stack += [(x, y, j + 1) for x, y, j in _children(columns, size, e, c, after, least)]
                out += [(row.scope, _packed(e, n), _packed(c, m), after, None, None, None) for e, c, after in stack]
            yield pd.DataFrame(out, columns=["scope", "extent", "intent", "after", "objects", "attributes", "support"]).astype({"after": "Int32", "support": "Int32"})

    return run


def concepts(incidence: DataFrame, min_support: int = 2, steps: int = STEPS) -> DataFrame:
    """(scope, objects, attributes, support): all concepts of min_support objects or more. incidence: scope, object, attribute."""
    kinds = dict(incidence.dtypes)
    table = _cut(contexts(incidence))
    size = table.agg(F.sum(F.aggregate("columns", F.lit(0).cast("long"), lambda s, c: s + F.octet_length(c)) + 16 * F.aggregate("classes", F.lit(0).cast("long"), lambda s, c: s + F.size(c)))).first()[0] or 0
    shared = F.broadcast(table) if size <= CONTEXT_BYTES else table

    def root(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            n = len(row.classes)
            everything = (1 << n) - 1
            c = sum(1 << k for k, col in enumerate(row.columns) if int.from_bytes(col, "little") == everything)
            if sum(map(len, row.classes)) >= min_support:
                out.append((row.scope, _packed(everything, n), _packed(c, len(row.columns)), 0))
        return pd.DataFrame(out, columns=["scope", "extent", "intent", "after"]).astype({"after": "int32"})

    open_ = _cut(table.mapInPandas(lambda batches: map(root, batches), f"scope {kinds['scope']}, extent binary, intent binary, after int"))
    shape = f"scope {kinds['scope']}, extent binary, intent binary, after int, objects array<{kinds['object']}>, attributes array<{kinds['attribute']}>, support int"
    tasks = incidence.sparkSession.sparkContext.defaultParallelism
    budget, found = max(1, min(steps, 256)), None  # the first rounds are short, to open branches for all tasks
    while not open_.isEmpty():
        # Dealt by a hash of the set: neighbouring branches, large and small, go to different tasks.
        dealt = open_.repartition(4 * tasks, "scope", "extent").join(shared, "scope")
        step = _cut(dealt.mapInPandas(_searched(min_support, budget, kinds), shape))
        got = step.filter("after is null").select("scope", "objects", "attributes", "support")
        found = got if found is None else found.union(got)
        open_ = step.filter("after is not null").select("scope", "extent", "intent", "after")
        budget = min(steps, budget * 8)
    return found if found is not None else table.select("scope", F.expr(f"cast(null as array<{kinds['object']}>)").alias("objects"), "attributes", F.lit(0).alias("support")).limit(0)


def _implication_rows(min_support: int, max_examined: int | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Context([(i, a) for i, has in enumerate(pdf["has"]) for a in has], weights=dict(enumerate(map(int, pdf["n"]))))
        _, found, _, cut = analyse(c, min_support, max_examined)
        rows = [(pdf["scope"].iloc[0], [c.attributes[i] for i in _bits(p)], [c.attributes[i] for i in _bits(q)], s, cut) for p, q, s in found]
        return pd.DataFrame(rows, columns=["scope", "premise", "conclusion", "support", "budget_reached"])

    return run


def implications(incidence: DataFrame, min_support: int = 2, max_examined: int | None = None) -> DataFrame:
    """(scope, premise, conclusion, support, budget_reached): the basis of each scope, whole unless max_examined is set.

    Objects with the same attributes are one class, counted by Spark: a scope's task sees its distinct rows, however many objects it has.
    """
    t = dict(incidence.dtypes)
    ddl = f"scope {t['scope']}, premise array<{t['attribute']}>, conclusion array<{t['attribute']}>, support int, budget_reached boolean"
    rows = incidence.select("scope", "object", "attribute").distinct().groupBy("scope", "object").agg(F.array_sort(F.collect_set("attribute")).alias("has"))
    classes = rows.groupBy("scope", "has").agg(F.count("*").cast("long").alias("n"))
    return classes.groupBy("scope").applyInPandas(_implication_rows(min_support, max_examined), ddl)

"""Witness expressions: what proofs a case's evidence holds for All, Any and Exists over readable predicates.

An assignment is what a proof says of its context: an array of (key, value), each key once, in the order of keys. Expressions come as
a relation, a row a node: case, node, parent (null for the root), ordinal (among its siblings), kind (leaf, all, any,
exists), predicate (of a leaf), variables (of an exists). They are evaluated from the leaves up, all cases side by
side, one join for each place among the children of an `all`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import _cut

MOST_PROOFS = 4_096  # proofs that an expression may have to look at, a case; beyond that the case is told apart, not cut
ASSIGNMENT = "array<struct<key: string, value: string>>"


def agree(a: Column, b: Column) -> Column:
    """No key has two values."""
    return ~F.exists(a, lambda x: F.exists(b, lambda y: (x["key"] == y["key"]) & (x["value"] != y["value"])))


def merged(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(a, b)))


def covers(whole: Column, part: Column) -> Column:
    """Each key of part has its value in whole."""
    return F.forall(part, lambda x: F.exists(whole, lambda y: (x["key"] == y["key"]) & (x["value"] == y["value"])))


def readable(predicates: DataFrame, evidence: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(case, predicate, assignment): a row for each piece of evidence that a predicate takes.

    predicates: case, predicate, role, texts, anchors, status, context, qualifications (array of id and texts). evidence: case,
    role, text, anchor, status, context, qualifications (array of id and text). Role, text, anchor and status have to fit,
    the context has to have what the predicate and the request (case, context) ask, and each required qualification has to
    be there with one of its texts. Null arrays ask for nothing, but null texts and anchors take nothing.
    """
    p = predicates.select("case", "role", "predicate", "texts", "anchors", F.col("status").alias("wanted"), F.coalesce("context", F.expr(f"cast(array() as {ASSIGNMENT})")).alias("asked"), F.coalesce("qualifications", F.expr("cast(array() as array<struct<id: string, texts: array<string>>>)")).alias("needs"))
    if requests is not None:
        p = p.join(requests.select("case", F.col("context").alias("request")), "case", "left").withColumn("asked", F.concat("asked", F.coalesce("request", F.expr(f"cast(array() as {ASSIGNMENT})"))))
    e = evidence.select("case", "role", "text", "anchor", "status", F.coalesce("context", F.expr(f"cast(array() as {ASSIGNMENT})")).alias("context"), F.coalesce("qualifications", F.expr("cast(array() as array<struct<id: string, text: string>>)")).alias("has"))
    met = p.join(e, ["case", "role"]).filter(F.array_contains("texts", F.col("text")) & F.array_contains("anchors", F.col("anchor")) & F.col("wanted").eqNullSafe(F.col("status")) & covers(F.col("context"), F.col("asked")))
    met = met.filter(F.forall("needs", lambda n: F.exists("has", lambda h: (h["id"] == n["id"]) & F.array_contains(n["texts"], h["text"]))))
    return met.select("case", "predicate", F.array_sort("context").alias("assignment"))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Nodes by their distance from the root, the root first. A node whose parent isn't there belongs to none."""
    level, out = _cut(nodes.filter("parent is null")), []
    while not level.isEmpty():
        out.append(level)
        level = _cut(nodes.join(level.select("case", F.col("node").alias("parent")), ["case", "parent"], "left_semi"))
    return out


def proof_bounds(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(case, proofs): the product over an `all`, the sum over an `any`, of what its children may prove; at most MOST_PROOFS + 1."""
    cap = F.lit(MOST_PROOFS + 1).cast("long")
    rows = leaves.groupBy("case", "predicate").agg(F.count("*").alias("n"))
    up = None
    for level in reversed(_levels(nodes)):
        own = level.join(rows, ["case", "predicate"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        if up is not None:
            own = own.join(up, (level["case"] == up["c"]) & (level["node"] == up["p"]), "left")
        else:
            own = own.withColumn("below", F.lit(None).cast("array<bigint>"))
        times = F.aggregate(F.coalesce("below", F.array()), F.lit(1).cast("long"), lambda a, x: F.least(cap, a * x))
        plus = F.aggregate(F.coalesce("below", F.array()), F.lit(0).cast("long"), lambda a, x: F.least(cap, a + x))
        n = F.when(F.col("kind") == "leaf", F.least(cap, F.col("n"))).when(F.col("kind") == "all", times).otherwise(plus)
        bound = _cut(own.select("case", "node", "parent", n.alias("proofs")))
        up = bound.filter("parent is not null").groupBy(F.col("case").alias("c"), F.col("parent").alias("p")).agg(F.collect_list("proofs").alias("below"))
    return bound.select("case", "proofs") if up is not None else nodes.select("case", F.lit(0).cast("long").alias("proofs")).limit(0)


def proofs(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(case, assignment): the distinct assignments of each case's root. Bound the cases first (`proof_bounds`)."""
    none = F.expr(f"cast(array() as {ASSIGNMENT})")
    up = None
    for level in reversed(_levels(nodes)):
        own = level.filter("kind = 'leaf'").join(leaves, ["case", "predicate"]).select("case", "node", "parent", "ordinal", "assignment")
        if up is not None:
            below = up.select("case", F.col("parent").alias("node"), F.col("ordinal").alias("at"), "assignment")
            over = lambda kind: level.filter(F.col("kind") == kind).join(below, ["case", "node"])  # noqa: E731, B023
            own = own.union(over("any").select("case", "node", "parent", "ordinal", "assignment"))
            kept = F.filter("assignment", lambda x: ~F.array_contains(F.coalesce("variables", F.array()), x["key"]))
            own = own.union(over("exists").select("case", "node", "parent", "ordinal", kept.alias("assignment")))
            # Children of an `all` join one after the other: the first by ordinal, then the next, as many times as the widest has children.
            kids = _cut(nodes.join(level.filter("kind = 'all'").select("case", F.col("node").alias("parent")), ["case", "parent"], "left_semi").select("case", F.col("parent").alias("node"), F.col("ordinal").alias("at")))
            width = kids.groupBy("case", "node").agg(F.sort_array(F.collect_list("at")).alias("ats"))
            places = _cut(width.select("case", "node", F.posexplode("ats").alias("turn", "at")))
            most = (places.agg(F.max("turn")).first()[0] if not places.isEmpty() else -1) + 1
            turned = _cut(places.join(below, ["case", "node", "at"]).select("case", "node", "turn", "assignment"))
            whole = places.groupBy("case", "node").agg((F.max("turn") + 1).alias("turns"))
            grown = level.filter("kind = 'all'").join(whole, ["case", "node"]).select("case", "node", "parent", "ordinal", "turns", none.alias("assignment"))
            for turn in range(most):
                nxt = turned.filter(F.col("turn") == turn).select("case", "node", F.col("assignment").alias("more"))
                open_ = grown.filter(F.col("turns") > turn).join(nxt, ["case", "node"]).filter(agree(F.col("assignment"), F.col("more")))
                step = open_.select("case", "node", "parent", "ordinal", "turns", merged(F.col("assignment"), F.col("more")).alias("assignment")).distinct()
                grown = _cut(step.union(grown.filter(F.col("turns") <= turn)))
            own = own.union(grown.select("case", "node", "parent", "ordinal", "assignment"))
        up = _cut(own.distinct())
    return up.filter("parent is null").select("case", "assignment") if up is not None else leaves.select("case", "assignment").limit(0)


def witnessed(cases: DataFrame, predicates: DataFrame, evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(case, epistemic, reason, assignments, missing), one row a case, for cases (case, intent, context) that apply and were observed whole.

    inconclusive (work_bound) where more than MOST_PROOFS proofs may have to be looked at, insufficient where no assignment proves
    the expression (missing_predicates, or incompatible_contexts where each predicate is met by itself), model_relative_unknown where the case asks for an unknown, else
    sufficient. missing: predicates that no evidence meets.
    """
    leaves = _cut(readable(predicates, evidence, cases.select("case", "context")))
    bounds = _cut(proof_bounds(nodes, leaves))
    small = nodes.join(bounds.filter(F.col("proofs") <= MOST_PROOFS).select("case"), "case", "left_semi")
    found = proofs(small, leaves).groupBy("case").agg(F.count("*").alias("assignments"))
    absent = predicates.select("case", "predicate").distinct().join(leaves, ["case", "predicate"], "left_anti").groupBy("case").agg(F.array_sort(F.collect_set("predicate")).alias("missing"))
    j = cases.select("case", "intent").join(bounds, "case", "left").join(found, "case", "left").join(absent, "case", "left")
    large, proven = F.col("proofs") > MOST_PROOFS, F.col("proofs").isNull() | (F.coalesce("assignments", F.lit(0)) > 0)
    epistemic = F.when(large, "inconclusive").when(~proven, "insufficient").when(F.col("intent") == "unknown", "model_relative_unknown").otherwise("sufficient")
    reason = F.when(large, "work_bound").when(proven, None).when(F.size("missing") > 0, "missing_predicates").otherwise("incompatible_contexts")
    return j.select("case", epistemic.alias("epistemic"), reason.alias("reason"), F.coalesce("assignments", F.lit(0)).alias("assignments"), F.coalesce("missing", F.expr("cast(array() as array<string>)")).alias("missing"))

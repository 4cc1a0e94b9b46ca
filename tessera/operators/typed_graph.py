"""Directed multigraphs with typed arcs: snapshots, reachability by role for many starts at once, bounded traversals with witnesses.

vertices: node and any other columns; isolated ones count. arcs: arc (an id), src, dst, role; parallel arcs stay apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.parts import ranked
from tessera.operators.graph import _cut

WORD = 64  # starts whose reach shares one long
TABLES = 12  # tables of rounds that are read side by side
FEW, LATE = 16, 3  # a sixteenth of what is known is few rows
SMALL = 100_000  # rows of a side that is broadcast


class Refused(ValueError):
    pass


@dataclass(frozen=True)
class Snapshot:
    """A graph whose endpoints are known and whose ids are unique."""

    vertices: DataFrame
    arcs: DataFrame

    def outgoing(self, nodes: DataFrame) -> DataFrame:
        """Arcs from nodes (node), parallel ones each."""
        return self.arcs.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi")

    def incoming(self, nodes: DataFrame) -> DataFrame:
        return self.arcs.join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")

    def steps(self, direction: str, roles: list[str] | None = None) -> DataFrame:
        """(src, dst) in the direction of travel, once each: parallel arcs don't change what is reached."""
        kept = self.arcs if roles is None else self.arcs.filter(F.col("role").isin(roles))
        ends = {"out": ("src", "dst"), "in": ("dst", "src")}[direction]
        return kept.select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst")).filter("src <> dst").distinct()


def snapshot(vertices: DataFrame, arcs: DataFrame) -> Snapshot:
    """The graph, or `Refused` where an id is there twice or an arc's end is no vertex."""
    for rows, key in ((vertices, "node"), (arcs, "arc")):
        if not rows.groupBy(key).count().filter(F.col("count") > 1).isEmpty():
            raise Refused(f"a {key} is there twice")
    ids = _side(vertices.select("node"))
    for end in ("src", "dst"):
        if not arcs.join(ids, arcs[end] == ids["node"], "left_anti").isEmpty():
            raise Refused(f"an arc's {end} is no vertex")
    return Snapshot(vertices, arcs)


# ---------------------------------------------------------------- reachability


def _side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A side of a join, broadcast if it has few rows (counted). Else by a shuffle: Spark would go by compressed size, of which the driver holds a multiple."""
    return F.broadcast(df) if rows is not None and rows <= SMALL else df.hint("merge")


def reach_words(graph: Snapshot, starts: DataFrame, direction: str = "out", roles: list[str] | None = None, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """What each start reaches, packed: (node, word, bits) and the places of the starts (start, word, bit).

    Sixty-four starts share a long, so one join and one `bit_or` a round move all of them on; a round has at most a
    row for each node and word, and only bits that are new travel: what is known is read for what they meet, and not written
    again. Where few bits travel, up to LATE rounds go by before that is read. Starts that aren't vertices are refused.
    """
    asked = starts.select(F.col("node").alias("start")).distinct()
    if not asked.join(_side(graph.vertices.select(F.col("node").alias("start"))), "start", "left_anti").isEmpty():
        raise Refused("a start is no vertex")
    places = ranked(asked, "start").select("start", F.floor(F.col("rank") / WORD).cast("long").alias("word"), (F.col("rank") % WORD).cast("int").alias("bit"))
    places = _cut(places)
    steps = _cut(graph.steps(direction, roles))
    front = _cut(places.groupBy(F.col("start").alias("node"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    ways, n = steps.count(), front.count()
    seen, known, late = [front], n, 0  # a table a round, none of which is written again but to put the smaller ones together
    for _ in range(max_rounds):
        near = _side(front, n) if n <= SMALL else front
        moved = _cut(near.join(_side(steps, ways) if n > SMALL else steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("got")))
        n = moved.count()
        if n * FEW <= known and late < LATE:
            front, late = moved.withColumnRenamed("got", "bits"), late + 1
        else:
            had = reduce(DataFrame.union, seen).join(_side(moved.select("node", "word"), n), ["node", "word"], "left_semi").groupBy("node", "word").agg(F.bit_or("bits").alias("had"))
            new = moved.join(_side(had, n), ["node", "word"], "left").withColumn("bits", F.col("got").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))))
            front, late = _cut(new.filter("bits <> 0").select("node", "word", "bits")), 0
            n = front.count()
        if not n:
            return reduce(DataFrame.union, seen).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), places
        known += n
        seen.append(front)
        if len(seen) > TABLES:
            seen = [*seen[: TABLES // 2], _cut(reduce(DataFrame.union, seen[TABLES // 2 :]))]
    raise Refused("the traversal did not end within its rounds")


def unpacked(words: DataFrame, places: DataFrame) -> DataFrame:
    """(start, node) of packed rows."""
    bit = F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), b -> getbit(bits, b) = 1)")).alias("bit")
    return words.select("node", "word", bit).join(_side(places), ["word", "bit"]).select("start", "node")


def reachable(graph: Snapshot, starts: DataFrame, direction: str = "out", roles: list[str] | None = None, select: Column | None = None) -> DataFrame:
    """(start, node): all nodes reached, the start among them. `select` is a condition on vertices, applied to what was reached: it stops no traversal."""
    words, places = reach_words(graph, starts, direction, roles)
    if select is not None:
        words = words.join(_side(graph.vertices.filter(select).select("node")), "node", "left_semi")
    return unpacked(words, places)


def selected(graph: Snapshot, seeds: DataFrame, direction: str = "out") -> DataFrame:
    """(node): the union of what all seeds reach, one bit a node."""
    steps = _cut(graph.steps(direction))
    seen = front = _cut(seeds.select("node").distinct())
    while True:
        front = _cut(front.join(steps, front["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = _cut(seen.union(front))


# ---------------------------------------------------------------- bounded traversal with witnesses


@dataclass(frozen=True)
class Bounds:
    depth: int = 8
    vertices: int = 1_000
    arcs: int = 10_000
    witnesses: int = 3

    def __post_init__(self):
        if min(self.depth, self.vertices, self.witnesses) < 1 or self.arcs < 0:
            raise Refused("depth, vertices and witnesses are positive")


@dataclass(frozen=True)
class Traversal:
    reached: DataFrame  # seed, target, kind, boundary, depth, witness, path, omitted
    open: DataFrame  # seed, event, depth, path: unresolved events of nodes that were expanded
    ended: DataFrame  # seed, stop, vertices, arcs


def traverse(arcs: DataFrame, seeds: DataFrame, bounds: Bounds, boundary: DataFrame | None = None, unresolved: DataFrame | None = None) -> Traversal:
    """Breadth-first from each seed (seed) over arcs (arc, src, dst, definite), many seeds side by side.

    A level's arcs are met in the order of their source's place in the level, then by arc, as a queue would; the bounds
    on arcs and vertices stop a seed at the very arc that would pass them (`stop`: arcs, vertices; depth where a node at
    the depth bound had more to show, else null). boundary: node, boundary; such nodes are reached, not expanded, and
    count as no vertices. unresolved: node, event.

    Of each target the steps into it at its least depth are its finals; `witnesses` of them are kept, each with the way
    to its source, an array of arcs. The first is the least definite arc of a direct target (one at depth 1
    with a definite arc, kind `direct`), the least arc of a boundary (kind `boundary`), else that by which it was found (kind
    `path`); the others follow by arc. `omitted`: there were more.

    State is bounded by the bounds, a seed; a hub with more arcs than may be met is cut to these inside each task.
    """
    edge = boundary.select("node", "boundary") if boundary is not None else seeds.select(F.col("seed").alias("node"), F.lit("").alias("boundary")).limit(0)
    asked = seeds.select("seed").distinct()
    if not asked.join(edge, asked["seed"] == edge["node"], "left_semi").isEmpty():
        raise Refused("a seed is a boundary")
    arcs, edge = _cut(arcs.select("arc", "src", "dst", F.coalesce("definite", F.lit(False)).alias("definite"))), _cut(edge)
    kinds = dict(arcs.dtypes)
    asked = _cut(asked.select(F.col("seed").cast(kinds["src"]).alias("seed")))
    none = F.lit(None)
    seen = _cut(asked.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("place"), F.expr(f"cast(array() as array<{kinds['arc']}>)").alias("path")))
    state = _cut(asked.select("seed", F.lit(0).cast("long").alias("arcs"), F.lit(1).cast("long").alias("vertices"), none.cast("string").alias("stop")))
    into = expanded = None
    front = seen
    order = Window.partitionBy("seed").orderBy("place", "arc")
    for depth in range(1, bounds.depth + 1):
        met = front.select("seed", "node", "place", "path").join(arcs, front["node"] == arcs["src"])
        # One more than may be met shows that the bound is passed.
        met = met.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= bounds.arcs + 1).join(state.select("seed", F.col("arcs").alias("before"), "vertices"), "seed")
        met = met.join(edge.select(F.col("node").alias("dst"), "boundary"), "dst", "left").join(seen.select("seed", F.col("node").alias("dst"), F.lit(True).alias("known")), ["seed", "dst"], "left")
        first = F.row_number().over(Window.partitionBy("seed", "dst").orderBy("i")) == 1
        met = met.withColumn("new", F.col("boundary").isNull() & F.col("known").isNull() & first)
        met = met.withColumn("count", F.sum(F.col("new").cast("long")).over(Window.partitionBy("seed").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
        over_arcs = F.col("i") + F.col("before") > bounds.arcs
        over_vertices = F.col("new") & (F.col("vertices") + F.col("count") > bounds.vertices)
        met = _cut(met.withColumn("over", F.when(over_arcs, "arcs").when(over_vertices, "vertices")))
        ends = met.filter("over is not null").groupBy("seed").agg(F.min(F.struct("i", "over")).alias("end"))
        kept = _cut(met.join(ends, "seed", "left").filter("end is null or i < end.i"))
        # The arc at which the bound on vertices stops has been met, too.
        used = kept.groupBy("seed").agg(F.count("*").alias("a"), F.sum(F.col("new").cast("long")).alias("v"))
        state = _cut(
            state.join(used, "seed", "left").join(ends, "seed", "left").select(
                "seed", (F.col("arcs") + F.coalesce("a", F.lit(0)) + F.when(F.col("end.over") == "vertices", 1).otherwise(0)).alias("arcs"), (F.col("vertices") + F.coalesce("v", F.lit(0))).alias("vertices"), F.coalesce("stop", "end.over").alias("stop"),
            )
        )
        steps = kept.select("seed", F.col("dst").alias("target"), "arc", "boundary", "definite", "new", F.lit(depth).alias("depth"), F.concat("path", F.array("arc")).alias("path"))
        into = steps if into is None else _cut(into.union(steps))
        # Of a seed that stopped, nodes ahead of the arc at which it did were expanded whole.
        whole = front.join(met.join(ends, "seed").filter("i = end.i").select("seed", F.col("place").alias("at")), "seed", "left").filter("at is null or place < at").select("seed", "node", "depth", "path")
        expanded = whole if expanded is None else expanded.union(whole)
        found = kept.filter("new").select("seed", F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.col("count").alias("place"), F.concat("path", F.array("arc")).alias("path"))
        seen = _cut(seen.union(found))
        front = found.join(state.filter("stop is null").select("seed"), "seed", "left_semi")
        if front.isEmpty():
            break
    else:
        more = front.select("seed", "node").join(arcs.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select("seed")
        if unresolved is not None:
            more = more.union(front.select("seed", "node").join(unresolved.select("node"), "node", "left_semi").select("seed"))
        state = _cut(state.join(more.distinct().withColumn("deep", F.lit(True)), "seed", "left").select("seed", "arcs", "vertices", F.coalesce("stop", F.when(F.col("deep"), "depth")).alias("stop")))
    ended = state.select("seed", "stop", "vertices", "arcs")
    return Traversal(_witnessed(into.filter("target <> seed"), bounds.witnesses), _opened(expanded, unresolved), ended)


def _witnessed(into: DataFrame, witnesses: int) -> DataFrame:
    least = into.withColumn("least", F.min("depth").over(Window.partitionBy("seed", "target"))).filter("depth = least")
    sure = F.max(F.col("definite") & F.col("boundary").isNull() & (F.col("depth") == 1)).over(Window.partitionBy("seed", "target"))
    kind = F.when(F.col("boundary").isNotNull(), "boundary").when(sure, "direct").otherwise("path")
    rows = least.withColumn("kind", kind)
    head = F.when(F.col("kind") == "direct", F.col("definite")).when(F.col("kind") == "boundary", F.lit(False)).otherwise(F.col("new"))
    # Several definite arcs: the least comes first, the others by arc among the rest.
    place = Window.partitionBy("seed", "target").orderBy(F.when(head, 0).otherwise(1), "arc")
    rows = rows.withColumn("lead", F.row_number().over(place) == 1)
    by = Window.partitionBy("seed", "target").orderBy(F.when(F.col("lead"), 0).otherwise(1), "arc")
    rows = rows.withColumn("witness", F.row_number().over(by)).withColumn("all", F.count("*").over(Window.partitionBy("seed", "target")))
    return rows.filter(F.col("witness") <= witnesses).select("seed", "target", "kind", "boundary", "depth", "witness", "path", (F.col("all") > witnesses).alias("omitted"))


def _opened(expanded: DataFrame, unresolved: DataFrame | None) -> DataFrame:
    if unresolved is None:
        return expanded.select("seed", F.lit(None).cast("long").alias("event"), (F.col("depth") + 1).alias("depth"), "path").limit(0)
    return expanded.join(unresolved.select("node", "event"), "node").select("seed", "event", (F.col("depth") + 1).alias("depth"), "path")

"""Graph operators over arcs (src, dst): closures, bounded search, schedules, PageRank.

Iterations keep their state in checkpoints (the session's checkpoint folder), so lineage stays short and a lost
executor costs one step. Nothing of a graph is collected, apart from counts.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folder(sc: SparkContext) -> str:
    """The session's checkpoint folder; one of our own where it names none (tests)."""
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-graph-"))
    return sc.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage at a table in the checkpoint folder: computed once, where a checkpoint computes its plan twice. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{folder(spark.sparkContext).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def directed(arcs: DataFrame, direction: str = "out") -> DataFrame:
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": arcs.select("src", "dst"), "in": back, "both": arcs.select("src", "dst").union(back)}[direction].distinct()


def closure(arcs: DataFrame, seeds: DataFrame, direction: str = "out", max_rounds: int = 256) -> DataFrame:
    """Nodes reachable from seeds (seed, node): rows (seed, node), each seed reaching itself. Cycles are no trouble."""
    steps = _cut(directed(arcs, direction))
    seen = front = _cut(seeds.select("seed", "node").distinct())
    for _ in range(max_rounds):
        new = front.join(steps, front["node"] == steps["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = _cut(new.join(seen, ["seed", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = _cut(seen.union(front))
    raise RuntimeError("closure did not end within its rounds")


def bounded_search(arcs: DataFrame, seed, max_depth: int, max_vertices: int, boundary: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Breadth-first from one seed: (node, depth, parent) with the least parent, and why it stopped.

    Boundary nodes are reached and not expanded. Reasons: exhausted, depth, vertices. A level that would pass the
    vertex bound is cut to its smallest nodes.
    """
    spark = arcs.sparkSession
    kind = arcs.schema["src"].dataType.simpleString()
    seen = _cut(spark.createDataFrame([(seed,)], f"node {kind}").select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")))
    total = 1
    for depth in range(1, max_depth + 1):
        front = seen.filter(F.col("depth") == depth - 1)
        if boundary is not None:
            front = front.join(boundary, "node", "left_anti")
        new = front.join(arcs, front["node"] == arcs["src"]).groupBy("dst").agg(F.min("src").alias("parent")).withColumnRenamed("dst", "node")
        new = _cut(new.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
        n = new.count()
        if not n:
            return seen, "exhausted"
        if total + n > max_vertices:
            return _cut(seen.union(new.orderBy("node").limit(max_vertices - total))), "vertices"
        seen, total = _cut(seen.union(new)), total + n
    return seen, "depth"


def _chains(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """(node, head, tail, least): of each inner node (one arc in, one out) the first nodes before and behind it that aren't inner, and the least node on the way.

    Pointers double each round, so a chain of n nodes takes log2(n) of them. Circles of inner nodes alone have no ends: their
    heads are inner, and once the ways are longer than all circles, `least` is the circle's least node.
    """
    ahead, behind = edges.select(F.col("src").alias("node"), F.col("dst").alias("tail")), edges.select(F.col("dst").alias("node"), F.col("src").alias("head"))
    way = _cut(inner.join(ahead, "node").join(behind, "node").select("node", "head", "tail", F.col("node").alias("least")))
    length, before = 1, -1
    while True:
        on = way.select(F.col("node").alias("tail"), F.col("tail").alias("tail2"), F.col("least").alias("least2"))
        back = way.select(F.col("node").alias("head"), F.col("head").alias("head2"))
        step = way.join(on, "tail", "left").join(back, "head", "left")
        way = _cut(step.select("node", F.coalesce("head2", "head").alias("head"), F.coalesce("tail2", "tail").alias("tail"), F.least("least", F.coalesce("least2", "least")).alias("least"), (F.col("tail2").isNotNull() | F.col("head2").isNotNull()).alias("open")))
        length, still = 2 * length, way.filter("open").count()
        if not still or (still == before and length >= still):  # what doesn't get less are circles
            return way.drop("open")
        before = still


def strong_components(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): least node of each strongly connected component.

    Nodes without an arc in or out are components of their own. Chains (nodes with one arc in and one out) are contracted to an
    arc from head to tail by pointer doubling: what lies on them is in one component with their ends, if these are, else
    alone. Of what is left, the least ancestor colours each node, and those of a colour that reach its root are one
    component. Then all over again, without what is known.
    """
    open_, edges = _cut(nodes.select("node").distinct()), _cut(arcs.select("src", "dst").filter("src <> dst").distinct())
    known, contracted = [], []

    def keep(rest: DataFrame, arcs_: DataFrame) -> tuple[DataFrame, DataFrame]:
        rest = _cut(rest)
        return rest, _cut(arcs_.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))

    while True:
        ins, outs = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i")), edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
        met = _cut(open_.join(ins, "node", "left").join(outs, "node", "left").select("node", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("o", F.lit(0)).alias("o")))
        alone, inner = (F.col("i") == 0) | (F.col("o") == 0), (F.col("i") == 1) & (F.col("o") == 1)
        n, ends, chained = met.agg(F.count("*"), F.count_if(alone), F.count_if(inner)).first()
        if not n:
            break
        if 20 * ends >= n:
            known.append(met.filter(alone).select("node", F.col("node").alias("component")))
            open_, edges = keep(met.filter(~alone).select("node"), edges)
        elif 20 * chained >= n:
            way = _chains(edges, met.filter(inner).select("node"))
            inside = way.select(F.col("node").alias("head"))
            known.append(way.join(inside, "head", "left_semi").select("node", F.col("least").alias("component")))
            way = _cut(way.join(inside, "head", "left_anti").select("node", "head", "tail"))
            contracted.append(way)
            open_, edges = keep(met.filter(~inner).select("node"), edges.union(way.select("head", "tail")).filter("src <> dst").distinct())
        else:
            found = _cut(_coloured(open_, edges))
            known.append(found)
            open_, edges = keep(open_.join(found, "node", "left_anti"), edges)
    if not known:
        return nodes.select("node", F.col("node").alias("component")).limit(0)
    out = _cut(reduce(DataFrame.union, known))
    for way in reversed(contracted):
        at = lambda end: out.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        same = F.when(F.col("of_head") == F.col("of_tail"), F.col("of_head")).otherwise(F.col("node"))
        out = _cut(out.union(way.join(at("head"), "head").join(at("tail"), "tail").select("node", same.alias("component"))))
    least = out.groupBy("component").agg(F.min("node").alias("least"))
    return out.join(least, "component").select("node", F.col("least").alias("component"))


def _coloured(open_: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of those nodes that reach the root of their colour, the least node that reaches them."""
    color = _cut(open_.select("node", F.col("node").alias("color")))
    while True:
        step = color.join(edges, color["node"] == edges["src"]).groupBy("dst").agg(F.min("color").alias("c"))
        nxt = _cut(color.join(step, color["node"] == step["dst"], "left").select("node", F.least("color", F.coalesce("c", "color")).alias("color"), (F.coalesce("c", "color") < F.col("color")).alias("less")))
        changed = not nxt.filter("less").isEmpty()
        color = nxt.drop("less")
        if not changed:
            break
    inside = edges.join(color.select(F.col("node").alias("src"), F.col("color").alias("p")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("q")), "dst").filter("p = q")
    roots = color.filter("node = color").select(F.col("node").alias("seed"), "node")
    return closure(inside, roots, "in").select("node", F.col("seed").alias("component"))


def callee_first(arcs: DataFrame, components: DataFrame) -> DataFrame:
    """(component, level): components in an order in which callees come first; inside a level by least node."""
    c = components
    cond = arcs.join(c.select(F.col("node").alias("src"), F.col("component").alias("p")), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("q")), "dst")
    cond = _cut(cond.filter("p <> q").select("p", "q").distinct())
    # A component waits a round for each level below it. What nobody waits for any more leaves, so that rounds get smaller.
    busy = []
    while not cond.isEmpty():
        busy.append(_cut(cond.select(F.col("p").alias("component")).distinct()))
        cond = _cut(cond.join(busy[-1].withColumnRenamed("component", "q"), "q", "left_semi").select("p", "q"))
    every = c.select("component").distinct()
    if not busy:
        return every.withColumn("level", F.lit(0))
    waits = reduce(DataFrame.union, busy).groupBy("component").agg(F.count("*").cast("int").alias("n"))
    return every.join(waits, "component", "left").select("component", F.coalesce("n", F.lit(0)).alias("level"))


def cyclic_nodes(arcs: DataFrame) -> DataFrame:
    """Nodes left when those without an incoming arc are taken away again and again: empty where there is no cycle."""
    edges = _cut(arcs.select("src", "dst").distinct())
    while True:
        n = edges.count()
        alive = edges.select(F.col("dst").alias("src")).distinct()
        edges = _cut(edges.join(alive, "src", "left_semi"))
        if edges.count() == n:
            return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


SMALL_IDS = 1_000_000  # up to so many sending nodes are broadcast (24 bytes each); beyond that arcs are joined by a shuffle


def pagerank(arcs: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-10, max_rounds: int = 100) -> DataFrame:
    """(node, score): weighted PageRank; parallel weights summed, dangling mass spread evenly, L1 residual. Nodes are the arcs' ends if not given.

    Arcs are dealt by number of rows before any are summed, in ranges of dst, so that a task meets few of the nodes that receive.
    """
    from tessera.functions.parts import ROWS_A_TASK, spread

    spark, m = arcs.sparkSession, arcs.count()
    dealt = arcs.select("src", "dst", "weight").repartitionByRange(max(-(-m // ROWS_A_TASK), spark.sparkContext.defaultParallelism), "dst", "src")
    total = _cut(dealt.groupBy("src", "dst").agg(F.sum("weight").alias("w")))
    out = _cut(total.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("out")))
    nodes = out.select("node").union(total.select("dst")).distinct() if nodes is None else nodes.select("node")
    state = _cut(nodes.join(out, "node", "left"))
    n, senders = state.agg(F.count("*"), F.count("out")).first()
    flow = total if senders <= SMALL_IDS else spread(total, "src", rows=m)
    score = state.withColumn("score", F.lit(1.0 / n if n else 0.0))
    sums = lambda df: df.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("score"))), F.lit(0.0)), F.coalesce(F.sum(F.abs(F.col("score") - F.col("old"))), F.lit(0.0))).first()
    lost, _ = sums(score.withColumn("old", F.col("score")))
    for _ in range(max_rounds):
        base = (1 - damping) / n + damping * lost / n if n else 0.0
        sent = score.filter("out is not null").select(F.col("node").alias("src"), "out", "score")
        got = flow.join(F.broadcast(sent) if senders <= SMALL_IDS else sent, "src").groupBy("dst").agg(F.sum(F.col("w") / F.col("out") * F.col("score")).alias("in"))
        nxt = _cut(score.join(got, score["node"] == got["dst"], "left").select("node", "out", (F.lit(base) + damping * F.coalesce("in", F.lit(0.0))).alias("score"), F.col("score").alias("old")))
        lost, residual = sums(nxt)
        score = nxt.drop("old")
        if residual < tolerance:
            break
    return score.select("node", "score")


def public_paths(children: DataFrame, roots: DataFrame, max_depth: int = 256) -> DataFrame:
    """(node, path) along all trails from roots (node, path); a trail never visits a node twice. children: parent, node, name."""
    front = _cut(roots.select("node", "path", F.array("node").alias("trail")))
    out = front
    for _ in range(max_depth):
        step = front.join(children.select(F.col("parent").alias("__p"), F.col("node").alias("__n"), "name"), front["node"] == F.col("__p"))
        front = _cut(step.filter(~F.array_contains("trail", F.col("__n"))).select(F.col("__n").alias("node"), F.concat_ws(".", "path", "name").alias("path"), F.array_append("trail", F.col("__n")).alias("trail")))
        if front.isEmpty():
            return out.select("node", "path").distinct()
        out = _cut(out.union(front))
    raise RuntimeError("paths did not end within their depth")


CHUNK_ARCS = 1 << 16  # 16 bytes an arc: chunks of 1 MiB


def encoded(arcs: DataFrame, per_chunk: int = CHUNK_ARCS) -> DataFrame:
    """(chunk, n, payload): distinct arcs in order, two big-endian longs each, in chunks of bounded size."""
    from tessera.functions.parts import ranked

    word = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 16, "0")
    placed = ranked(arcs.select("src", "dst").distinct(), "src", "dst").withColumn("word", F.concat(word("src"), word("dst")))
    per = placed.groupBy(F.floor(F.col("rank") / per_chunk).alias("chunk"))
    listed = per.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("words"))
    return listed.select("chunk", "n", F.unhex(F.concat_ws("", F.transform("words", lambda x: x["word"]))).alias("payload"))


def decoded(chunks: DataFrame) -> DataFrame:
    """(src, dst) of encoded chunks. The text of a chunk is cut into arcs once, so a chunk costs what it is long."""
    arcs = F.regexp_extract_all(F.hex("payload"), F.lit("[0-9A-F]{32}"), F.lit(0))
    part = lambda at: F.conv(F.substring("arc", at, 16), 16, -10).cast("long")
    return chunks.select(F.explode(arcs).alias("arc")).select(part(1).alias("src"), part(17).alias("dst"))

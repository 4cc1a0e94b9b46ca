"""Near-duplicate vectors by NN-descent on a threshold graph.

Vectors are compared only where labels are equal and not null, by cosine in double precision; pairs of at least
`THRESHOLD` link. Equal vectors of a label are one node with a multiplicity, so copies never meet one another.

1. Start: `TABLES` random-hyperplane orders of all nodes (label, code, projection), range-partitioned so that no
   label or code has to fit one task; every node takes its next `STEPS` nodes of each order as first neighbours.
2. Descent: each node keeps its best neighbours. The neighbours of a node (its own and those that name it) are
   joined with one another: a task gets the vectors of a node's neighbours and compares them, and pairs better than
   either one's worst neighbour replace it. Rounds go on until under `SETTLED` of the entries change.
3. Saturated lists, those whose worst entry still links, are enlarged twofold, up to `WIDE`. What lists can't hold
   is completed exactly: links lie inside components, so all members of a component of three or more are compared
   in tiles of bounded size, and their links counted. No list's width limits n_links.
   Full lists can hide links to another component, but only where a node has at least NARROW better ones, so inside
   components of more than NARROW nodes. Any two of these of one label that may touch, by the angles between their
   least nodes and from these to their members, are compared exactly, too (`bridges`), and joined where a pair links.
4. Audit: `AUDIT` nodes, chosen by a hash, and as many of those that the first descent linked, are compared with
   all rows in blocks. Where under `RECALL` of their links lie inside the components found, another start with other
   hyperplanes is merged in, and again. The recall is logged; one under `LEAST` after all starts is an error.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label is
null, links with nothing: n_links 0, its own component, kept. Vectors of different lengths link with nothing.
Equal vectors count as links of each other. A null vec_id takes no part as a component's least id unless all are.
Rows that share a vec_id are separate vectors.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as H

LOG = logging.getLogger(__name__)
THRESHOLD = 0.93
TABLES = 10
STEPS = 3
NARROW, WIDE = 8, 16
ROUNDS = 6
SETTLED = 0.02
TILE = 512
AUDIT = 200
RECALL = 0.995
LEAST = 0.9
STARTS = 3
SMALL_CENTERS = 1_000


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    """Unit vectors in double precision. All vectors of a batch must have one length."""
    col = batch.column(batch.schema.get_field_index(name))
    x = col.flatten().to_numpy().astype(np.float64).reshape(len(col), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, node or null; nodes: node, grp, v, copies, low). grp stands for (label, length)."""
    v = F.col("embedding")
    number = F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    clean = v.isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if "double" in vectors.schema["embedding"].dataType.simpleString():  # squares of doubles can overflow or vanish
        most = F.array_max(F.transform(v, lambda x: F.abs(x)))
        v = F.when(clean & (most > 0) & ~number.between(1e-200, 1e200), F.transform(v, lambda x: x / most)).otherwise(v)
    good = clean & F.exists(v, lambda x: x != 0)
    grp = F.xxhash64(F.col("label"), F.size(v))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, grp).alias("grp"), F.when(good, v).alias("v"))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("grp", "v")))
    found = rows.filter("node is not null").groupBy("node", "grp").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    return rows.select("vec_id", "node"), found


def _ordered(seed: int, tables: int, bits: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for d in np.unique(sizes):
                part = batch if len(np.unique(sizes)) == 1 else batch.filter(pa.array(sizes == d))
                x = _matrix(part)
                if d not in planes:
                    planes[d] = np.random.default_rng(seed).standard_normal((int(d), tables * (bits + 1)))
                y = x @ planes[d]
                for t in range(tables):
                    z = y[:, t * (bits + 1) : (t + 1) * (bits + 1)]
                    code = (z[:, :-1] > 0) @ (1 << np.arange(bits)[::-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int32)), pa.array(z[:, -1]), part.column(0), part.column(1), part.column(2)], names=["t", "code", "z", "node", "grp", "v"]
                    )

    return run


def _chained(steps: int):
    """Neighbours in the order of the partition, of one group and table."""

    def run(batches):
        tail = None
        for batch in batches:
            if not len(batch):
                continue
            if tail is not None:
                joined = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()
                batch, seen = joined[0], len(tail)
            else:
                seen = 0
            t, grp, node = (_column(batch, c) for c in ("t", "grp", "node"))
            sizes = np.diff(batch.column(batch.schema.get_field_index("v")).offsets.to_numpy())
            a, b, s = [], [], []
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = _matrix(batch.take(pa.array(at)))
                for k in range(1, steps + 1):
                    i, j = at[:-k], at[k:]
                    ok = (t[i] == t[j]) & (grp[i] == grp[j]) & (j >= seen) & (node[i] != node[j])
                    if ok.any():
                        w = np.flatnonzero(ok)
                        a.append(node[i[w]])
                        b.append(node[j[w]])
                        s.append(np.einsum("ij,ij->i", x[w], x[w + k]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, s)], names=["a", "b", "sim"])
            tail = batch.slice(max(0, len(batch) - steps))

    return run


def _best(pairs: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Directed lists: per node a its best distinct neighbours b, NARROW of them or the node's own width."""
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    flat = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    width = F.lit(NARROW)
    if limits is not None:
        flat = flat.join(limits, "a", "left")
        width = F.coalesce(F.col("width"), F.lit(NARROW))
    return flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= width).select("a", "b", "sim", "rank")


def _local_join(batches):
    """Rows sorted by w: compare the neighbours of each w with one another; pairs that improve a list."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        batch = table.to_batches()[0]
        w = _column(batch, "w")
        cut = int(np.searchsorted(w != w[-1], False)) if w[0] == w[-1] else int(np.flatnonzero(w != w[-1])[-1]) + 1
        held = batch.slice(cut)
        if cut:
            yield from _compared(batch.slice(0, cut))
    if held is not None and len(held):
        yield from _compared(held)


def _compared(batch: pa.RecordBatch):
    """All pairs around each w. What is around one w has one length; a batch can hold several."""
    sizes = np.diff(batch.column(batch.schema.get_field_index("v")).offsets.to_numpy())
    for d in np.unique(sizes):
        part = batch if (sizes == d).all() else batch.filter(pa.array(sizes == d))
        w, node, bound = _column(part, "w"), _column(part, "b"), _column(part, "bound")
        start = np.concatenate(([0], np.flatnonzero(w[1:] != w[:-1]) + 1))
        count = np.diff(np.append(start, len(w)))
        x = _matrix(part)
        for lo in range(0, len(start), 256):
            s, c = start[lo : lo + 256], count[lo : lo + 256]
            m = int(c.max())
            at = np.minimum(s[:, None] + np.arange(m), len(w) - 1)
            ok = np.arange(m) < c[:, None]
            v = x[at]
            sim = v @ v.transpose(0, 2, 1)
            good = ok[:, :, None] & ok[:, None, :] & (node[at][:, :, None] != node[at][:, None, :]) & (sim > bound[at][:, :, None])
            g, i, j = np.nonzero(good)
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array(node[at[g, i]]), pa.array(node[at[g, j]]), pa.array(sim[g, i, j])], names=["a", "b", "sim"])


def descend(found: DataFrame, seed: int, threshold: float = THRESHOLD, tables: int = TABLES) -> DataFrame:
    """Pairs (a, b, sim) of one descent: every node's best neighbours, both ends of one group."""
    n = found.count()
    bits = max(3, min(24, n.bit_length() - 5))
    parts = found.sparkSession.conf.get("spark.sql.shuffle.partitions")
    orders = found.select("node", "grp", "v").mapInArrow(_ordered(seed, tables, bits), f"t int, code int, z double, node long, grp long, v {found.schema['v'].dataType.simpleString()}")
    chains = orders.repartitionByRange(int(parts), "grp", "t", "code", "z").sortWithinPartitions("grp", "t", "code", "z").mapInArrow(_chained(STEPS), "a long, b long, sim double")
    both = chains.union(chains.select(F.col("b"), F.col("a"), F.col("sim")))
    lists = H.settle(_best(both), "nn-lists")
    vec = found.select(F.col("node").alias("b"), "v")
    for _ in range(ROUNDS):
        worst = lists.groupBy("a").agg(F.count("*").alias("k"), F.min("sim").alias("low"))
        limits = worst.select("a", F.when((F.col("low") >= threshold) & (F.col("k") >= NARROW), WIDE).otherwise(NARROW).alias("width"), F.when(F.col("k") >= NARROW, F.col("low")).otherwise(-2.0).alias("bound"))
        limits = H.settle(limits, "nn-limits")
        named = lists.withColumn("back", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("sim"), "a"))).filter(F.col("back") <= NARROW)
        around = lists.filter(F.col("rank") <= NARROW).select(F.col("a").alias("w"), "b").union(named.select(F.col("b").alias("w"), F.col("a").alias("b"))).distinct()
        around = around.join(limits.select(F.col("a").alias("b"), "bound"), "b").join(vec, "b")
        fresh = around.repartition(int(parts), "w").sortWithinPartitions("w").mapInArrow(_local_join, "a long, b long, sim double")
        nxt = H.settle(_best(lists.select("a", "b", "sim").union(fresh), limits.select("a", "width")), "nn-lists")
        changed = nxt.join(lists, ["a", "b"], "left_anti").count()
        size = nxt.count()
        H.discard(lists)
        lists = nxt
        if changed <= SETTLED * size:
            break
    return lists.select("a", "b", "sim")


def _tile(table: pa.Table) -> pa.Table:
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])
    batches = table.combine_chunks().to_batches()
    if not batches:
        return pa.Table.from_batches([], schema=schema)
    batch = batches[0]
    threshold = float(_column(batch, "threshold")[0])
    node, side, copies = _column(batch, "node"), _column(batch, "side"), _column(batch, "copies")
    x = _matrix(batch)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    hit = x[left] @ x[right].T >= threshold
    if (side == 2).any():
        np.fill_diagonal(hit, False)
        return pa.table([pa.array(node[left]), pa.array(hit @ copies[right])], schema=schema)
    return pa.table([pa.array(np.concatenate((node[left], node[right]))), pa.array(np.concatenate((hit @ copies[right], hit.T @ copies[left])))], schema=schema)


def _angles(batches):
    """Angle of each member to its component's least node."""
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        out = np.zeros(len(batch))
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            part = batch.take(pa.array(at))
            out[at] = np.arccos(np.clip(np.einsum("ij,ij->i", _matrix(part), _matrix(part, "center")), -1, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["component", "angle"])


_PAIRS = pa.schema([("p", pa.int64()), ("q", pa.int64())])
SLACK = 1e-6


def _touching(table: pa.Table) -> pa.Table:
    """Pairs of components in a tile that may link: angles that the triangle inequality doesn't rule out."""
    batches = table.combine_chunks().to_batches()
    if not batches:
        return pa.Table.from_batches([], schema=_PAIRS)
    batch = batches[0]
    component, side, reach = _column(batch, "component"), _column(batch, "side"), _column(batch, "radius")
    x = _matrix(batch)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    apart = np.arccos(np.clip(x[left] @ x[right].T, -1, 1))
    near = apart <= reach[left][:, None] + reach[right] + np.arccos(_column(batch, "threshold")[0]) + SLACK
    if (side == 2).any():
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    return pa.table([pa.array(component[left[i]]), pa.array(component[right[j]])], schema=_PAIRS)


_BRIDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bridge(table: pa.Table) -> pa.Table:
    """One link between the two sides of a tile, if there is any."""
    batches = table.combine_chunks().to_batches()
    if not batches:
        return pa.Table.from_batches([], schema=_BRIDGE)
    batch = batches[0]
    node, side = _column(batch, "node"), _column(batch, "side")
    x = _matrix(batch)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    sim = x[left] @ x[right].T
    if not sim.size or sim.max() < _column(batch, "threshold")[0]:
        return pa.Table.from_batches([], schema=_BRIDGE)
    i, j = np.unravel_index(sim.argmax(), sim.shape)
    return pa.table([pa.array(node[left[[i]]]), pa.array(node[right[[j]]])], schema=_BRIDGE)


def bridges(found: DataFrame, parts: DataFrame, threshold: float = THRESHOLD) -> DataFrame | None:
    """Links (a, b) between components of more than NARROW nodes, one at least for each two that link; None where there is none."""
    large = parts.groupBy("component").agg((F.count("*") + 1).alias("k")).filter(F.col("k") > NARROW)
    large = H.settle(large, "nn-large")
    count = large.count()
    if count < 2:
        return None
    at = parts.union(large.select("component", "component"))  # roots, too
    members = H.settle(found.select("node", "grp", "v").join(at, "node").join(large, "component"), "nn-members")
    centers = members.filter("node = component").select("component", F.col("v").alias("center"))
    angles = members.select("component", "v").join(F.broadcast(centers) if count <= SMALL_CENTERS else centers, "component").select("component", "v", "center")
    radius = angles.mapInArrow(_angles, "component long, angle double").groupBy("component").agg(F.max("angle").alias("radius"))
    balls = H.settle(members.filter("node = component").select("component", "grp", "k", "v").join(radius, "component"), "nn-balls")
    several = balls.groupBy("grp").agg(F.count("*").alias("balls")).filter("balls > 1")
    dealt = _dealt(balls.join(several, "grp"), "component", "balls").select("grp", "i", "j", "component", "radius", "side", "v", F.lit(threshold).alias("threshold"))
    touch = H.settle(dealt.groupBy("grp", "i", "j").applyInArrow(_touching, "p long, q long"), "nn-touch")
    tiles = balls.select("component", F.ceil(F.col("k") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64(F.lit("tile"), "node"), F.ceil(F.col("k") / TILE)).cast("int").alias("own")
    mine = members.select("component", "node", "v", own)
    all_tiles = lambda name: F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias(name)
    left = touch.join(tiles.withColumnRenamed("component", "q"), "q").select("p", "q", all_tiles("j")).join(mine.withColumnRenamed("component", "p"), "p")
    right = touch.join(tiles.withColumnRenamed("component", "p"), "p").select("p", "q", all_tiles("i")).join(mine.withColumnRenamed("component", "q"), "q")
    sides = left.select("p", "q", F.col("own").alias("i"), "j", "node", "v", F.lit(0).alias("side")).union(right.select("p", "q", "i", F.col("own").alias("j"), "node", "v", F.lit(1).alias("side")))
    links = sides.withColumn("threshold", F.lit(threshold)).groupBy("p", "q", "i", "j").applyInArrow(_bridge, "a long, b long")
    links = H.settle(links, "nn-bridges")
    H.discard(members, balls, touch, large)
    return None if links.isEmpty() else links


def _dealt(rows: DataFrame, name: str, k: str) -> DataFrame:
    """Rows of a group of k in tiles of bounded size, such that any two meet in one tile (i, j); side 2 where i = j."""
    dealt = rows.withColumn("tiles", F.ceil(F.col(k) / TILE).cast("int")).withColumn("own", F.pmod(F.xxhash64(F.lit("tile"), name), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": side})


def _audit(ids: np.ndarray, grp: np.ndarray, vectors: list[np.ndarray], threshold: float):
    def run(batches):
        for batch in batches:
            v = batch.column(2)
            sizes = np.diff(v.offsets.to_numpy())
            a, b = [], []
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                mine = [k for k, u in enumerate(vectors) if len(u) == d]
                if not mine:
                    continue
                x = _matrix(batch.take(pa.array(at)))
                q = np.stack([vectors[k] for k in mine])
                q = q / np.linalg.norm(q, axis=1, keepdims=True)
                node, g = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at]
                hit = (q @ x.T >= threshold) & (grp[mine][:, None] == g) & (ids[mine][:, None] != node)
                i, j = np.nonzero(hit)
                a.append(ids[mine][i])
                b.append(node[j])
            z = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [z])), pa.array(np.concatenate(b or [z]))], names=["a", "b"])

    return run


def true_links(found: DataFrame, threshold: float = THRESHOLD, sample: int = AUDIT, among: DataFrame | None = None) -> DataFrame:
    """All links (a, b) of a sample of nodes, or of those among others: a bounded set of queries against all rows."""
    asked = found if among is None else found.join(among, "node", "left_semi")
    got = asked.select("node", "grp", "v").orderBy(F.xxhash64(F.lit("audit"), "node"), "node").limit(sample).collect()
    ids, grp = np.array([r["node"] for r in got], np.int64), np.array([r["grp"] for r in got], np.int64)
    run = _audit(ids, grp, [np.array(r["v"], np.float64) for r in got], threshold)
    return found.select("node", "grp", "v").mapInArrow(run, "a long, b long")


def components_of(found: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(node, component) for nodes that link, roots left out; starts again until the audited recall is reached.

    Audited are nodes of the whole table and, so that links are among them wherever there are any, nodes that the
    first descent linked. Links that the audit found are kept. A recall under LEAST after all starts is an error.
    """
    links: list[DataFrame] = []
    audit = H.settle(true_links(found, threshold), "nn-audit")
    for start in range(STARTS):
        pairs = descend(found, 1 + start, threshold)
        links.append(H.settle(pairs.filter(F.col("sim") >= threshold).select("a", "b"), "nn-links"))
        parts = H.settle(H.components(reduce(DataFrame.union, links)), "nn-parts")
        more = bridges(found, parts, threshold)
        if more is not None:
            links.append(more)
            parts = H.settle(H.components(reduce(DataFrame.union, links)), "nn-parts")
        if not start:
            audit = H.settle(audit.union(true_links(found, threshold, AUDIT, parts.select("node"))).distinct(), "nn-audit")
            total = audit.count()
        at = parts.select(F.col("node").alias("n"), "component")
        placed = audit.join(at.withColumnsRenamed({"n": "a", "component": "p"}), "a", "left").join(at.withColumnsRenamed({"n": "b", "component": "q"}), "b", "left")
        hits = placed.filter(F.coalesce("p", "a") == F.coalesce("q", "b")).count()
        got = hits / total if total else 1.0
        LOG.info("start %d: %d of %d audited links lie inside components, recall %.4f", start + 1, hits, total, got)
        if got >= recall:
            break
    if got < LEAST:
        raise RuntimeError(f"recall of {got:.3f} over {total} audited links after {STARTS} starts")
    if hits < total:  # audited links are links: they are kept, too
        parts = H.settle(H.components(reduce(DataFrame.union, [*links, audit])), "nn-parts")
    return parts


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows, found = nodes(vectors)
    rows, found = H.settle(rows, "nn-rows"), H.settle(found, "nn-nodes")
    parts = components_of(found, threshold) if not found.isEmpty() else found.select("node", F.col("node").alias("component"))
    placed = H.settle(found.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "nn-placed")
    per = H.settle(placed.groupBy("component").agg(F.count("*").alias("k"), F.min("low").alias("least")), "nn-per")
    inside = H.join_facts(placed, per.filter("k > 1"), "component").filter("k > 1")
    dealt = _dealt(inside, "node", "k").select("component", "i", "j", "node", "copies", "side", "v", F.lit(threshold).alias("threshold"))
    counted = dealt.groupBy("component", "i", "j").applyInArrow(_tile, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    facts = H.join_facts(placed, per, "component").join(counted, "node", "left").select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = H.join_facts(rows, H.settle(facts, "nn-facts"), "node")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def brute_force(rows: list[tuple], threshold: float = THRESHOLD) -> list[tuple]:
    """The same for a small fixture of (vec_id, embedding, label)."""
    at = {r[0]: r[0] for r in rows}
    n = dict.fromkeys(at, 0)

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    def clean(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    good = sorted((r for r in rows if clean(r)), key=lambda r: r[0])
    unit = {r[0]: np.array(r[1], np.float64) / np.linalg.norm(np.array(r[1], np.float64)) for r in good}
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[a[0]] @ unit[b[0]] >= threshold:
                n[a[0]] += 1
                n[b[0]] += 1
                p, q = find(a[0]), find(b[0])
                at[max(p, q)] = min(p, q)
    return sorted((d, n[d], find(d), find(d) == d) for d in at)

"""A stored inverted index of vectors: cells around centroids, rows ranked exactly.

`write` fits centroids (spherical k-means) on a bounded sample, the SAMPLE rows of least hash of their item, and puts
every row into the cell of its nearest centroid. Rows keep their angle to it (`turn`) and lie sorted by cell and turn, so that
a look-up reads the buckets of its cells and, of these, the row groups that can hold the turns it asks for.

What is looked up is a band of turns in a cell. The angles between three directions obey the triangle inequality: a row
whose turn is t lies at least |t - angle(query, centroid)| from the query. So
- `within` (all rows of a cosine of `floor` or more) asks each cell for the turns within acos(floor) of the query's
  own, which is exact;
- `nominated` asks the `probes` nearest cells whole, and what they hold is ranked exactly: an answer whose recall is
  measured (`recall`), not proved;
- `nearest` completes it: the k-th cosine found so far is a floor, and the bands of all other cells under it are
  searched, too, which is exact.
How many cells a band leaves is a matter of the vectors. Between unrelated directions of many dimensions all angles are
alike and no index helps; `recall` says what share of cells and rows a search has met.

Queries and rows meet in tiles: a block of queries and a run of neighbouring cells, each of a bounded size. A query is sent once to a tile that
holds a cell it asks, with a bit for each of the tile's cells, so that no row is a query and a cell.

Rows with a null, zero or non-finite vector, or one of another length than most, are left out: no cosine is defined for
them. Centroids are few (MOST_CELLS) and broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V

SAMPLE, FLOATS = 20_000, 16_000_000  # rows to fit centroids on, and numbers in them
MOST_CELLS, BUCKETS, SPREAD, ROUNDS = 4_096, 64, 8, 12
CELL_ROWS, QUERY_ROWS, TILE_FLOATS = 32_768, 16_384, 1 << 23  # rows and queries of a tile, and numbers in either
ALL = 4  # where every pair may be an answer, tiles have so many times fewer of both
PART, BATCH = 1 << 16, 1 << 20  # rows of a batch of Arrow; angles that are computed at once
SLACK = 1e-6  # of an angle, for rounding


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors at unit length; the start is spread over the sample, which is in an order of its own."""
    x = _unit(sample)
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        at = np.concatenate([np.argmax(part @ c.T, 1) for part in np.array_split(x, max(1, len(x) // 4_096))])
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def write(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Store an index of (item, vector): path/vectors, path/cells. One there is replaced. cells: the root of the rows, unless given."""
    spark = vectors.sparkSession
    rows = vectors.select("item", "vector").filter(V.norm(F.col("vector")).isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        raise ValueError("no vector to index")
    d, n = most["d"], most["count"]
    rows = rows.filter(F.size("vector") == d)
    k = max(1, min(MOST_CELLS, n, cells or round(n**0.5)))
    take = min(n, max(k, min(SAMPLE, FLOATS // d)))
    got = rows.orderBy(F.xxhash64("item"), "item").limit(take).select("vector").toPandas()["vector"]
    c = fitted(np.stack(got.to_list()).astype(float), k)
    shared, step = spark.sparkContext.broadcast(c), max(1, BATCH // k)

    def placed(batches):
        for pdf in batches:
            for a in range(0, len(pdf), step):
                some = pdf.iloc[a : a + step]
                near = _unit(np.stack(some["vector"].to_list()).astype(float)) @ shared.value.T
                cell = near.argmax(1)
                yield some.assign(cell=cell, turn=np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1)))

    kinds = dict(rows.dtypes)
    cut = rows.mapInPandas(placed, f"item {kinds['item']}, vector {kinds['vector']}, cell int, turn double").withColumn("bucket", F.col("cell") % BUCKETS)
    dealt = cut.repartition("bucket", F.pmod(F.xxhash64("item"), F.lit(SPREAD))).sortWithinPartitions("bucket", "cell", "turn")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/vectors")
    held = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.max("turn").alias("most"))
    held = {r["cell"]: r for r in held.collect()}  # MOST_CELLS rows
    table = [(i, x.tolist(), held[i]["n"], held[i]["least"], held[i]["most"]) for i, x in enumerate(c) if i in held]
    spark.createDataFrame(table, "cell int, centroid array<double>, n long, least double, most double").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


class Index:
    """A stored index, open for look-ups."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(f"{path}/vectors")
        table = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()  # MOST_CELLS rows
        self.cells, self.n = table["cell"].to_numpy(), table["n"].to_numpy()
        self.c = np.stack(table["centroid"].to_list())
        self.shared = spark.sparkContext.broadcast((self.c, self.n, table["least"].to_numpy(), table["most"].to_numpy()))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """Queries that have a cosine with the index's rows."""
        return queries.select("item", "vector").filter(V.norm(F.col("vector")).isNotNull() & (F.size("vector") == self.c.shape[1]))

    def _marked(self, queries: DataFrame, probes: int) -> DataFrame:
        """queries with `near`: a bit for each cell, set for the `probes` nearest."""
        shared, step = self.shared, max(1, BATCH // len(self.c))

        def run(batches):
            c = shared.value[0]
            for batch in batches:
                for a in range(0, len(batch), step):
                    some = batch.slice(a, step)
                    angle = _angles(V.matrix(pa.chunked_array([some["vector"]])), c)
                    wanted = np.zeros(angle.shape, bool)
                    np.put_along_axis(wanted, np.argsort(angle, 1, kind="stable")[:, :probes], True, 1)
                    yield some.append_column("near", _bits(wanted))

        kinds = dict(queries.dtypes)
        return queries.mapInArrow(run, f"item {kinds['item']}, vector {kinds['vector']}, near binary")

    def _scored(self, queries: DataFrame, k: int | None = None, inside: bool | None = None) -> DataFrame:
        """(query, target, score): rows of the cells that a query asks, without itself, of its `floor` or more (null: any); of each tile the k best of a query (all, if None).

        queries: item, vector, floor, and `near` if only these cells (inside), or only the others, are asked. Cells that can't hold a row of the floor are left out.
        """
        kinds = dict(queries.dtypes)["item"], dict(self.rows.dtypes)["item"]
        small = ALL if k is None else 1
        at_once = max(1, TILE_FLOATS // self.c.shape[1] // small)
        blocks = max(1, -(-queries.count() // max(1, min(QUERY_ROWS // small, at_once))))
        tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
        most = max(1, min(CELL_ROWS // small, at_once, -(-int(self.n.sum()) * blocks // tasks)))
        first, pieces, starts = _tiles(self.n, most)
        n = len(starts)
        shared, slots = self.shared, max(1, min(BATCH // len(self.c), PART // n))
        ends = np.r_[starts[1:], len(self.c)]
        # A cell of several pieces is the only one of each of its tiles.
        ends = np.maximum(ends, starts + 1)

        def wanted(batches):
            c, _, least, most = shared.value
            for batch in batches:
                for a in range(0, len(batch), slots):
                    some = batch.slice(a, slots)
                    angle = _angles(V.matrix(pa.chunked_array([some["vector"]])), c)
                    width = _width(some["floor"])[:, None]
                    on = (angle - width - SLACK <= most) & (angle + width + SLACK >= least)
                    if inside is not None:
                        near = _unbits(some["near"], len(c))
                        on &= near if inside else ~near
                    for tile in range(n):
                        cells = on[:, starts[tile] : ends[tile]]
                        q = np.flatnonzero(cells.any(1))
                        if len(q):
                            at = pa.array(q)
                            yield pa.record_batch({"query": some["item"].take(at), "qv": some["vector"].take(at), "floor": some["floor"].take(at), "tile": pa.array(np.full(len(q), tile, np.int32)), "cells": _bits(cells[q])})

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return _batched(left["query"].slice(0, 0), right["target"].slice(0, 0), np.zeros(0))
            tile = left["tile"][0].as_py()
            right = right.sort_by([("cell", "ascending"), ("turn", "ascending")])
            rank = np.empty(len(right), np.int64)
            rank[pc.sort_indices(right["target"]).to_numpy()] = np.arange(len(right))
            code, turn = right["place"].to_numpy() - starts[tile], right["turn"].to_numpy()
            q, floor = V.matrix(left["qv"]), left["floor"].combine_chunks()
            on = _unbits(left["cells"].combine_chunks(), ends[tile] - starts[tile])
            angle, width = _angles(q, shared.value[0][starts[tile] : ends[tile]]), _width(floor)[:, None]
            low, high = angle - width - SLACK, angle + width + SLACK

            def ask(part, here):
                cells, first, at = np.unique(code[here], return_index=True, return_inverse=True)
                last = np.r_[first[1:], len(at)] - 1
                hit = on[part][:, cells] & (low[part][:, cells] <= turn[here][last]) & (high[part][:, cells] >= turn[here][first])
                some = np.flatnonzero(hit.any(1))
                hit = hit[some]
                return some, None if hit.all() else hit[:, at]

            i, j, s = V.closest(q, V.matrix(right["tv"]), left["query"].to_numpy(), right["target"].to_numpy(), k, floor.fill_null(-np.inf).to_numpy(), ask, rank)
            return _batched(left["query"].take(pa.array(i)), right["target"].take(pa.array(j)), s)

        deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
        of = lambda values: F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), F.col("cell"))  # noqa: E731  a literal, by cell
        by_cell = lambda values: np.bincount(self.cells, values).astype(int).tolist()
        rows = self.rows.select("cell", "turn", F.col("item").alias("target"), F.col("vector").alias("tv"), of(by_cell(np.arange(len(self.cells)))).alias("place"), (of(by_cell(first)) + deal("item", of(np.maximum(by_cell(pieces), 1).tolist()))).alias("tile"))
        rows = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keep = queries.select("item", "vector", F.col("floor").cast("double").alias("floor"), *([] if inside is None else ["near"]))
        asked = keep.mapInArrow(wanted, f"query {kinds[0]}, qv {dict(queries.dtypes)['vector']}, floor double, tile int, cells binary").withColumn("qb", deal("query", F.lit(blocks)))
        spread = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n * blocks, 1_024))
        dealt = lambda df: df.repartition(spread, "qb", "tile").groupBy("qb", "tile")  # noqa: E731  not put together by size: the work is their product
        return dealt(asked).cogroup(dealt(rows)).applyInArrow(run, f"query {kinds[0]}, target {kinds[1]}, score double")

    def within(self, queries: DataFrame, floor: float) -> DataFrame:
        """Exact: (query, target, score) of all rows with a score of floor or more."""
        return self._scored(self._asked(queries).withColumn("floor", F.lit(float(floor))))

    def _nominated(self, marked: DataFrame, k: int) -> DataFrame:
        return _best(self._scored(marked.withColumn("floor", F.lit(None).cast("double")), k, True), k)

    def nominated(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query, target, score, rank): the k best of the `probes` nearest cells."""
        return self._nominated(self._marked(self._asked(queries), probes), k)

    def nearest(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """Exact: the k best of all rows. What `nominated` finds sets each query's floor for the other cells."""
        from tessera.operators.graph import _cut

        marked = _cut(self._marked(self._asked(queries), probes))  # once, so that each cell is either nominated or among the others
        first = _cut(self._nominated(marked, k))
        floors = first.groupBy(F.col("query").alias("item")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        others = self._scored(_cut(marked.join(floors, "item", "left")), k, False)
        return _best(first.select("query", "target", "score").union(others), k)

    def met(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query, cells, rows): how many of them `probes` cells are."""
        n = self.n

        def run(batches):
            for batch in batches:
                near = _unbits(batch["near"], len(n))
                yield pa.record_batch({"query": batch["item"], "cells": pa.array(near.sum(1).astype(np.int64)), "rows": pa.array((near @ n).astype(np.int64))})

        return self._marked(self._asked(queries), probes).mapInArrow(run, f"query {dict(queries.dtypes)['item']}, cells long, rows long")

    def recall(self, queries: DataFrame, truth: DataFrame, k: int, probes: int) -> DataFrame:
        """One row: recall of `nominated` against truth (query, target), and the mean shares of cells and rows met."""
        found = self.nominated(queries, k, probes).select("query", "target", F.lit(1).alias("hit"))
        share = truth.select("query", "target").join(found, ["query", "target"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))
        total = float(self.n.sum())
        met = self.met(queries, probes).agg((F.avg("cells") / len(self.cells)).alias("cells"), (F.avg("rows") / total).alias("rows"))
        return share.crossJoin(met)  # one row each


def _tiles(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells in order to tiles of at most `most` rows: (first tile, number of tiles) of each cell, and the first cell of each tile. A larger cell has some to itself."""
    first, pieces, starts, held = [], [], [], most + 1
    for cell, size in enumerate(map(int, sizes)):
        parts = -(-size // most)
        if parts > 1 or held + size > most:
            first.append(len(starts))
            starts += [cell] * parts
            held = most + 1 if parts > 1 else size
        else:
            first.append(len(starts) - 1)
            held += size
        pieces.append(parts)
    return np.array(first), np.array(pieces), np.array(starts)


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ c.T, -1, 1))


def _width(floor: pa.Array) -> np.ndarray:
    """How far from a query a row of its floor may lie."""
    return np.arccos(np.clip(floor.fill_null(-1.0).to_numpy(zero_copy_only=False), -1, 1))


def _bits(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.packbits(rows, axis=1)], pa.binary())


def _unbits(column: pa.Array, width: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1, count=width).astype(bool)


def _batched(query: pa.ChunkedArray, target: pa.ChunkedArray, score: np.ndarray) -> pa.Table:
    """A table of small batches."""
    table = pa.table({"query": query, "target": target, "score": pa.array(score, "double")})
    return pa.Table.from_batches(table.to_batches(max_chunksize=PART), table.schema)


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "target")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

"""Exact top-k by Hamming distance: incremental multi-index hashing over binary codes.

Codes are 64-bit (the signs of a vector's first 64 components). They are cut into segments of about log2(codes) - 2
bits, and one table holds each code once for each segment, under (segment, value). In round r every query that isn't
answered yet looks up, in every segment, the values at distance r from its own: a join of the queries' probes with
the table. A code within distance m (r + 1) - 1 of the query has a segment within r, so after round r all of these have
been met; they are verified by their true distance, and a query ends as soon as its k-th distance is covered so.
Radii grow until every query has ended this way; there is no other exit and no candidate is capped.

A pair of codes met in several segments or rounds counts where it is met first: in the nearest segment, and the first
of those. That is read off the two codes, so nothing has to be made distinct by a shuffle. Candidates farther than
the k-th distance known from earlier rounds are dropped where they are found. Equal codes are one entry with the k + 1
least ids, which are all that a query can want of them, so copies cost nothing. Values of a segment that hold over a
thousandth of the codes are dealt to SALTS parts, and the probes for them are sent to each part.

Ties of distance are cut by the smaller id. A query doesn't find rows of its own id, but others that share its
code. Defined results: rows without a code (null vector, fewer than 64 components, null among the first 64)
neither ask nor are found; a null id neither asks (no divisor) nor is found. Fewer than k others: all of them. Equal
rows ask once; rows that share an id ask with each of their codes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as H

BITS = 64
K = 10
LEAST_WIDTH, MOST_WIDTH = 4, 20  # bits of a segment
SALTS = 32
HOT_ROWS = 1_000


def codes(vectors: DataFrame) -> DataFrame:
    """(id, code): bit i is set where component i is positive. Native."""
    v = F.slice("embedding", 1, BITS)
    bits = F.aggregate(v, F.lit(0).cast("long"), lambda c, x: F.shiftleft(c, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") >= BITS) & ~F.exists(v, lambda x: x.isNull())
    return vectors.filter(whole).select(F.col("vec_id").cast("long").alias("id"), bits.alias("code"))


def segments(n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments for n codes."""
    width = max(LEAST_WIDTH, min(MOST_WIDTH, n.bit_length() - 2))
    m = -(-BITS // width)
    return [(BITS * i // m, BITS * (i + 1) // m - BITS * i // m) for i in range(m)]


def _value(code: Column, segment: tuple[int, int]) -> Column:
    low, width = segment
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))


def _by_segment(code: Column, cut: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), _value(code, s).alias("value")) for i, s in enumerate(cut)]))


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(code, ids): each code once, with the k + 1 least ids that have it and how many rows have each (k at most matter)."""
    counted = rows.groupBy("code", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    least = counted.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("rank") <= k + 1)
    return least.groupBy("code").agg(F.collect_list(F.struct("id", "times")).alias("ids"))


def _masks(width: int, radius: int) -> Column:
    """All values of `width` bits with `radius` of them set, as an array that the optimizer folds into a literal."""
    values = (sum(1 << i for i in c) for c in combinations(range(width), radius))
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _met_here(segment: Column, radius: int, cut: list[tuple[int, int]]) -> Column:
    """Whether a pair (asked, code) that agrees to `radius` in `segment` is met there first."""
    apart = F.col("asked").bitwiseXOR(F.col("code"))
    away = [F.bit_count(_value(apart, s)) for s in cut]
    return _all([F.when(segment > i, a > radius).otherwise(a >= radius) for i, a in enumerate(away)])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, trace: list[tuple[int, int]] | None = None) -> DataFrame:
    """rows and queries: (id, code). Per query its k nearest rows: query_id, rank, id, distance.

    trace, if given, gets (radius, queries that asked) of each round.
    """
    entries = H.settle(_entries(rows, k), "mih-entries")
    n = entries.count()
    cut = segments(n)
    width = max(w for _, w in cut)
    table = entries.select("code", "ids", _by_segment(F.col("code"), cut).alias("s")).select("s.segment", "s.value", "code", "ids")
    hot = table.groupBy("segment", "value").count().filter(F.col("count") > max(HOT_ROWS, n // 1_000)).select("segment", "value", F.lit(SALTS).alias("salts"))
    hot = H.settle(hot, "mih-hot")  # fewer than a thousand values a segment
    salts = F.coalesce("salts", F.lit(1))
    index = table.join(F.broadcast(hot), ["segment", "value"], "left").withColumn("salt", F.pmod(F.xxhash64("code"), salts).cast("int")).drop("salts")
    index = H.settle(index, "mih-index")
    asking = H.settle(queries.select(F.col("id").alias("query_id"), F.col("code").alias("asked")).distinct(), "mih-queries")
    active = asking.withColumn("worst", F.lit(BITS))
    kept = asking.select("query_id", "asked", F.lit(0).cast("long").alias("id"), F.lit(0).alias("distance")).limit(0)
    order = Window.partitionBy("query_id", "asked").orderBy("distance", "id")
    for radius in range(width + 1):
        if trace is not None:
            trace.append((radius, active.count()))
        tried = active.withColumn("mask", F.explode(_masks(width, radius)))
        probes = tried.select("query_id", "asked", "worst", "mask", _by_segment(F.col("asked"), cut).alias("s"))
        fits = _all([(F.col("s.segment") != i) | (F.col("mask") < (1 << w)) for i, (_, w) in enumerate(cut)])
        probes = probes.filter(fits).select("query_id", "asked", "worst", F.col("s.segment").alias("segment"), F.col("s.value").bitwiseXOR(F.col("mask")).alias("value"))
        probes = probes.join(F.broadcast(hot), ["segment", "value"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        # Probes are many more than the queries whose size Spark knows: they meet the index by a shuffle, and are never broadcast.
        met = probes.join(index.hint("merge"), ["segment", "value", "salt"]).withColumn("distance", F.bit_count(F.col("asked").bitwiseXOR(F.col("code"))))
        met = met.filter((F.col("distance") <= F.col("worst")) & _met_here(F.col("segment"), radius, cut))
        met = met.select("query_id", "asked", "distance", F.explode("ids").alias("x")).filter("x.id <> query_id")
        met = met.select("query_id", "asked", F.col("x.id").alias("id"), "distance", F.explode(F.sequence(F.lit(1), F.col("x.times"))).alias("time")).drop("time")
        best = kept.unionByName(met).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")
        kept, old = H.settle(best, "mih-kept"), kept
        H.discard(old)
        covered = len(cut) * (radius + 1) - 1
        state = kept.groupBy("query_id", "asked").agg(F.count("*").alias("k"), F.max("distance").alias("far"))
        worst = F.when(F.col("k") >= k, F.col("far")).otherwise(BITS)
        active = H.settle(asking.join(state, ["query_id", "asked"], "left").select("query_id", "asked", F.coalesce(worst, F.lit(BITS)).alias("worst")).filter(F.col("worst") > covered), "mih-active")
        if active.isEmpty():
            break
    final = Window.partitionBy("query_id").orderBy("distance", "id")
    return kept.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def search(vectors: DataFrame, k: int = K) -> DataFrame:
    """Queries: all rows whose id is divisible by 20, against all rows."""
    base = codes(vectors)
    return top_k(base, base.filter("id % 20 = 0"), k)


ORACLE = """
WITH bits AS (SELECT vec_id AS id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding[1:64]] AS b FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) >= 64),
pairs AS (SELECT q.id AS query_id, r.id AS id, CAST(list_sum([abs(z[1] - z[2]) FOR z IN list_zip(q.b, r.b)]) AS INTEGER) AS distance FROM bits q JOIN bits r ON q.id <> r.id WHERE q.id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 10
"""

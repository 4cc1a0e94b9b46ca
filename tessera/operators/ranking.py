"""Rank fusion, promotion, and greedy seeds under a cap per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.parts import ranked, ranked_within

K = 60


def reciprocal(rank: Column, k: int = K) -> Column:
    return 1.0 / (F.lit(k) + rank)


def fuse(scores: DataFrame, k: int = K) -> DataFrame:
    """Reciprocal rank fusion in two levels. scores: family, channel, target, occurrence, score (null abstains).

    The best occurrence of each (family, channel, target), ties to the smaller one; ranks inside each (family,
    channel); their reciprocal ranks summed by family; families ranked again and summed. Zero and negative scores
    vote. Returns target and fused score; order by score descending, then target.
    """
    live = scores.filter(F.col("score").isNotNull()).withColumn("score", F.col("score") + F.lit(0.0))
    best = Window.partitionBy("family", "channel", "target").orderBy(F.desc("score"), "occurrence")
    one = live.withColumn("n", F.row_number().over(best)).filter("n = 1")
    # Channels are few and large: their ranks run over all tasks.
    placed = ranked_within(one, ["family", "channel"], F.desc("score"), "target")
    by_family = placed.groupBy("family", "target").agg(F.sum(reciprocal(F.col("rank") + 1, k)).alias("s"))
    again = ranked_within(by_family, ["family"], F.desc("s"), "target")
    return again.groupBy("target").agg(F.sum(reciprocal(F.col("rank") + 1, k)).alias("score"))


def promoted_first(df: DataFrame, exact: Column, *order: Column) -> DataFrame:
    """Rows with their final rank, from 1: exact matches first, then by the given order."""
    placed = ranked(df.withColumn("__exact", F.when(exact, 0).otherwise(1)), "__exact", *order)
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int")).drop("__exact")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Each task keeps its k best; they meet in one place."""
    return df.orderBy(*order).limit(k)


def capped_seeds(candidates: DataFrame, budget: int) -> DataFrame:
    """Greedy choice by score, at most max(1, ceil(budget / 3)) of a community, until the budget is spent.

    candidates: candidate, community, score, eligible. Every candidate comes back with its reason. Greedy order
    with a cap per community is a rank inside the community, then a rank among those within their cap.
    """
    cap = max(1, -(-budget // 3))
    ok = candidates.filter("eligible")
    inner = Window.partitionBy("community").orderBy(F.desc("score"), "candidate")
    ranked = ok.withColumn("place", F.row_number().over(inner))
    chosen = ranked.filter(F.col("place") <= cap).orderBy(F.desc("score"), "candidate").limit(budget).select("candidate", F.lit(True).alias("chosen"))
    out = candidates.join(ranked.select("candidate", "place"), "candidate", "left").join(chosen, "candidate", "left")
    reason = F.when(~F.col("eligible"), "ineligible").when(F.col("chosen"), "selected").when(F.col("place") > cap, "community_cap").otherwise("budget")
    return out.select("candidate", "community", "score", reason.alias("reason"))


def configured_seeds(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Authored requests in their order, each with what became of it: plan, ordinal, name, target, matches, status.

    requests: plan, names (an array; its order and repeats are kept). candidates: name, target, eligible. One candidate
    is selected, or ineligible; none is missing; several are ambiguous, and none of them is taken. Names are counted
    before they meet requests, so a name with many candidates costs a row.
    """
    asked = requests.select("plan", F.posexplode("names").alias("ordinal", "name"))
    known = candidates.select("name", "target", "eligible").distinct().groupBy("name").agg(F.count("*").alias("matches"), F.min("target").alias("target"), F.max("eligible").alias("eligible"))
    j = asked.join(known, "name", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    status = F.when(F.col("matches") == 0, "missing").when(F.col("matches") > 1, "ambiguous").when(F.col("eligible"), "selected").otherwise("ineligible")
    return j.select("plan", "ordinal", "name", F.when(F.col("matches") == 1, F.col("target")).alias("target"), "matches", status.alias("status"))

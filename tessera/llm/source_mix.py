"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source gets a target number of words: its weight's share of `total`, at most `most_copies` times its own
words; what a capped source can't use is shared by weight among the others until none is above (the level lam
with sum(min(cap_s, lam * weight_s)) = total). A document of a source with ratio r = target / words is taken
floor(r) times for certain. For one more copy its inclusion probability is the fraction p of r that is left, and
documents are ranked by Pareto's q = (u / (1 - u)) / (p / (1 - p)) with u a hash of doc_id and text: random odds divided
by inclusion odds. The sample's size is fixed in words: the ranking is followed up to the words that the source
still lacks. Where the next document is too long for the rest, `PASSES` further samples are drawn in the same
order from the documents that fit, so that each source ends near its target without cutting a document.

The cut of a ranking is found without sorting a source: words are summed by bucket of q (partial aggregates),
the running sum over buckets gives the bucket in which the cut falls, and only that bucket's rows are ordered.
The number of buckets follows the number of documents, so a hot source costs no more in one task than any other.

Defined results: null text has size 0. Documents of size 0 have taken 0. A source of size 0 has target 0. A null
source is a source of its own, last in order. Rows that share a doc_id, or have none, are separate documents. Only rows of
one id and one text share a place in the ranking; where a cut falls among them, as many as fit are drawn, by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as H

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
PASSES = 4
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def uniform(doc_id: Column, h: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a digest of doc_id and of the text's digest."""
    both = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), h).cast("binary"))
    return (F.conv(F.substring(both, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: source, words, target. sizes has source and size. The windows run over sources only."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("words") * most)
    ratio = F.col("cap").cast("double") / F.col("weight")
    whole = Window.orderBy(ratio, F.col("source").isNull(), "source")
    everything = Window.partitionBy()  # of one row per source
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "source", "words", "weight", "cap",
        (F.sum("words").over(everything).cast("double") * share).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    # The level if all sources of smaller ratio are at their cap. The true one is the first that leaves its source
    # below its cap; those after it are no higher, so it is the highest such level.
    per = per.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    per = per.withColumn("lam", F.max(F.when(F.col("free"), F.col("level"))).over(everything))
    target = F.when(F.col("lam").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("lam") * F.col("weight")))
    return per.select("source", "words", target.alias("target"))


def _key(doc_id: Column, q: Column, size: Column, h: Column) -> Column:
    """The place of a document in its source's ranking; null ids come first. Only rows of one id and text share it."""
    return F.struct(q.alias("q"), F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("d"), size.alias("s"), h.alias("h"))


_KEY = "struct<q: double, d: bigint, s: bigint, h: string>"


def _match(rows: DataFrame, small: DataFrame) -> DataFrame:
    """rows with the columns of a table that has one row per source, null matching null."""
    small = small.withColumnRenamed("source", "source_")
    return rows.join(small, rows["source"].eqNullSafe(small["source_"]), "left").drop("source_")


def _pass(rows: DataFrame, state: DataFrame, buckets: int) -> DataFrame:
    """Follow the ranking behind `low` while documents of up to `budget` words keep the running size within it.

    rows: source, key, size. state: source, budget, low. Returns source, budget, low, high (the place of the first
    document that didn't fit, null where all did), part (how many rows of that place did fit) and rest (words still
    lacking). Rows of one place are counted before they meet.
    """
    place = F.least(F.lit(buckets - 1), F.floor(F.col("key.q") / (F.col("key.q") + 1) * buckets)).cast("int")
    fit = _match(rows, state).filter("budget > 0 and size <= budget and (low is null or key > low)").withColumn("bucket", place)
    counted = H.settle(fit.groupBy("source", "bucket", "budget").agg(F.sum("size").alias("b")), "mix-sums")
    run = F.sum("b").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = counted.withColumn("run", run)
    passed = F.min(F.when(F.col("run") > F.col("budget"), F.struct("bucket", (F.col("run") - F.col("b")).alias("before"))))
    per = sums.groupBy("source").agg(F.sum("b").alias("all"), passed.alias("cut"))
    edge = _match(fit, per.select("source", "cut")).filter("bucket = cut.bucket").groupBy("source", "key", "size", "budget", "cut.before").agg((F.count("*") * F.col("size")).alias("b"))
    order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("run", F.sum("b").over(order) + F.col("before"))
    found = edge.filter("run > budget").groupBy("source").agg(F.min(F.struct("key", (F.col("run") - F.col("b")).alias("start"), "size")).alias("end"))
    out = _match(_match(state, per), found)
    part = F.floor((F.col("budget") - F.col("end.start")) / F.col("end.size"))
    out = out.withColumn("part", F.coalesce(part, F.lit(0)).cast("long"))
    used = F.when(F.col("cut").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.col("end.start") + F.col("part") * F.col("end.size"))
    done = H.settle(out.select("source", "budget", "low", F.col("end.key").alias("high"), "part", (F.col("budget") - used).alias("rest")), "mix-pass")
    H.remove(counted)
    return done


def plan(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: str) -> DataFrame:
    """One row per source: source, words, target, whole, part and `cuts`, the stretches of its ranking that get a copy more.

    sized: doc_id, source, size, h. It is ranked once; a pass reads the ranking twice, and what passes on is one row per source.
    """
    goal = targets(sized, weights, share, most)
    whole = F.floor(F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)).cast("long")
    goal = goal.select("source", "words", "target", whole.alias("whole")).withColumn("part", F.when(F.col("words") > 0, F.col("target") / F.col("words") - F.col("whole")).otherwise(0.0))
    goal = goal.withColumn("lacks", F.round("target").cast("long") - F.col("whole") * F.col("words"))
    goal = H.settle(goal, "mix-goal")
    buckets = max(256, min(65_536, sized.count() // 1_024))
    rows = H.settle(ranked(sized, goal, seed).filter("size > 0 and key is not null").select("source", "key", "size"), "mix-ranked")
    state = goal.select("source", F.col("lacks").alias("budget"), F.lit(None).cast(_KEY).alias("low"))
    cuts = goal.select("source", F.array().cast(f"array<struct<budget: bigint, low: {_KEY}, high: {_KEY}, part: bigint>>").alias("cuts"))
    for _ in range(1 + PASSES):
        done = _pass(rows, state, buckets)
        step = done.select("source", F.struct("budget", "low", "high", "part").alias("step"))
        cuts = _match(cuts, step).select("source", F.array_append("cuts", F.col("step")).alias("cuts"))
        # Behind the last cut there is nothing left to draw where everything has fit.
        state = done.select("source", F.when(F.col("high").isNull(), 0).otherwise(F.col("rest")).alias("budget"), F.col("high").alias("low"))
    out = H.settle(_match(goal, cuts), "mix-plan")
    H.discard(rows)
    return out


def ranked(rows: DataFrame, goal: DataFrame, seed: str) -> DataFrame:
    """rows (doc_id, source, size, h and others) with goal's columns and key; null where no further copy can be drawn."""
    u = uniform(F.col("doc_id"), F.col("h"), seed)
    odds = F.col("part") / (1 - F.col("part"))
    q = F.when((F.col("part") > 0) & (F.col("part") < 1), (u / (1 - u)) / odds)
    key = _key(F.col("doc_id"), q, F.col("size"), F.col("h"))
    return _match(rows, goal).withColumn("key", F.when(q.isNotNull(), key))


def with_copies(rows: DataFrame, plan_: DataFrame, seed: str = SEED) -> DataFrame:
    """rows (doc_id, source, size, h and others) with words, target and copies.

    Rows of one place in the ranking, at which a cut falls, are told apart by number: `part` of them get the copy.
    """
    drawn = F.exists("cuts", lambda c: (F.col("size") <= c["budget"]) & (c["low"].isNull() | (F.col("key") > c["low"])) & (c["high"].isNull() | (F.col("key") < c["high"])))
    live = (F.col("size") > 0) & F.col("key").isNotNull()
    tied = F.get(F.filter("cuts", lambda c: (c["part"] > 0) & (F.col("key") == c["high"])), F.lit(0))["part"]
    out = ranked(rows, plan_, seed).withColumns({"one_more": F.when(live & drawn, 1).otherwise(0), "tied": F.when(live, tied)})
    copies = (F.col("whole") + F.col("one_more")).alias("copies")
    kept = [c for c in out.columns if c not in ("cuts", "key", "whole", "part", "lacks", "one_more", "tied")]
    if plan_.filter(F.exists("cuts", lambda c: c["part"] > 0)).isEmpty():
        return out.select(*kept, copies)
    some = H.settle(out.filter("tied is not null").withColumn("row_number", F.monotonically_increasing_id()), "mix-tied")
    # The numbers of a place run on from one of the table's partitions to the next, so no task sees more than one of them.
    here = some.withColumns({"place": F.xxhash64("source", "key"), "there": F.shiftright("row_number", 33)})
    before = F.sum("count").over(Window.partitionBy("place").orderBy("there").rowsBetween(Window.unboundedPreceding, -1))
    sizes = here.groupBy("place", "there").count().withColumn("before", F.coalesce(before, F.lit(0))).drop("count")
    number = F.row_number().over(Window.partitionBy("place", "there").orderBy("row_number"))
    dealt = here.withColumn("number", number).join(sizes, ["place", "there"]).withColumn("one_more", F.when(F.col("number") + F.col("before") <= F.col("tied"), 1).otherwise(0))
    return out.filter("tied is null").select(*kept, copies).union(dealt.select(*kept, copies))


def _sized(docs: DataFrame) -> DataFrame:
    return H.settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest(F.col("text")).alias("h")), "mix-sized")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken."""
    sized = _sized(docs)
    out = with_copies(sized, plan(sized, weights, share, most, seed), seed)
    return out.select("doc_id", "size", F.col("words").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """docs as the mix takes them: rows drawn more than once are repeated, others are left out; columns stay."""
    sized = _sized(docs)
    packed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest(F.col("text")).alias("h"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    out = with_copies(packed, plan(sized, weights, share, most, seed), seed).filter("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> str:
    """The same mix in SQL: every ranking is one running sum over its whole source."""
    parts = [
        "sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents)",
        "per AS (SELECT source, sum(size)::BIGINT AS words FROM sized GROUP BY source)",
        f"turns AS (SELECT *, [{', '.join(map(str, weights))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}]::BIGINT AS weight, words * {most} AS cap FROM per)",
        "runs AS (SELECT *, (SELECT sum(words) FROM per)::DOUBLE AS total, coalesce(sum(cap) OVER w, 0) AS cap_before, (SELECT sum(weight) FROM turns) - coalesce(sum(weight) OVER w, 0) AS weight_left"
        " FROM turns WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        "levels AS (SELECT *, (total - cap_before::DOUBLE) / weight_left::DOUBLE AS level FROM runs)",
        "lam AS (SELECT max(level) AS lam FROM levels WHERE level * weight <= cap)",
        "goals AS (SELECT source, words, CASE WHEN lam IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, lam * weight) END AS target FROM levels, lam)",
        "goal AS (SELECT *, CASE WHEN words > 0 THEN floor(target / words)::BIGINT ELSE 0 END AS whole FROM goals)",
        "parts AS (SELECT *, CASE WHEN words > 0 THEN target / words - whole ELSE 0 END AS part, round(target)::BIGINT - whole * words AS lacks FROM goal)",
        f"us AS (SELECT *, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || h), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r} AS u FROM sized)",
        "odds AS (SELECT us.*, words, target, whole, part, lacks, CASE WHEN part > 0 AND part < 1 AND size > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS q FROM us JOIN parts ON us.source IS NOT DISTINCT FROM parts.source)",
        "rows0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size, h) AS g, lacks AS budget, 0 AS low, 0 AS drawn FROM odds)",
    ]
    for k in range(1 + PASSES):
        parts += [
            f"fit{k} AS (SELECT source, g, budget, sum(size) OVER (PARTITION BY source ORDER BY g ROWS UNBOUNDED PRECEDING) AS run FROM rows{k} WHERE q IS NOT NULL AND budget > 0 AND size <= budget AND g > low)",
            f"stop{k} AS (SELECT source, min(CASE WHEN run > budget THEN g END) AS high FROM fit{k} GROUP BY source)",
            f"end{k} AS (SELECT f.source, any_value(high) AS high, coalesce(max(CASE WHEN high IS NULL OR g < high THEN run END), 0) AS used FROM fit{k} f JOIN stop{k} s ON f.source IS NOT DISTINCT FROM s.source GROUP BY f.source)",
            f"rows{k + 1} AS (SELECT r.* EXCLUDE (budget, low, drawn), CASE WHEN e.high IS NULL THEN 0 ELSE r.budget - e.used END AS budget, e.high AS low,"
            f" CASE WHEN q IS NOT NULL AND r.g > r.low AND r.budget > 0 AND r.size <= r.budget AND (e.high IS NULL OR r.g < e.high) THEN 1 ELSE r.drawn END AS drawn FROM rows{k} r LEFT JOIN end{k} e ON r.source IS NOT DISTINCT FROM e.source)",
        ]
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, size, words AS source_size, target, (whole + drawn) * size AS taken FROM rows{1 + PASSES}"

"""Parts of texts and relations: token-bounded parts, token ranges, anchors, chunk digests, presented values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_parts(pieces: DataFrame, preferred: int = 1024, hard: int = 2048) -> DataFrame:
    """Pieces (unit, context, ordinal, tokens) with the part that each falls into.

    A part takes pieces of one context while it stays within the preferred number of tokens; a piece larger than
    that is a part of its own, and one over the hard bound is lexical only. Greedy filling is a fold over a unit's
    pieces, which are few; units spread over tasks.
    """
    kind = "struct<used: bigint, part: int, out: array<struct<ordinal: int, tokens: bigint, part: int>>>"
    rows = pieces.groupBy("unit", "context").agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").cast("int").alias("ordinal"), F.col("tokens").cast("long").alias("tokens")))).alias("p"))
    start = F.expr(f"cast(struct(0L as used, 0 as part, cast(array() as array<struct<ordinal: int, tokens: bigint, part: int>>) as out) as {kind})")

    def step(s: Column, x: Column) -> Column:
        fits = (s["used"] + x["tokens"] <= preferred) | (s["used"] == 0)
        part = F.when(fits, s["part"]).otherwise(s["part"] + 1)
        used = F.when(fits, s["used"] + x["tokens"]).otherwise(x["tokens"])
        return F.struct(used.alias("used"), part.cast("int").alias("part"), F.array_append(s["out"], F.struct(x["ordinal"].alias("ordinal"), x["tokens"].alias("tokens"), part.cast("int").alias("part"))).alias("out")).cast(kind)

    folded = rows.select("unit", "context", F.explode(F.aggregate("p", start, step, lambda s: s["out"])).alias("x"))
    return folded.select("unit", "context", "x.ordinal", "x.tokens", "x.part", (F.col("x.tokens") > hard).alias("lexical_only"))


def token_ranges(tokens: DataFrame, maps: DataFrame) -> DataFrame:
    """Original ranges of tokens. tokens: unit, token, start, stop (special ones are empty). maps: unit, start, stop, source, source_start."""
    t = tokens.filter("stop > start")
    m = maps.select("unit", F.col("start").alias("ms"), F.col("stop").alias("me"), "source", "source_start")
    j = t.join(m, "unit").filter("start < me and stop > ms")
    lo, hi = F.greatest("start", "ms"), F.least("stop", "me")
    return j.select("unit", "token", "source", (F.col("source_start") + lo - F.col("ms")).alias("source_start"), (F.col("source_start") + hi - F.col("ms")).alias("source_stop"))


def anchored(slices: DataFrame, containers: DataFrame) -> DataFrame:
    """Slices (id, container, start, stop), relative to their container, as ranges of its artifact; outside ones are refused by name."""
    c = containers.select(F.col("id").alias("container"), "artifact", F.col("start").alias("cs"), F.col("stop").alias("ce"))
    j = slices.join(c, "container", "left")
    bad = F.col("artifact").isNull() | (F.col("start") < 0) | (F.col("cs") + F.col("stop") > F.col("ce"))
    keep = lambda x: F.when(~bad, x)
    return j.select("id", keep(F.col("artifact")).alias("artifact"), keep(F.col("cs") + F.col("start")).alias("start"), keep(F.col("cs") + F.col("stop")).alias("stop"), F.when(bad, "outside").alias("error"))


ROWS_A_TASK = 250_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by a hash of keys to so many partitions that each has some ROWS_A_TASK rows, of about `rows` (counted, if None).

    Spark puts small partitions together by their compressed size, and of rows that compress well a task would get any number.
    """
    n = max(-(-(df.count() if rows is None else rows) // ROWS_A_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def _dealt(df: DataFrame, keys: tuple, size: Column) -> tuple[DataFrame, DataFrame]:
    """(df in ranges of keys, with __part and __size; per part the sum of sizes before it). Ranges are cut once and written, so that what is counted is what is ranked."""
    from tessera.operators.graph import _cut

    spread = _cut(df.withColumn("__size", size.cast("long")).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    before, table = 0, []
    for part, n in sorted(map(tuple, spread.groupBy("__part").agg(F.sum("__size")).collect())):  # a row a partition
        table.append((part, before))
        before += n or 0
    return spread, df.sparkSession.createDataFrame(table, "__part int, __before long")


def ranked(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df with `rank`, from 0 in the order of keys (columns or orders of columns) over the whole relation; no task sorts everything."""
    spread, before = _dealt(df, keys, F.lit(1))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return spread.join(F.broadcast(before), "__part").withColumn("rank", place + F.col("__before") - 1).drop("__part", "__before", "__size")


def running(df: DataFrame, size: Column, *keys: str | Column) -> DataFrame:
    """df with `running`, the sum of sizes (a null counts 0) up to and with each row in the order of keys over the whole relation."""
    spread, before = _dealt(df, keys, F.coalesce(size, F.lit(0)))
    upto = F.sum("__size").over(Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return spread.join(F.broadcast(before), "__part").withColumn("running", upto + F.col("__before")).drop("__part", "__before", "__size")


def ranked_within(df: DataFrame, by: list[str], *keys: str | Column) -> DataFrame:
    """df with `rank`, from 0 in the order of keys inside each group of `by`; a group of any size is spread over tasks. Groups with a null are groups, too."""
    from tessera.operators.graph import _cut

    all_ = _cut(ranked(df, *by, *keys))
    first = all_.groupBy(*by).agg(F.min("rank").alias("__first"))
    first = first.select(*[F.col(c).alias(f"__{c}") for c in by], "__first")
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return all_.join(first, same).withColumn("rank", F.col("rank") - F.col("__first")).drop("__first", *[f"__{c}" for c in by])


def chunk_digests(df: DataFrame, key: str, rows: int = 4096) -> DataFrame:
    """Digests of a relation in chunks of its key order: chunk, n, digest. Chunks are cut by rank inside key ranges.

    The chunk of a row is its rank over the whole relation; ranks come from a range partitioning and the sizes of
    earlier ranges, so no task sorts everything.
    """
    cols = sorted(df.columns)
    hashed = df.select(F.col(key).alias("k"), F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]), 256).alias("h"))
    per = ranked(hashed, "k", "h").groupBy(F.floor(F.col("rank") / rows).alias("chunk"))
    return per.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("rank", "h"))), lambda x: x["h"])), 256).alias("digest"))


def presented(kind: Column, value: Column, mode: str = "source", most: int = 80) -> Column:
    """A literal's rendering without evaluating it: quoted text, plain numbers and names, others by their kind; long ones cut."""
    quoted = F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'"))
    shown = F.when(kind == "text", quoted).when(kind.isin("int", "float", "bool", "none", "name"), value).otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    cut = F.when(F.length(shown) > most, F.concat(F.substring(shown, 1, most - 1), F.lit("…"))).otherwise(shown)
    return cut if mode == "source" else F.concat(kind, F.lit(":"), cut)

"""Join rules: references, first, nearest and optional pairs, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reference(df: DataFrame, fk: str, target: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Follow a scalar reference."""
    return df.join(target, df[fk] == target[key], how)


def owned_reverse(owner: DataFrame, key: str, member: DataFrame, fk: str) -> DataFrame:
    """From owners to what refers to them."""
    return owner.join(member, owner[key] == member[fk])


def list_reference(df: DataFrame, source: str, fks: str) -> DataFrame:
    """One row per element of a list reference: source_id, ordinal, target_id."""
    return df.select(F.col(source).alias("source_id"), F.posexplode(fks).alias("ordinal", "target_id"))


def first_pairs(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def optional_pairs(df: DataFrame, *steps: tuple[DataFrame, Column]) -> DataFrame:
    """A chain of left outer joins; a row is kept whatever its partners."""
    for other, on in steps:
        df = df.join(other, on, "left")
    return df


def nearest_earlier(df: DataFrame, by: str, at: str, key: str, wanted: Column) -> DataFrame:
    """For each row the latest earlier row of the same group for which `wanted` holds: one pass, no self join."""
    mark = F.when(wanted, F.struct(F.col(at).alias("at"), F.col(key).alias("key")))
    w = Window.partitionBy(by).orderBy(at, key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("nearest", F.last(mark, ignorenulls=True).over(w))


def _level(width: Column) -> Column:
    """The least level whose cells, of 2**level, are wider than a span."""
    return F.when(width == 0, 0).otherwise(F.length(F.bin(width))).cast("int")


def span_index(spans: DataFrame, by: str) -> DataFrame:
    """(by, level, cell, outer_id, s, e): every span once, at the level of its length, in the cell of its start. spans: by, id, start, stop; those that end before they start hold nothing and are left out."""
    o = spans.select(by, F.col("id").alias("outer_id"), F.col("start").cast("long").alias("s"), F.col("stop").cast("long").alias("e")).filter("e >= s")
    o = o.withColumn("level", _level(F.col("e") - F.col("s")))
    return o.withColumn("cell", F.expr("shiftright(s, level)"))


def contained(outer: DataFrame, inner: DataFrame, by: str) -> DataFrame:
    """Pairs of (by, outer_id, inner_id) with the inner span inside the outer one.

    outer and inner: by, id, start, stop. A range join over dyadic levels: a span that is no longer than a cell of its
    level reaches into the cell of its start and the next at most, so an inner span looks up, of each level that occurs,
    the cell of its start and the one before. A long span is stored once like any other, and of what a look-up meets a fixed
    share is near: no cell is wider than twice its spans. Spark splits the join where a cell is hot.
    """
    index = span_index(outer, by)
    levels = sorted(r[0] for r in index.select("level").distinct().collect())  # 64 at most
    i = inner.select(by, F.col("id").alias("inner_id"), F.col("start").cast("long").alias("p"), F.col("stop").cast("long").alias("q"))
    kept = f"filter(array({', '.join(f'{j}' for j in levels)}), j -> j >= least)" if levels else "cast(array() as array<int>)"
    asked = F.expr(f"flatten(transform({kept}, j -> array(struct(j as level, shiftright(p, j) as cell), struct(j as level, shiftright(p, j) - 1 as cell))))")
    # An outer span is no shorter than what it holds, nor is its level less.
    i = i.withColumn("least", _level(F.greatest(F.col("q") - F.col("p"), F.lit(0)))).withColumn("at", F.explode(asked)).select(by, "inner_id", "p", "q", "at.level", "at.cell")
    # Spark takes exploded rows for as many as there were before, and would broadcast look-ups that it believes to be few.
    return index.join(i.hint("merge"), [by, "level", "cell"]).filter("p >= s and q <= e").select(by, "outer_id", "inner_id", "s", "e", "p", "q")


def innermost(pairs: DataFrame) -> DataFrame:
    """Per inner span the smallest outer one; equally small ones make it ambiguous. pairs comes from `contained`.

    Widths are counted first, then the least is taken: two partial aggregates, and no inner span's pairs meet in one place.
    """
    widths = pairs.groupBy("inner_id", (F.col("e") - F.col("s")).alias("width")).agg(F.count("*").alias("n"), F.min("outer_id").alias("outer_id"))
    best = widths.groupBy("inner_id").agg(F.min(F.struct("width", "n", "outer_id")).alias("b"))
    one = F.col("b.n") == 1
    return best.select("inner_id", F.when(one, F.col("b.outer_id")).alias("outer_id"), F.when(one, "resolved").otherwise("ambiguous").alias("status"))


def best_pairs(df: DataFrame, pair: list[str], score: str, ties: list[str]) -> DataFrame:
    """Of several matches of a pair the best score, ties by the given keys."""
    return first_pairs(df, pair, [F.desc(score), *[F.col(t) for t in ties]])


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with no partner."""
    return df.join(other, keys, "left_anti")


def having(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a partner, once each."""
    return df.join(other, keys, "left_semi")

"""Validation by anti-joins: keys, references, whole models, readback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_references(df: DataFrame, fk: str, target: DataFrame, key: str) -> DataFrame:
    """Non-null references without a target, and how many rows hold each: aggregated before the anti join."""
    used = df.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("n"))
    return used.join(target.select(F.col(key).alias(fk)), fk, "left_anti")


def wrong_subtypes(df: DataFrame, fk: str, target: DataFrame, key: str, tag: str, code) -> DataFrame:
    """Non-null references without a target of the given tag, and how many rows hold each."""
    return missing_references(df, fk, target.filter(F.col(tag) == F.lit(code)), key)


def content_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (n, digest): what rows a relation holds, however often each and in whatever order.

    Each row's framed columns are hashed with SHA-256; the eight words of the hashes are added up apart, so that tasks
    aggregate before the shuffle and nothing is sorted. Equal relations agree; n takes part in the digest.
    """
    from tessera.functions.text import framed

    h = df.select(F.sha2(framed(*[F.col(c) for c in columns or sorted(df.columns)]), 256).alias("h"))
    word = lambda i: F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    sums = h.agg(F.count("*").alias("n"), *[word(i).alias(f"w{i}") for i in range(8)])
    return sums.select("n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(8)]), 256).alias("digest"))


def model_digest(relations: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """One row (digest) of a whole model: its relations' names and digests in the order of their names."""
    parts = [content_digest(df, (columns or {}).get(r)).select(F.struct(F.lit(r).alias("relation"), "digest").alias("x")) for r, df in sorted(relations.items())]
    return reduce(DataFrame.union, parts).agg(F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws(":", x["relation"], x["digest"]))), 256).alias("digest"))


def null_required(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per required column that holds nulls: column_name, n."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("column_name", "n")).filter("n > 0")


def violations(df: DataFrame, rule: str, ok: Column, key: str) -> DataFrame:
    return df.filter(~F.coalesce(ok, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))


def replay(
    relations: dict[str, DataFrame], keys: dict[str, list[str]], references: list[tuple[str, str, str, str]],
    subtypes: list[tuple[str, str, str, str, str, object]] = (), invariants: list[tuple[str, str, Column]] = (),
) -> DataFrame:
    """All findings of a model: (kind, relation, detail, n). Nothing comes back from a valid one.

    subtypes: (relation, fk, target, key, tag, code); invariants: (relation, rule, condition that each row has to meet).
    """
    parts = [duplicate_keys(relations[r], k).agg(F.count("*").alias("n")).select(F.lit("duplicate_key").alias("kind"), F.lit(r).alias("relation"), F.lit(",".join(k)).alias("detail"), "n") for r, k in keys.items()]
    parts += [missing_references(relations[r], fk, relations[t], key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("missing_reference").alias("kind"), F.lit(r).alias("relation"), F.lit(f"{fk}->{t}.{key}").alias("detail"), "n") for r, fk, t, key in references]
    parts += [wrong_subtypes(relations[r], fk, relations[t], key, tag, code).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("wrong_subtype").alias("kind"), F.lit(r).alias("relation"), F.lit(f"{fk}->{t}.{key}:{tag}={code}").alias("detail"), "n") for r, fk, t, key, tag, code in subtypes]
    parts += [relations[r].agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("n")).select(F.lit("invariant").alias("kind"), F.lit(r).alias("relation"), F.lit(rule).alias("detail"), "n") for r, rule, ok in invariants]
    return reduce(DataFrame.union, parts).filter("n > 0")


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side holds more often than the other, with the side and by how many. One shuffle, no exceptAll twice."""
    cols = left.columns
    both = left.withColumn("__d", F.lit(1)).unionByName(right.select(*cols).withColumn("__d", F.lit(-1)))
    diff = both.groupBy(*cols).agg(F.sum("__d").alias("d")).filter("d <> 0")
    return diff.select(*cols, F.when(F.col("d") > 0, "left").otherwise("right").alias("side"), F.abs("d").alias("n"))


def typed(df: DataFrame, contract: StructType) -> DataFrame:
    """df as the columns that a contract declares, in its order: each field there and of its type, or an error that names it.

    Where a field is declared without nulls, a null ends the job when it is read not before.
    """
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: missing" if f.name not in have else f"{f.name}: {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in contract if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError("; ".join(wrong))
    bad = lambda f: F.raise_error(F.lit(f"{f.name}: null")).cast(f.dataType)
    return df.select(*[F.col(f.name) if f.nullable else F.coalesce(F.col(f.name), bad(f)).alias(f.name) for f in contract])

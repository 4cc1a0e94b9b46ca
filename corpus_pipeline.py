"""A corpus pipeline: each stage's output is written as Parquet and is the next one's documents.

Stages: language ID, n-gram Jaccard join, suffix-array dedup, mixing sources to target weights, BPE encoding and
decoding. SQL can't express them (a learned model, byte spans, token ids), so there is no ORACLE_SQL; tests hold
`run` against brute-force versions of the stages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_codec, jaccard_join, language_id, shared, source_mix, suffix_dedup
from tessera.llm.queries import tokenizer_path

ORACLE_SQL = None
LEAST_SCORE = 0.1
SMALL_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no learned language fits, go; short and mixed ones stay."""
    return language_id.keep_identified(docs, language_id.fit(docs), LEAST_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that of the least (doc_id, class), null ids last. Of rows without a word, equal ones stay once.

    Decided per row: ids that no other row has name their row; rows that share an id, or have none, are told apart by their class.
    """
    placed = shared.settle(jaccard_join.placed(docs.select("doc_id", "text")), "placed")
    worded = placed.filter("n > 0").withColumn("place", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "cls"))
    first = shared.settle(worded.groupBy("root").agg(F.min("place").alias("first")), "first")
    later = shared.settle(shared.join_facts(worded, first, "root").filter("place > first").select("doc_id", "cls").distinct(), "later")
    doubted = shared.settle(placed.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "doubted")
    if doubted.isEmpty():
        return _without(docs, later.select("doc_id"), "doc_id")
    clear = _without(_without(docs, doubted, "doc_id"), later.select("doc_id").distinct(), "doc_id")
    shares = doubted.filter("doc_id is not null").withColumnRenamed("doc_id", "shared_id")
    some = docs.join(F.broadcast(shares) if shares.count() <= SMALL_IDS else shares, docs["doc_id"] == F.col("shared_id"), "left_semi")
    if not doubted.filter("doc_id is null").isEmpty():
        some = some.union(docs.filter("doc_id is null"))
    at = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    rows = jaccard_join.with_class(some.dropDuplicates(["doc_id", "text"])).withColumns({"doc_id": at["doc_id"].cast("long"), "h": F.xxhash64(at["text"])})
    rows = shared.settle(_without(rows, later, "doc_id", "cls"), "rows")
    # Texts of one class under one id: one of them stays.
    same = rows.filter("n > 0").groupBy("doc_id", "cls").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least < most")
    extra = rows.filter("n > 0").join(same.select(F.col("doc_id").alias("d"), F.col("cls").alias("c"), "least"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("cls") == F.col("c"))).filter("h > least").select("doc_id", "cls", "h").distinct()
    kept = _without(rows, shared.settle(extra, "extra"), "doc_id", "cls", "h")
    return clear.union(kept.select(*[at[c].alias(c) for c in docs.columns]))


def _without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not in gone; null equals null. gone: a settled table, or columns of one."""
    other = gone.select(*[F.col(k).alias(f"gone_{k}") for k in keys])
    on = reduce(lambda p, q: p & q, [rows[k].eqNullSafe(other[f"gone_{k}"]) for k in keys])
    return rows.join(F.broadcast(other) if gone.count() <= SMALL_IDS else other, on, "left_anti")


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that an earlier document holds; documents left without a word go."""
    return suffix_dedup.remove_repeats(docs).filter("text rlike '[^ \\\\t-\\\\r]'").withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some more than once, some not at all."""
    return source_mix.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text decoded from them."""
    return bpe_codec.transcode(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", dedup_passages),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared.settle(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

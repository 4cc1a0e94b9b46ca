"""Judgement of finite evaluation cases: whether readable evidence decides what a task asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(cases: DataFrame, needs: DataFrame, evidence: DataFrame, worlds: DataFrame) -> DataFrame:
    """(case, applicability, epistemic, missing), one row a case.

    cases: case, intent, status, completeness, bytes, max_bytes. needs: case, predicate, role, text: a predicate is
    met by evidence (case, role, text, context) of its role and one of its texts. All predicates have to be met in one
    context. worlds: case, context, answer: those of a context that meets all predicates have to give one answer.
    """
    wanted = needs.groupBy("case").agg(F.count_distinct("predicate").alias("wanted"))
    met = needs.join(evidence, ["case", "role", "text"]).select("case", "predicate", "context").distinct()
    some = met.groupBy("case").agg(F.count_distinct("predicate").alias("met"))
    whole = met.groupBy("case", "context").agg(F.count("*").alias("n")).join(wanted, "case").filter("n = wanted").select("case", "context")
    proven = whole.groupBy("case").agg(F.lit(True).alias("proven"))
    modelled = worlds.groupBy("case").agg(F.lit(True).alias("modelled"))
    answers = worlds.join(whole, ["case", "context"]).groupBy("case").agg(F.count_distinct("answer").alias("answers"))
    j = cases
    for side in (wanted, some, proven, modelled, answers):
        j = j.join(side, "case", "left")
    missing = F.coalesce(F.col("wanted"), F.lit(0)) - F.coalesce(F.col("met"), F.lit(0))
    applies = (
        F.when(F.col("max_bytes") <= 0, "invalid_task").when(F.col("intent") == "not_applicable", "not_applicable").when(F.col("status") != "completed", "applicable")
        .when(F.col("completeness") == "unsupported", "unsupported").when(F.col("completeness") == "incomplete", "incomplete").otherwise("applicable")
    )
    lacking = (F.coalesce("wanted", F.lit(0)) > 0) & F.col("proven").isNull()
    epistemic = (
        F.when(F.col("max_bytes") <= 0, "inconclusive").when(F.col("intent") == "not_applicable", "not_applicable").when((F.col("status") != "completed") | (F.col("completeness") != "complete"), "inconclusive")
        .when(F.col("bytes") > F.col("max_bytes"), "budget_infeasible").when(F.col("modelled") & F.col("proven") & F.col("answers").isNull(), "inconsistent_model").when(F.col("answers") > 1, "insufficient")
        .when(lacking, "insufficient").when(F.col("intent") == "unknown", "model_relative_unknown").otherwise("sufficient")
    )
    return j.select("case", applies.alias("applicability"), epistemic.alias("epistemic"), missing.alias("missing"))

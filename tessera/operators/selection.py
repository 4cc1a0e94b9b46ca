"""Four-valued selection: requirements over observations, outcomes over requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(observations: DataFrame, domain: DataFrame, quantifier: str = "any") -> DataFrame:
    """Per candidate: outcome and reason of one requirement.

    observations: candidate, context, basis, value (true, false or null for unknown). domain: candidate, closed.
    Values of one (context, basis) that hold both true and false conflict. In this order: an all-quantifier with a
    negative is contradicted; any conflict is conflicting; an any-quantifier with a positive is supported; closed
    and empty is contradicted; closed without unknowns and all negative is contradicted; an all-quantifier, closed,
    without unknowns is supported; what is left is unresolved.
    """
    if quantifier not in ("any", "all"):
        raise ValueError("quantifier is any or all")
    per = observations.groupBy("candidate", "context", "basis").agg(
        F.max(F.when(F.col("value"), 1).otherwise(0)).alias("yes"), F.max(F.when(~F.col("value"), 1).otherwise(0)).alias("no"), F.max(F.when(F.col("value").isNull(), 1).otherwise(0)).alias("unknown")
    )
    flags = per.groupBy("candidate").agg(
        F.count("*").alias("n"), F.max(F.col("yes") * F.col("no")).alias("conflict"), F.max("yes").alias("yes"), F.max("no").alias("no"),
        F.max(F.when((F.col("unknown") == 1) & (F.col("yes") + F.col("no") == 0), 1).otherwise(0)).alias("unknown"),
    )
    d = domain.join(flags, "candidate", "left").fillna(0, ["n", "conflict", "yes", "no", "unknown"])
    every = quantifier == "all"
    is_ = lambda c: F.col(c) == 1
    case = F.when(F.lit(every) & is_("no"), "contradicted:counterexample").when(is_("conflict"), "conflicting:conflict")
    case = case.when(F.lit(not every) & is_("yes"), "supported:witness").when(F.col("closed") & (F.col("n") == 0), "contradicted:no_applicable_domain")
    case = case.when(F.col("closed") & ~is_("unknown") & ~is_("yes"), "contradicted:closed_absence")
    case = case.when(F.lit(every) & F.col("closed") & ~is_("unknown"), "supported:exhaustive").otherwise("unresolved:open")
    return d.select("candidate", F.split_part(case, F.lit(":"), F.lit(1)).alias("outcome"), F.split_part(case, F.lit(":"), F.lit(2)).alias("reason"))


def combined(outcome: Column) -> Column:
    """Aggregate of requirement outcomes: contradicted before conflicting before unresolved before supported."""
    has = lambda v: F.max(F.when(outcome == v, 1).otherwise(0)) == 1
    return F.when(has("contradicted"), "contradicted").when(has("conflicting"), "conflicting").when(has("unresolved"), "unresolved").otherwise("supported")


def selected(outcomes: DataFrame, mode: str = "discovery") -> DataFrame:
    """Candidates that a mode keeps: discovery leaves out the contradicted, strict keeps the supported."""
    return outcomes.filter("outcome <> 'contradicted'" if mode == "discovery" else "outcome = 'supported'")


def joint_contexts(admissible: DataFrame, requirements: int) -> DataFrame:
    """(candidate, context) that all requirements admit. admissible: candidate, requirement, context."""
    return admissible.groupBy("candidate", "context").agg(F.count_distinct("requirement").alias("n")).filter(F.col("n") == requirements).select("candidate", "context")

"""Named queries over the driver's tables and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "rrf_fusion"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(oracle: str | None = None, name: str | None = None):
    """Add a query, called with a function that opens a table by name."""

    def add(f: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(spark, lambda t: table(spark, sf_dir, t))
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


from tessera.plans import assessed, graphs, normalized, relational, retrieval, selections  # noqa: E402, F401  (they register their queries)

"""Read-only SQL over a session, and a catalog of captured relations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

_REFUSED = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")


class Refused(ValueError):
    """A request that the engine does not serve."""


def query(spark: SparkSession, sql: str, args: dict[str, Any] | list | None = None) -> DataFrame:
    """Plan one SELECT; everything that defines, changes or sets something is refused before it runs.

    Values come in as parameters (:name or ?), never as text, so a value can't become SQL.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    jvm = spark._jvm
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    kinds = [jvm.java.lang.Class.forName(k, True, loader) for k in _REFUSED]
    todo = [plan]
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds):
            raise Refused("only SELECT is served")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return spark.sql(sql, args=args) if args is not None else spark.sql(sql)


class Catalog:
    """Relations captured once: an alias never changes what it stands for, and private ones may be added once."""

    def __init__(self, spark: SparkSession, base: str, names: tuple[str, ...] = ()):
        self.spark, self.base = spark, base
        self.captured = set(names)
        self._open: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """Resolve on first use; nothing is read until an action."""
        if name not in self._open:
            if name not in self.captured:
                raise Refused(f"no relation {name}")
            self._open[name] = self.spark.read.parquet(f"{self.base}/{name}.parquet")
        return self._open[name]

    def register(self, name: str, df: DataFrame) -> None:
        if name in self.captured or name in self._open:
            raise Refused(f"{name} is taken and can't be replaced")
        self._open[name] = df

    def drop(self, name: str) -> None:
        if name in self.captured:
            raise Refused(f"{name} is captured and can't be dropped")
        if self._open.pop(name, None) is not None:
            self.spark.catalog.dropTempView(name)

    def query(self, sql: str, args: dict[str, Any] | None = None, using: tuple[str, ...] = ()) -> DataFrame:
        """A SELECT over the named relations (`using`), in this catalog's meaning of them."""
        for name in using:
            self.table(name).createOrReplaceTempView(name)
        return query(self.spark, sql, args)


def by_ids(df: DataFrame, key: str, ids: list | None) -> DataFrame:
    """Rows of a finite demand; an empty demand selects nothing, None everything. Reaches the scan as IN."""
    if ids is None:
        return df
    known = [i for i in ids if i is not None]
    return df.where(df[key].isin(known)) if known else df.limit(0)


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending, nulls last, text by code point."""
    return df.orderBy(*[df[c].asc_nulls_last() for c in columns])

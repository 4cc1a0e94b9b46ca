"""Scope predicates as column expressions; Catalyst prunes columns and pushes what a scan can take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def equals(column: str, value) -> Column:
    return F.col(column) == F.lit(value)


def differs(column: str, value) -> Column:
    return F.col(column) != F.lit(value)


def one_of(column: str, values: list) -> Column:
    return F.col(column).isin(values) if values else F.lit(False)


def none_of(column: str, values: list) -> Column:
    return ~F.col(column).isin(values) if values else F.lit(True)


def suffix(column: str, *ends: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).endswith(e) for e in ends], F.lit(False))


def is_null(column: str, null: bool = True) -> Column:
    return F.col(column).isNull() if null else F.col(column).isNotNull()


def same(a: str, b: str) -> Column:
    """Plain equality; null equals nothing."""
    return F.col(a) == F.col(b)


def equals_first(column: str, primary: str, fallback: str) -> Column:
    return F.col(column) == F.coalesce(F.col(primary), F.col(fallback))


def span_contains(outer_start: Column, outer_end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (inner_start >= outer_start) & (inner_end <= outer_end)


def path_prefix(parent: Column, child: Column) -> Column:
    return F.slice(child, 1, F.size(parent)) == parent


def body_contains(parent: str, child: str) -> Column:
    """parent and child are aliases of rows with source, start, stop, path."""
    c = lambda x, f: F.col(f"{x}.{f}")
    return (c(parent, "source") == c(child, "source")) & span_contains(c(parent, "start"), c(parent, "stop"), c(child, "start"), c(child, "stop")) & path_prefix(c(parent, "path"), c(child, "path"))


def qualified(wanted: Column, module: Column, leaf: Column) -> Column:
    return wanted == F.concat_ws(".", module, leaf)


def parameter_in(column: str, name: str) -> str:
    """SQL text for a list parameter; an empty list selects nothing."""
    return f"array_contains(:{name}, {column})"

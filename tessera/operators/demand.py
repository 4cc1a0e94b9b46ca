"""Finite demand of ids in a filter: which keys it can ask for at most, and what is left to test once they are read.

A filter is a tuple: ("eq", column, value), ("in", column, values), ("not_in", column, values), ("compare", column,
operator, value), ("like", column, pattern), ("null", column), ("and", *filters), ("or", *filters), ("not", filter).
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<>": lambda a, b: a != b}

#: The relation that each kind of selection predicate ranges over.
DOMAINS = {
    "public_exposures": ["behavioral_raises", "public_path", "public_module", "class_owner", "member_kind", "invocation_form"],
    "signature_variants": ["declares_parameter", "parameter_kind", "parameter_required", "parameter_default_state", "parameter_default", "parameter_type", "variant_parameter_type", "variant_return_type", "specialized_type"],
    "configuration_fields": ["declares_configuration_field", "configuration_owner", "configuration_scope", "configuration_record_kind", "configuration_default", "configuration_literal", "configuration_relationship"],
    "relationships": ["relationship"],
    "scenarios": ["scenario_intent", "scenario_check"],
    "source_artifacts": ["source_alignment"],
    "release_declarations": ["release_version"],
}


def compiled(expr: tuple) -> Column:
    """The filter as a column expression, for Catalyst to push down."""
    kind, *rest = expr
    if kind == "eq":
        return F.col(rest[0]) == F.lit(rest[1])
    if kind == "in":
        return F.col(rest[0]).isin(list(rest[1])) if rest[1] else F.lit(False)
    if kind == "not_in":
        return ~F.col(rest[0]).isin(list(rest[1])) if rest[1] else F.lit(True)
    if kind == "compare":
        return _COMPARE[rest[1]](F.col(rest[0]), F.lit(rest[2]))
    if kind == "like":
        return F.col(rest[0]).like(rest[1])
    if kind == "null":
        return F.col(rest[0]).isNull()
    if kind == "not":
        return ~compiled(rest[0])
    if kind in ("and", "or"):
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), map(compiled, rest))
    raise ValueError(f"unknown filter {kind}")


def columns(expr: tuple) -> set[str]:
    """Columns that the filter reads."""
    kind, *rest = expr
    return set().union(*map(columns, rest)) if kind in ("and", "or", "not") else {rest[0]}


def keys(expr: tuple, key: str) -> frozenset | None:
    """The keys that the filter can accept at most; None where it sets no finite bound.

    Equality and membership bound it, a conjunction by what its sides have in common; a disjunction and a negation never
    do. Null equals nothing, so it adds no key.
    """
    kind, *rest = expr
    if kind == "eq" and rest[0] == key:
        return frozenset() if rest[1] is None else frozenset([rest[1]])
    if kind == "in" and rest[0] == key:
        return frozenset(v for v in rest[1] if v is not None)
    if kind == "and":
        found = [k for k in (keys(x, key) for x in rest) if k is not None]
        return frozenset.intersection(*found) if found else None
    return None


def exact(expr: tuple, key: str) -> bool:
    """Whether membership in its keys says all that the filter says, so that nothing is left to test."""
    return all(exact(x, key) for x in expr[1:]) if expr[0] == "and" else keys(expr, key) is not None


def described(key: str):
    """Of filters as JSON, a row each: (keys, exact, reads), as `keys`, `exact` and `columns` say; each distinct filter of a batch once."""

    def one(text: str | None) -> tuple:
        if text is None:
            return None, None, None
        expr = _tuples(json.loads(text))
        found = keys(expr, key)
        return None if found is None else sorted(found), exact(expr, key), sorted(columns(expr))

    fields = T.StructType([T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("exact", T.BooleanType()), T.StructField("reads", T.ArrayType(T.StringType()))])

    @F.pandas_udf(fields)
    def describe(filters: pd.Series) -> pd.DataFrame:
        known = {x: one(x) for x in filters.drop_duplicates()}
        return pd.DataFrame([known[x] for x in filters], columns=["keys", "exact", "reads"], dtype=object)

    return describe


def _tuples(expr: list) -> tuple:
    """A filter's lists, but for its values, as tuples."""
    kind, *rest = expr
    return (kind, *map(_tuples, rest)) if kind in ("and", "or", "not") else (kind, *rest)


def demanded(filters: list[tuple], key: str) -> tuple[frozenset | None, list[tuple]]:
    """(keys that all filters together can accept, filters that remain to be tested)."""
    found = [k for k in (keys(x, key) for x in filters) if k is not None]
    return (frozenset.intersection(*found) if found else None), [x for x in filters if not exact(x, key)]


def scan(relation: DataFrame, filters: list[tuple], key: str) -> DataFrame:
    """Rows that pass all filters: read by key where the demand is finite, then tested by what remains."""
    wanted, rest = demanded(filters, key)
    out = relation if wanted is None else relation.filter(compiled(("in", key, sorted(wanted))))
    return reduce(lambda df, x: df.filter(compiled(x)), rest, out)


def domain(predicate: str, value_domain: str | None = None, field: str | None = None) -> str:
    """The relation that a selection predicate ranges over. A facet's follows its value, a declaration's its field."""
    if predicate == "facet_membership":
        if value_domain not in DOMAINS:
            raise ValueError("a facet's value names its domain")
        return value_domain
    if predicate == "deployment_declaration":
        return "source_artifacts" if field in ("launch", "configuration") else "release_declarations"
    for name, kinds in DOMAINS.items():
        if predicate in kinds:
            return name
    raise ValueError(f"unknown predicate {predicate}")


def routed(predicates: list[tuple[str, Column]], relations: dict[str, DataFrame], key: str) -> DataFrame:
    """(domain, key) of the rows that pass all predicates of their domain: each relation is scanned once."""
    by: dict[str, list[Column]] = {}
    for name, test in predicates:
        by.setdefault(domain(name), []).append(test)
    parts = [relations[d].filter(reduce(lambda a, b: a & b, tests)).select(F.lit(d).alias("domain"), F.col(key)) for d, tests in sorted(by.items())]
    return reduce(DataFrame.unionByName, parts).distinct()

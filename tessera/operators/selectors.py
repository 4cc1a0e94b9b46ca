"""Selection predicates compiled to one grouping of facts over their domain.

A selection is a tree: ("all", *trees), ("any", *trees), ("not", tree), or a predicate (kind, {field: value}). Each kind
ranges over one domain, reads one relation, and compares some of its columns; `KINDS` says which. A relation has a column
`entity` and a row for each fact, so a predicate holds for an entity if some fact of it fits. Members and facts that fit
meet once: each predicate of a selection is a flag, an entity's flags are taken together, and the tree is a condition on them. A null entity has no facts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.demand import domain as domain_of

#: The relation that a kind of predicate reads, and the columns that it compares.
KINDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "behavioral_raises": ("raises", ("exception",)),
    "public_path": ("exposures", ("path",)),
    "public_module": ("exposures", ("module",)),
    "class_owner": ("exposures", ("owner",)),
    "member_kind": ("exposures", ("kind",)),
    "invocation_form": ("exposures", ("form",)),
    "declares_parameter": ("parameters", ("name",)),
    "parameter_kind": ("parameters", ("name", "kind")),
    "parameter_required": ("parameters", ("name", "required")),
    "parameter_default_state": ("parameters", ("name", "default_state")),
    "parameter_default": ("parameters", ("name", "default")),
    "parameter_type": ("parameters", ("name", "type")),
    "variant_parameter_type": ("parameters", ("role", "name", "type")),
    "variant_return_type": ("returns", ("role", "type")),
    "specialized_type": ("specializations", ("site", "declaration", "subject", "type")),
    "declares_configuration_field": ("configuration", ("name",)),
    "configuration_owner": ("configuration", ("owner",)),
    "configuration_scope": ("configuration", ("scope",)),
    "configuration_record_kind": ("configuration", ("record_kind",)),
    "configuration_default": ("configuration", ("name", "default")),
    "configuration_literal": ("literals", ("name", "value")),
    "configuration_relationship": ("field_relationships", ("name", "kind", "target")),
    "relationship": ("relationships", ("role", "target", "fidelity")),
    "facet_membership": ("facets", ("facet", "value")),
    "scenario_intent": ("scenarios", ("intent",)),
    "scenario_check": ("checks", ("check", "status")),
    "source_alignment": ("sources", ("exact",)),
    "release_version": ("releases", ("distribution", "version")),
    "deployment_declaration": ("declarations", ("field", "name")),
}


class Refused(ValueError):
    pass


def _domain(kind: str, fields: Mapping) -> str:
    if kind not in KINDS:
        raise Refused(f"unknown predicate {kind}")
    return domain_of(kind, fields.get("domain"), fields.get("field"))


def domains(tree: tuple) -> set[str]:
    """The domains that a selection's predicates range over."""
    if tree[0] in ("all", "any", "not"):
        return set().union(*map(domains, tree[1:])) if tree[1:] else set()
    return {_domain(*tree)}


def _fits(kind: str, fields: Mapping) -> Column:
    """Null is a value that can be asked for; lists are compared whole."""
    wanted = KINDS[kind][1]
    given = {k for k in fields if not (kind == "facet_membership" and k == "domain")}
    if given != set(wanted):
        raise Refused(f"{kind} compares {', '.join(wanted)}")
    literal = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(literal(fields[c])) for c in wanted])


def _leaves(tree: tuple) -> list[tuple]:
    return [x for t in tree[1:] for x in _leaves(t)] if tree[0] in ("all", "any", "not") else [tree]


def _holds(tree: tuple, flag: Iterator[Column]) -> Column:
    """The tree as a condition on its predicates' flags, which come in the order of the leaves."""
    op, *rest = tree
    if op not in ("all", "any", "not"):
        return next(flag)
    parts = [_holds(t, flag) for t in rest]
    if op == "not":
        return ~parts[0]
    return reduce(lambda a, b: a & b if op == "all" else a | b, parts, F.lit(op == "all"))


def _entities(tree: tuple, candidates: DataFrame, relations: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct candidates (entity) that the tree holds for."""
    leaves = _leaves(tree)
    flags = lambda on: [F.coalesce(c, F.lit(False)).alias(f"p{i}") for i, c in enumerate(on)]
    kind = candidates.schema["entity"].dataType
    rows = candidates.select("entity", F.lit(True).alias("member"), *flags([F.lit(False)] * len(leaves)))
    for relation in dict.fromkeys(KINDS[k][0] for k, _ in leaves):
        if relation not in relations:
            raise Refused(f"no relation {relation}")
        fits = [_fits(k, fields) if KINDS[k][0] == relation else F.lit(False) for k, fields in leaves]
        facts = relations[relation].filter(F.col("entity").isNotNull()).select("entity", F.lit(False).alias("member"), *flags(fits))
        rows = rows.union(facts.filter(reduce(lambda a, b: a | b, [F.col(f"p{i}") for i in range(len(leaves))])))
    names = ["member", *[f"p{i}" for i in range(len(leaves))]]
    met = rows.groupBy("entity").agg(*[F.bool_or(c).alias(c) for c in names])
    return met.filter(F.col("member") & _holds(tree, iter([F.col(c) for c in names[1:]]))).select(F.col("entity").cast(kind).alias("entity"))


def selected(tree: tuple, members: Mapping[str, DataFrame], relations: Mapping[str, DataFrame]) -> DataFrame:
    """(domain, entity) that a selection of one domain holds for. members: each domain's entities; relations: as KINDS names them.

    A selection over several domains is refused: select each for itself (`selected_all`).
    """
    found = domains(tree)
    if len(found) != 1:
        raise Refused("a selection ranges over one domain")
    name = found.pop()
    if name not in members:
        raise Refused(f"no members of {name}")
    return _entities(tree, members[name].select("entity"), relations).select(F.lit(name).alias("domain"), "entity")


def selected_all(trees: list[tuple], members: Mapping[str, DataFrame], relations: Mapping[str, DataFrame]) -> DataFrame:
    """(domain, entity) of several selections, those of one domain taken together: an entity has to pass all of them."""
    by: dict[str, list[tuple]] = {}
    for t in trees:
        found = domains(t)
        if len(found) != 1:
            raise Refused("a selection ranges over one domain")
        by.setdefault(found.pop(), []).append(t)
    return reduce(DataFrame.union, [selected(("all", *ts), members, relations) for _, ts in sorted(by.items())])

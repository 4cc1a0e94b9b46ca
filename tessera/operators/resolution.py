"""Resolution of names to candidates; ambiguity stays visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decision(n: Column, incomplete: Column | None = None) -> Column:
    status = F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    return status if incomplete is None else F.when((n == 1) & incomplete, "ambiguous").otherwise(status)


def resolve(observations: DataFrame, key: str, name: str, candidates: DataFrame, candidate: str, candidate_name: str) -> DataFrame:
    """Every observation with the number of candidates of its name, the only one if it is one, and the status.

    Candidates are counted per name before they meet the observations, so a frequent name costs one row.
    """
    per = candidates.filter(F.col(candidate_name).isNotNull()).groupBy(F.col(candidate_name).alias("__name")).agg(F.count_distinct(candidate).alias("candidates"), F.min(candidate).alias("__only"))
    out = observations.select(key, name).join(per, F.col(name) == F.col("__name"), "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.select(key, name, "candidates", F.when(F.col("candidates") == 1, F.col("__only")).alias("target"), decision(F.col("candidates")).alias("status"))


def worst_status(status: Column) -> Column:
    """Aggregate: unresolved before ambiguous before resolved."""
    rank = F.when(status == "unresolved", 2).when(status == "ambiguous", 1).otherwise(0)
    return F.element_at(F.array(F.lit("resolved"), F.lit("ambiguous"), F.lit("unresolved")), (F.max(rank) + 1).cast("int"))


def compared(left: DataFrame, right: DataFrame, key: str, slot: str, value: str) -> DataFrame:
    """Two contracts slot by slot: same, different, left_only, right_only, unresolved (a null value)."""
    a = left.select(key, slot, F.col(value).alias("l"), F.lit(True).alias("in_l"))
    b = right.select(key, slot, F.col(value).alias("r"), F.lit(True).alias("in_r"))
    j = a.join(b, [key, slot], "full")
    status = F.when(F.col("in_r").isNull(), "left_only").when(F.col("in_l").isNull(), "right_only").when(F.col("l").isNull() | F.col("r").isNull(), "unresolved").when(F.col("l") == F.col("r"), "same").otherwise("different")
    return j.select(key, slot, status.alias("status"))


def expanded(domain: DataFrame, outcomes: DataFrame, keys: list[str], default: str) -> DataFrame:
    """A compact default answers for every key without an outcome of its own."""
    return domain.join(outcomes, keys, "left").withColumn("outcome", F.coalesce("outcome", F.lit(default)))


def ancestry(classes: DataFrame, parents: DataFrame, max_depth: int = 64) -> DataFrame:
    """Ancestors of each class with their least depth and the worst status on the way: (class, ancestor, depth, status).

    parents: class, parent, status. A class is no ancestor of its own; cycles end as no pair is entered twice.
    """
    from tessera.operators.graph import _cut

    rank = F.when(F.col("status") == "unresolved", 2).when(F.col("status") == "ambiguous", 1).otherwise(0)
    step = _cut(parents.select(F.col("class").alias("c"), F.col("parent").alias("p"), rank.alias("r")))
    front = _cut(classes.select("class").join(step, F.col("class") == F.col("c")).groupBy("class", F.col("p").alias("ancestor")).agg(F.lit(1).alias("depth"), F.max("r").alias("r")).filter("class <> ancestor"))
    out = front
    for depth in range(2, max_depth + 1):
        nxt = front.withColumnRenamed("r", "r0").join(step, F.col("ancestor") == F.col("c")).groupBy("class", "p").agg(F.max(F.greatest("r0", "r")).alias("r"))
        nxt = nxt.select("class", F.col("p").alias("ancestor"), F.lit(depth).alias("depth"), "r").filter("class <> ancestor")
        front = _cut(nxt.join(out.select("class", "ancestor"), ["class", "ancestor"], "left_anti"))
        if front.isEmpty():
            break
        out = _cut(out.union(front))
    status = F.element_at(F.array(F.lit("resolved"), F.lit("ambiguous"), F.lit("unresolved")), (F.col("r") + 1).cast("int"))
    return out.select("class", "ancestor", "depth", status.alias("status"))


def mentions(found: DataFrame, vocabulary: DataFrame, links: DataFrame) -> DataFrame:
    """Mentions (doc, name) to exposures (name, exposure, context) in the contexts that the document is linked to (doc, context).

    Every candidate stays; status counts exposures per (doc, name, context).
    """
    j = found.join(links, "doc").join(vocabulary, ["name", "context"], "left")
    return j.groupBy("doc", "name", "context").agg(F.count_distinct("exposure").alias("candidates"), F.min("exposure").alias("first")).select(
        "doc", "name", "context", "candidates", F.when(F.col("candidates") == 1, F.col("first")).alias("exposure"), decision(F.col("candidates")).alias("status")
    )


def incoming(references: DataFrame, resolved: DataFrame, members: DataFrame) -> DataFrame:
    """Captured references (reference, ...) whose resolved target is a member. resolved: reference, target, status."""
    one = resolved.filter("status = 'resolved'").select("reference", "target")
    return references.join(one, "reference").join(members.select(F.col("member").alias("target")), "target", "left_semi")


def linearized(classes: DataFrame) -> DataFrame:
    """The method resolution order of each class where exactly one complete row gives it, else the reason.

    classes: class, order (array), complete.
    """
    per = classes.groupBy("class").agg(F.count_if("complete").alias("n"), F.max(F.when(F.col("complete"), F.col("order"))).alias("order"), F.count("*").alias("rows"))
    reason = F.when(F.col("n") == 0, "incomplete").when(F.col("n") > 1, "conflicting")
    return per.select("class", F.when(F.col("n") == 1, F.col("order")).alias("order"), reason.alias("reason"))


def dispatch(members: DataFrame, orders: DataFrame, name: str) -> DataFrame:
    """Which class of each order first defines a member: (class, owner). members: owner, name."""
    at = orders.filter("reason is null").select("class", F.posexplode("order").alias("place", "owner"))
    return at.join(members.filter(F.col("name") == name).select("owner"), "owner", "left_semi").groupBy("class").agg(F.min_by("owner", "place").alias("owner"))


def type_links(terms: DataFrame, resolutions: DataFrame, modules: DataFrame) -> DataFrame:
    """(term, entity, status, reason) of the terms that name something; others have no row.

    terms: term, kind, symbol, module. Terms of a class or function follow their symbol's resolution (symbol, entity,
    status), module terms an acquired module (module, entity); a reference to an alias names no entity.
    """
    by_symbol = terms.filter(F.col("symbol").isNotNull()).join(resolutions, "symbol", "left").withColumn("status", F.coalesce("status", F.lit("unresolved")))
    reason = F.when(F.col("status") == "resolved", "explicit_identity").when(F.col("status") == "ambiguous", "conflicting_candidates").otherwise("missing_correspondence")
    named = by_symbol.select("term", "entity", "status", reason.alias("reason"))
    by_module = terms.filter(F.col("symbol").isNull() & F.col("kind").isin("module", "alias")).join(modules, "module", "left")
    entity = F.when(F.col("kind") == "module", F.col("entity"))
    acquired = by_module.select("term", entity.alias("entity"), decision(entity.isNotNull().cast("int")).alias("status"))
    return named.unionByName(acquired.withColumn("reason", F.when(F.col("status") == "resolved", "explicit_identity").otherwise("missing_correspondence")))


def type_binders(variables: DataFrame, declarations: DataFrame) -> DataFrame:
    """(variable, declaration, status, reason): the innermost declarations around a variable's anchor.

    variables: variable, source, start, stop, origin, captured_bytes; declarations: declaration, source, start, stop,
    depth. Several of the same depth are ambiguous; without one the declaration is null.
    """
    from tessera.operators.joins import contained

    known = F.col("origin").isin("scoped", "declared")
    inside = F.col("captured_bytes").isNotNull() & (F.col("stop") <= F.col("captured_bytes"))
    asked = variables.filter(known & inside).select("source", F.col("variable").alias("id"), "start", "stop")
    pairs = contained(declarations.select("source", F.col("declaration").alias("id"), "start", "stop"), asked, "source")
    around = pairs.select(F.col("inner_id").alias("variable"), F.col("outer_id").alias("declaration")).distinct().join(declarations.select("declaration", "depth"), "declaration")
    deepest = around.groupBy("variable").agg(F.max("depth").alias("depth"))
    found = around.join(deepest, ["variable", "depth"]).select("variable", "declaration").distinct()
    counted = found.groupBy("variable").agg(F.count("*").alias("n"))
    j = variables.join(counted, "variable", "left").join(found, "variable", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(~known, "unsupported_native_origin").when(~F.coalesce(inside, F.lit(False)), "outside_captured_scope").when(F.col("n") == 0, "missing_correspondence").when(F.col("n") == 1, "explicit_identity").otherwise("conflicting_candidates")
    return j.select("variable", "declaration", decision(F.col("n")).alias("status"), reason.alias("reason"))


def overload_members(candidates: DataFrame, variants: DataFrame) -> DataFrame:
    """(trace, ordinal, variant, status): native overload candidates and the effective variants of their origin.

    candidates: trace, ordinal, origin, context; variants: variant, origin, context, role. Association selects no call.
    """
    effective = variants.filter((F.col("role") == "effective_typed") & F.col("origin").isNotNull()).select("variant", "origin", "context").distinct()
    counted = effective.groupBy("origin", "context").agg(F.count("*").alias("n"))
    j = candidates.join(counted, ["origin", "context"], "left").join(effective, ["origin", "context"], "left")
    return j.select("trace", "ordinal", "variant", decision(F.coalesce("n", F.lit(0))).alias("status"))


def callable_authority(applications: DataFrame) -> DataFrame:
    """(call, authority, reason): whether a signature may speak for a call.

    applications: call, destination, in_annotation, identity, signatures, exact, receiver_known, descriptor, adjustment, and the
    pairs that have to agree: target_context, signature_context, call_context, target_entity, signature_entity.
    """
    c = F.col
    #: How a signature is adjusted for each kind of descriptor.
    expected = F.create_map(*[F.lit(x) for x in ("function", "none", "static_method", "none", "instance_method", "bind_instance", "class_method", "bind_class", "property", "property_access")])
    agree = (c("target_context") == c("signature_context")) & (c("target_context") == c("call_context")) & (c("target_entity") == c("signature_entity"))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    reason = (
        F.when(~c("destination").isin("resolved", "overrides"), "call_transfer").when(no(agree), "missing_evidence").when(c("destination") == "overrides", "dispatch_open").when(c("in_annotation"), "annotation_syntax")
        .when(c("identity") == "conflicting", "effective_conflicting").when(no(c("identity") == "known"), "effective_unknown").when(no(c("signatures") == "known"), "signature_unknown").when(no(c("exact")), "qualified_uncertainty")
        .when(no(c("receiver_known")), "receiver_unknown").when(c("descriptor").isNull(), "descriptor_unknown").when(no(expected[c("descriptor")] == c("adjustment")), "adjustment_mismatch").otherwise("established")
    )
    refused = F.col("reason").isin("call_transfer", "missing_evidence")
    return applications.withColumn("reason", reason).select("call", F.when(F.col("reason") == "established", "effective_invocation").when(~refused, "source_inspection").alias("authority"), "reason")


def handoffs(definitions: DataFrame, reaching: DataFrame, uses: DataFrame) -> DataFrame:
    """(producer, consumer, slot, sites): results of a producer that reach an argument of a consumer in official usage.

    definitions: definition, producer; reaching: definition, use; uses: use, consumer, slot, official.
    """
    given = uses.filter("official").select("use", "consumer", "slot").join(reaching, "use").join(definitions, "definition")
    return given.groupBy("producer", "consumer", "slot").agg(F.count_distinct("use").alias("sites"))


#: Kinds of official usage, the best first.
OFFICIAL = ("example", "doc_block", "test")
SMALL_PAIRS = 100_000  # pairs of conditions that are broadcast


def assessed_handoffs(definitions: DataFrame, reaching: DataFrame, uses: DataFrame) -> DataFrame:
    """(producer, consumer, slot, site, role, status) of results that reach an argument in official usage.

    definitions: definition, producer; reaching: definition, use, condition; uses: use, site, consumer, slot, roles (array),
    condition. Conditions are JSON trees of `conditions`; the role is the best one. Where the conditions exclude each other
    there is no handoff; where that is unknown (null, or over the budget) the status is unknown. Each pair of conditions is decided once.
    """
    from tessera.operators import conditions
    from tessera.functions.parts import spread
    from tessera.operators.graph import _cut

    role = F.coalesce(*[F.when(F.array_contains("roles", r), r) for r in OFFICIAL])
    used = uses.withColumn("role", role).filter("role is not null").select("use", "site", "consumer", "slot", "role", F.col("condition").alias("__u"))
    met = reaching.select("definition", "use", F.col("condition").alias("__r")).join(definitions, "definition").join(spread(used, "use"), "use")
    pairs = met.select("__r", "__u").distinct().withColumn("__open", conditions.compatible("__r", "__u")).select(F.col("__r").alias("__a"), F.col("__u").alias("__b"), "__open")
    pairs = _cut(pairs)
    if pairs.count() <= SMALL_PAIRS:  # else a pair that most uses have would take them to one task
        pairs = F.broadcast(pairs)
    j = met.join(pairs, F.col("__r").eqNullSafe(F.col("__a")) & F.col("__u").eqNullSafe(F.col("__b"))).filter("__open is null or __open")
    return j.groupBy("producer", "consumer", "slot", "site", "role").agg(F.when(F.max("__open"), "established").otherwise("unknown").alias("status"))


def receivers(targets: DataFrame, syntax: DataFrame, placements: DataFrame, supports: DataFrame) -> DataFrame:
    """(target, call, placement, reason, premises): whether a class-method target's receiver is the class of the value it is called on.

    targets: target, site, context, qualified, descriptor; syntax: call, site, context, in_annotation, attribute;
    placements: placement, call, ordinal, inside; supports: kind (target, syntax, placement), assertion, run, sound. Reason
    class_of is the positive outcome; the others name the first premise that fails. Calls of a site, values of a call
    and supports of an assertion are counted before they meet a target; premises are the supports that had a part.
    """
    no = lambda x: ~F.coalesce(x, F.lit(False))
    calls = syntax.groupBy("site", "context").agg(F.count("*").alias("calls"), F.min("call").alias("call"), F.max("in_annotation").alias("in_annotation"), F.min("attribute").alias("attribute"))
    values = placements.groupBy("call").agg(F.count("*").alias("values"), F.min("placement").alias("placement"), F.min((F.col("ordinal") == 0) & F.col("inside")).alias("first"))
    told = supports.groupBy("kind", "assertion").agg(F.count("*").alias("n"), F.min(F.coalesce("sound", F.lit(False))).alias("sound"), F.min("run").alias("least"), F.max("run").alias("most"))
    out = targets.join(calls, ["site", "context"], "left").join(values, "call", "left")
    for kind, key in (("target", "target"), ("syntax", "call"), ("placement", "placement")):
        of = told.filter(F.col("kind") == kind).select(F.col("assertion").alias(key), *[F.col(c).alias(f"{kind}_{c}") for c in ("n", "sound", "least", "most")])
        out = out.join(of, key, "left")
    c = F.col
    one_run = lambda k: c(f"{k}_least") == c(f"{k}_most")
    reason = (
        F.when(no(c("qualified")), "qualification_disagreement").when(c("descriptor").isNull(), "descriptor_unknown").when(c("calls").isNull(), "missing_syntax").when(c("calls") > 1, "ambiguous_syntax")
        .when(no(~c("in_annotation")), "qualification_disagreement").when(no(c("attribute")), "syntax_disagreement").when(c("values").isNull(), "missing_placement").when(c("values") > 1, "ambiguous_placement").when(no(c("first")), "qualification_disagreement")
    )
    for kind in ("target", "syntax", "placement"):
        same = one_run(kind) & (F.lit(True) if kind == "target" else c(f"{kind}_least") == c("target_least"))
        reason = reason.when(c(f"{kind}_n").isNull(), "missing_support").when(no(c(f"{kind}_sound") & same), "support_disagreement")
    premises = sum((F.coalesce(f"{k}_n", F.lit(0)) for k in ("target", "syntax", "placement")), F.lit(0))
    found = out.withColumn("reason", reason.otherwise("class_of")).withColumn("premises", premises.cast("long"))
    ok = F.col("reason") == "class_of"
    return found.select("target", F.when(ok, F.col("call")).alias("call"), F.when(ok, F.col("placement")).alias("placement"), "reason", F.when(ok, F.col("premises")).alias("premises"))

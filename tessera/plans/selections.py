"""Four-valued selection, outcomes, concepts and conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import concepts, conditions, selection, selectors
from tessera.plans.catalog import register

# Observations: a document's label values by source (context) and language (basis); documents without labels are unknown.
_OBS = (
    "obs AS (SELECT source AS candidate, lang AS context, doc_id % 5 AS basis, quality = 1 AS value FROM documents LEFT JOIN labels USING (doc_id)),"
    " per AS (SELECT candidate, context, basis, max(CASE WHEN value THEN 1 ELSE 0 END) AS yes, max(CASE WHEN NOT value THEN 1 ELSE 0 END) AS no, max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS unknown FROM obs GROUP BY ALL),"
    " f AS (SELECT candidate, count(*) AS n, max(yes * no) AS conflict, max(yes) AS yes, max(no) AS no, max(CASE WHEN unknown = 1 AND yes + no = 0 THEN 1 ELSE 0 END) AS unknown FROM per GROUP BY 1),"
    " d AS (SELECT DISTINCT source AS candidate, length(source) % 2 = 0 AS closed FROM documents UNION ALL SELECT 'nothing', true)"
)


def _case(every: bool) -> str:
    return (
        "CASE " + ("WHEN f.no = 1 THEN 'contradicted' " if every else "") + "WHEN f.conflict = 1 THEN 'conflicting' " + ("" if every else "WHEN f.yes = 1 THEN 'supported' ")
        + "WHEN closed AND coalesce(f.n, 0) = 0 THEN 'contradicted' WHEN closed AND coalesce(f.unknown, 0) = 0 AND coalesce(f.yes, 0) = 0 THEN 'contradicted' "
        + ("WHEN closed AND coalesce(f.unknown, 0) = 0 THEN 'supported' " if every else "") + "ELSE 'unresolved' END AS outcome"
    )


def _observed(t):
    j = t("documents").join(t("labels"), "doc_id", "left")
    obs = j.select(F.col("source").alias("candidate"), F.col("lang").alias("context"), (F.col("doc_id") % 5).alias("basis"), (F.col("quality") == 1).alias("value"))
    d = t("documents").select(F.col("source").alias("candidate"), (F.length("source") % 2 == 0).alias("closed")).distinct()
    return obs, d.unionAll(d.sparkSession.createDataFrame([("nothing", True)], d.schema))


@register(f"WITH {_OBS} SELECT d.candidate, {_case(False)} FROM d LEFT JOIN f USING (candidate)")
def select_four_valued(spark, t):
    return selection.classify(*_observed(t), "any").select("candidate", "outcome")


@register(f"WITH {_OBS} SELECT d.candidate, 'any' AS quantifier, {_case(False)} FROM d LEFT JOIN f USING (candidate) UNION ALL SELECT d.candidate, 'all', {_case(True)} FROM d LEFT JOIN f USING (candidate)")
def select_any_all(spark, t):
    obs, d = _observed(t)
    one = lambda q: selection.classify(obs, d, q).select("candidate", F.lit(q).alias("quantifier"), "outcome")
    return one("any").unionAll(one("all"))


@register(
    "WITH o AS (SELECT source || '/' || doc_id % 300 AS source, CASE WHEN quality = 1 AND toxic = 0 THEN 'supported' WHEN quality = 1 THEN 'conflicting' WHEN quality = 0 AND toxic = 1 THEN 'contradicted' ELSE 'unresolved' END AS outcome FROM documents LEFT JOIN labels USING (doc_id))"
    " SELECT source, CASE WHEN bool_or(outcome = 'contradicted') THEN 'contradicted' WHEN bool_or(outcome = 'conflicting') THEN 'conflicting' WHEN bool_or(outcome = 'unresolved') THEN 'unresolved' ELSE 'supported' END AS outcome FROM o GROUP BY 1"
)
def outcome_aggregate(spark, t):
    j = t("documents").withColumn("source", F.concat("source", F.lit("/"), F.col("doc_id") % 300)).join(t("labels"), "doc_id", "left")
    good, toxic = F.col("quality") == 1, F.col("toxic")
    o = F.when(good & (toxic == 0), "supported").when(good, "conflicting").when((F.col("quality") == 0) & (toxic == 1), "contradicted").otherwise("unresolved")
    return j.withColumn("o", o).groupBy("source").agg(selection.combined(F.col("o")).alias("outcome"))


@register("SELECT o_custkey AS candidate, o_orderpriority AS context FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) = 2")
def joint_contexts(spark, t):
    a = t("orders").filter("o_orderstatus IN ('O', 'F')").select(F.col("o_custkey").alias("candidate"), F.col("o_orderstatus").alias("requirement"), F.col("o_orderpriority").alias("context"))
    return selection.joint_contexts(a, 2)


_PARETO = "SELECT l_partkey, l_quantity, l_discount FROM (SELECT DISTINCT l_partkey, l_quantity, l_discount FROM lineitem) x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_partkey = x.l_partkey AND y.l_quantity <= x.l_quantity AND y.l_discount <= x.l_discount AND (y.l_quantity < x.l_quantity OR y.l_discount < x.l_discount))"


@register(_PARETO)
def pareto_frontier(spark, t):
    return conditions.pareto(t("lineitem").select("l_partkey", "l_quantity", "l_discount").distinct(), "l_partkey", "l_quantity", "l_discount")


@register("SELECT p_partkey, true AS forward, p_brand = p_type AND false AS back, p_brand <> p_type AS \"both\" FROM part")
def condition_implies(spark, t):
    a = F.concat(F.lit('["and", "'), F.col("p_brand"), F.lit('", ["not", "'), F.col("p_type"), F.lit('"]]'))
    b = F.concat(F.lit('["or", "'), F.col("p_brand"), F.lit('", "'), F.col("p_name"), F.lit('"]'))
    return t("part").select("p_partkey", conditions.implies(a, b).alias("forward"), conditions.implies(b, a).alias("back"), conditions.compatible(a, b).alias("both"))


def _incidence(t):
    """Three scopes; objects are shelves of twenty parts, attributes the sizes on them, so that contexts grow with the parts and stay as dense."""
    scope, shelf = F.concat(F.lit("s"), F.col("p_partkey") % 3), F.floor(F.col("p_partkey") / 20).cast("long")
    return t("part").select(scope.alias("scope"), shelf.alias("object"), (F.col("p_size") % 12).alias("attribute")).distinct()


_MASKS = (
    "o AS (SELECT 's' || (p_partkey % 3) AS scope, p_partkey // 20 AS object, bit_or(1 << (p_size % 12)) AS mask FROM part GROUP BY 1, 2), used AS (SELECT scope, bit_or(mask) AS used FROM o GROUP BY 1),"
    " sets AS (SELECT scope, s FROM used, (SELECT unnest(range(0, 4096)) AS s) WHERE s & used = s)"
)


# All sets of attributes: a set is the intent of a concept if the objects that have it share no more.
@register(
    f"WITH {_MASKS}, c AS (SELECT scope, s, count(*) AS n, bit_and(mask) AS meet, string_agg(object::VARCHAR, ',' ORDER BY object) AS objects FROM sets JOIN o USING (scope) WHERE mask & s = s GROUP BY 1, 2)"
    " SELECT scope, n::INTEGER AS support, objects, array_to_string(list_filter(range(0, 12), lambda i: (s >> i) & 1 = 1), ',') AS attributes FROM c WHERE meet = s AND n >= 2"
)
def fca_concepts(spark, t):
    text = lambda c: F.concat_ws(",", F.transform(c, lambda a: a.cast("string"))).alias(c)
    return concepts.concepts(_incidence(t)).select("scope", "support", text("objects"), text("attributes"))


@register()
def fca_implications(spark, t):
    text = lambda c: F.concat_ws(",", F.transform(c, lambda a: a.cast("string"))).alias(c)
    return concepts.implications(_incidence(t)).select("scope", text("premise"), text("conclusion"), "support")


# Facts about the star schema as a selection's relations: orders are exposures, customers signatures, suppliers scenarios, parts configuration fields.
_PICKED = (
    "SELECT 'public_exposures' AS domain, o_orderkey AS entity FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_orderstatus = 'O' OR o_orderstatus = 'P') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"
    " UNION ALL SELECT 'signature_variants', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000)"
    " AND c_mktsegment <> 'BUILDING' UNION ALL SELECT 'configuration_fields', p_partkey FROM part WHERE p_brand = 'Brand#11' OR p_type = 'PROMO' OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_quantity = 50)"
    " UNION ALL SELECT 'scenarios', s_suppkey FROM supplier WHERE s_nationkey = 3 OR s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 49)"
)


@register(_PICKED)
def selection_predicates(spark, t):
    """Four selections of twelve predicates, compiled to semi and anti joins."""
    o, li, p, c = t("orders"), t("lineitem"), t("part"), F.col
    order_at = o.select(c("o_custkey").alias("entity"), c("o_orderstatus").alias("name"), c("o_orderpriority").alias("kind"), (c("o_totalprice") > 250000).alias("required"))
    relations = {
        "exposures": o.select(c("o_orderkey").alias("entity"), F.array("o_orderpriority").alias("path"), c("o_orderstatus").alias("module")),
        "raises": li.select(c("l_orderkey").alias("entity"), c("l_returnflag").alias("exception")),
        "parameters": order_at,
        "returns": t("customer").select(c("c_custkey").alias("entity"), F.lit("declared").alias("role"), c("c_mktsegment").alias("type")),
        "configuration": p.select(c("p_partkey").alias("entity"), c("p_brand").alias("owner"), c("p_type").alias("scope")),
        "literals": li.select(c("l_partkey").alias("entity"), c("l_linenumber").alias("name"), c("l_quantity").alias("value")),
        "scenarios": t("supplier").select(c("s_suppkey").alias("entity"), c("s_nationkey").alias("intent")),
        "checks": li.filter("l_quantity > 49").select(c("l_suppkey").alias("entity"), c("l_returnflag").alias("check"), c("l_linestatus").alias("status")),
    }
    members = {"public_exposures": o.select(c("o_orderkey").alias("entity")), "signature_variants": t("customer").select(c("c_custkey").alias("entity")), "configuration_fields": p.select(c("p_partkey").alias("entity")), "scenarios": t("supplier").select(c("s_suppkey").alias("entity"))}
    trees = [
        ("all", ("public_path", {"path": ["1-URGENT"]}), ("any", ("public_module", {"module": "O"}), ("public_module", {"module": "P"})), ("not", ("behavioral_raises", {"exception": "R"}))),
        ("all", ("parameter_kind", {"name": "O", "kind": "2-HIGH"}), ("parameter_required", {"name": "F", "required": True}), ("not", ("variant_return_type", {"role": "declared", "type": "BUILDING"}))),
        ("any", ("configuration_owner", {"owner": "Brand#11"}), ("configuration_scope", {"scope": "PROMO"}), ("configuration_literal", {"name": 1, "value": 50.0})),
        ("any", ("scenario_intent", {"intent": 3}), ("not", ("scenario_check", {"check": "A", "status": "F"}))),
    ]
    return selectors.selected_all(trees, members, relations)

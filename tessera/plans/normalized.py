"""Demand of filters, links of types and calls, judgements, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as V
from tessera.operators import demand, graph, judge, resolution, validation, witness
from tessera.plans.catalog import register

# Filters over orders, and what they ask of o_orderkey at most.
# Each customer asks for its orders, by one of six forms of filter.
@register(
    "WITH k AS (SELECT c_custkey, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL), []) AS ks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"
    " SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN array_to_string(ks[2:], ',') WHEN 5 THEN '' ELSE array_to_string(ks, ',') END AS keys, c_custkey % 6 IN (0, 4, 5) AS exact,"
    " CASE c_custkey % 6 WHEN 1 THEN 'o_orderkey,o_totalprice' ELSE 'o_orderkey' END AS reads FROM k"
)
def demand_forms(spark, t):
    ks = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    rows = t("customer").select("c_custkey").join(ks, "c_custkey", "left").withColumn("ks", F.coalesce("ks", F.expr("cast(array() as array<bigint>)")))
    among = lambda c: F.concat(F.lit('["in", "o_orderkey", ['), F.array_join(c.cast("array<string>"), ", "), F.lit("]]"))
    join = lambda op, *xs: F.concat(F.lit(f'["{op}", '), F.concat_ws(", ", *xs), F.lit("]"))
    mine, form = among(F.col("ks")), F.col("c_custkey") % 6
    text = (
        F.when(form == 0, mine).when(form == 1, join("and", mine, F.lit('["compare", "o_totalprice", ">", 1000.0]'))).when(form == 2, join("or", mine, mine)).when(form == 3, join("not", mine))
        .when(form == 4, join("and", mine, among(F.slice("ks", 2, 1_000_000)))).otherwise(join("and", mine, F.lit('["eq", "o_orderkey", null]')))
    )
    got = rows.select("c_custkey", demand.described("o_orderkey")(text).alias("d"))
    return got.select("c_custkey", F.when(F.col("d.keys").isNotNull(), F.array_join(F.col("d.keys").cast("array<string>"), ",")).alias("keys"), "d.exact", F.array_join("d.reads", ",").alias("reads"))


_SOME = list(range(0, 4000, 7))


@register(f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN ({', '.join(map(str, _SOME))}) AND o_totalprice > 1000 AND (o_orderstatus = 'O' OR o_orderkey = 14) AND o_orderpriority NOT IN ('5-LOW')")
def demand_scan(spark, t):
    filters = [
        ("and", ("in", "o_orderkey", _SOME), ("compare", "o_totalprice", ">", 1000.0)), ("or", ("eq", "o_orderstatus", "O"), ("eq", "o_orderkey", 14)),
        ("not_in", "o_orderpriority", ["5-LOW"]), ("in", "o_orderkey", list(range(4000))),
    ]
    return demand.scan(t("orders"), filters, "o_orderkey").select("o_orderkey", "o_orderstatus")


@register(
    "SELECT 'public_exposures' AS domain, o_custkey AS entity FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 UNION SELECT 'signature_variants', c_custkey FROM customer WHERE c_acctbal > 0 UNION SELECT 'scenarios', s_suppkey FROM supplier WHERE s_acctbal < 5000"
)
def predicate_domains(spark, t):
    relations = {
        "public_exposures": t("orders").withColumn("entity", F.col("o_custkey")), "signature_variants": t("customer").withColumn("entity", F.col("c_custkey")), "scenarios": t("supplier").withColumn("entity", F.col("s_suppkey")),
    }
    tests = [("public_path", F.col("o_orderstatus") == "O"), ("parameter_kind", F.col("c_acctbal") > 0), ("member_kind", F.col("o_totalprice") > 1000), ("scenario_check", F.col("s_acctbal") < 5000)]
    return demand.routed(tests, relations, "entity")


@register(
    "WITH r AS (SELECT p_brand AS symbol, min(p_partkey) AS entity, CASE count(DISTINCT p_type) WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM part WHERE p_size < 25 GROUP BY 1),"
    " x AS (SELECT p_partkey AS term, p_size % 5 AS k, CASE WHEN p_size % 5 < 2 THEN p_brand END AS symbol, p_name AS module FROM part), m AS (SELECT p_name AS module, min(p_partkey) AS entity FROM part WHERE p_retailprice < 950 GROUP BY 1)"
    " SELECT term, CASE WHEN symbol IS NOT NULL THEN r.entity WHEN k = 2 THEN m.entity END AS entity, CASE WHEN symbol IS NOT NULL THEN coalesce(r.status, 'unresolved') WHEN k = 2 AND m.entity IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status,"
    " CASE WHEN symbol IS NOT NULL THEN CASE r.status WHEN 'resolved' THEN 'explicit_identity' WHEN 'ambiguous' THEN 'conflicting_candidates' ELSE 'missing_correspondence' END WHEN k = 2 AND m.entity IS NOT NULL THEN 'explicit_identity' ELSE 'missing_correspondence' END AS reason"
    " FROM x LEFT JOIN r USING (symbol) LEFT JOIN m USING (module) WHERE symbol IS NOT NULL OR k IN (2, 3)"
)
def type_links(spark, t):
    p = t("part")
    k = F.col("p_size") % 5
    kind = F.when(k == 0, "class").when(k == 1, "function").when(k == 2, "module").when(k == 3, "alias").otherwise("none")
    terms = p.select(F.col("p_partkey").alias("term"), kind.alias("kind"), F.when(k < 2, F.col("p_brand")).alias("symbol"), F.col("p_name").alias("module"))
    found = p.filter("p_size < 25").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_partkey").alias("entity"), F.when(F.count_distinct("p_type") == 1, "resolved").otherwise("ambiguous").alias("status"))
    modules = p.filter("p_retailprice < 950").groupBy(F.col("p_name").alias("module")).agg(F.min("p_partkey").alias("entity"))
    return resolution.type_links(terms, found, modules)


@register(
    "WITH d AS (SELECT event_id AS declaration, user_id AS source, (event_id % 50) * 10 AS start, (event_id % 50) * 10 + 40 + CAST(floor(value) AS BIGINT) AS stop, event_id % 3 AS depth FROM events),"
    " v AS (SELECT o_orderkey AS variable, o_custkey AS source, (o_orderkey % 60) * 9 AS start, (o_orderkey % 60) * 9 + 5 AS stop, CASE WHEN o_orderkey % 4 = 0 THEN 'foreign' ELSE 'scoped' END AS origin, CASE WHEN o_orderkey % 9 > 0 THEN 400 END AS size FROM orders),"
    " a AS (SELECT variable, declaration, depth FROM v JOIN d ON d.source = v.source AND d.start <= v.start AND v.stop <= d.stop WHERE origin = 'scoped' AND v.stop <= size),"
    " b AS (SELECT variable, declaration FROM a WHERE depth = (SELECT max(depth) FROM a x WHERE x.variable = a.variable)), n AS (SELECT variable, count(*) AS n FROM b GROUP BY 1)"
    " SELECT v.variable, declaration, CASE coalesce(n, 0) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN origin = 'foreign' THEN 'unsupported_native_origin' WHEN size IS NULL OR stop > size THEN 'outside_captured_scope'"
    " WHEN n IS NULL THEN 'missing_correspondence' WHEN n = 1 THEN 'explicit_identity' ELSE 'conflicting_candidates' END AS reason FROM v LEFT JOIN n USING (variable) LEFT JOIN b USING (variable)"
)
def type_binders(spark, t):
    at = (F.col("event_id") % 50) * 10
    d = t("events").select(F.col("event_id").alias("declaration"), F.col("user_id").alias("source"), at.alias("start"), (at + 40 + F.floor("value").cast("long")).alias("stop"), (F.col("event_id") % 3).alias("depth"))
    at = (F.col("o_orderkey") % 60) * 9
    v = t("orders").select(
        F.col("o_orderkey").alias("variable"), F.col("o_custkey").alias("source"), at.alias("start"), (at + 5).alias("stop"),
        F.when(F.col("o_orderkey") % 4 == 0, "foreign").otherwise("scoped").alias("origin"), F.when(F.col("o_orderkey") % 9 > 0, F.lit(400)).alias("captured_bytes"),
    )
    return resolution.type_binders(v, d)


@register(
    "WITH v AS (SELECT DISTINCT o_orderkey AS variant, o_custkey AS origin, o_orderpriority AS context FROM orders WHERE o_orderstatus = 'O'), n AS (SELECT origin, context, count(*) AS n FROM v GROUP BY 1, 2),"
    " c AS (SELECT event_id AS trace, user_id % 7 AS ordinal, event_id % 200 AS origin, CASE WHEN event_id % 2 = 0 THEN '5-LOW' ELSE '1-URGENT' END AS context FROM events)"
    " SELECT trace, ordinal, variant, CASE coalesce(n, 0) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM c LEFT JOIN n USING (origin, context) LEFT JOIN v USING (origin, context)"
)
def overload_members(spark, t):
    c = t("events").select(F.col("event_id").alias("trace"), (F.col("user_id") % 7).alias("ordinal"), (F.col("event_id") % 200).alias("origin"), F.when(F.col("event_id") % 2 == 0, "5-LOW").otherwise("1-URGENT").alias("context"))
    role = F.when(F.col("o_orderstatus") == "O", "effective_typed").otherwise("declared").alias("role")
    return resolution.overload_members(c, t("orders").select(F.col("o_orderkey").alias("variant"), F.col("o_custkey").alias("origin"), F.col("o_orderpriority").alias("context"), role))


@register(
    "SELECT event_id AS call, CASE WHEN reason = 'established' THEN 'effective_invocation' WHEN reason NOT IN ('call_transfer', 'missing_evidence') THEN 'source_inspection' END AS authority, reason FROM (SELECT event_id, CASE"
    " WHEN event_id % 11 = 0 THEN 'call_transfer' WHEN user_id % 13 = 0 THEN 'missing_evidence' WHEN event_id % 11 = 1 THEN 'dispatch_open' WHEN event_id % 7 = 0 THEN 'annotation_syntax' WHEN event_id % 5 = 0 THEN 'effective_conflicting' WHEN event_id % 5 = 1 THEN 'effective_unknown'"
    " WHEN user_id % 3 = 0 THEN 'signature_unknown' WHEN value < 5 THEN 'qualified_uncertainty' WHEN value > 90 THEN 'receiver_unknown' WHEN event_type = 'click' THEN 'descriptor_unknown' WHEN event_type = 'error' THEN 'adjustment_mismatch' ELSE 'established' END AS reason FROM events)"
)
def callable_authority(spark, t):
    e, c = t("events"), F.col
    return resolution.callable_authority(
        e.select(
            c("event_id").alias("call"), F.when(c("event_id") % 11 == 0, "unknown").when(c("event_id") % 11 == 1, "overrides").otherwise("resolved").alias("destination"), (c("event_id") % 7 == 0).alias("in_annotation"),
            F.when(c("event_id") % 5 == 0, "conflicting").when(c("event_id") % 5 != 1, "known").alias("identity"), F.when(c("user_id") % 3 != 0, "known").alias("signatures"), (c("value") >= 5).alias("exact"), (c("value") <= 90).alias("receiver_known"),
            F.when(c("event_type") == "error", "property").when(c("event_type") != "click", "class_method").alias("descriptor"), F.lit("bind_class").alias("adjustment"), F.lit(1).alias("target_context"), F.lit(1).alias("signature_context"),
            F.when(c("user_id") % 13 != 0, 1).alias("call_context"), c("user_id").alias("target_entity"), c("user_id").alias("signature_entity"),
        )
    )


@register("SELECT o_custkey AS producer, l_suppkey AS consumer, l_linenumber AS slot, count(DISTINCT l_orderkey) AS sites FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'N' GROUP BY 1, 2, 3")
def handoffs(spark, t):
    uses = t("lineitem").select(F.col("l_orderkey").alias("use"), F.col("l_suppkey").alias("consumer"), F.col("l_linenumber").alias("slot"), (F.col("l_returnflag") == "N").alias("official"))
    reaching = t("orders").select(F.col("o_orderkey").alias("use"), F.col("o_orderkey").alias("definition"))
    return resolution.handoffs(t("orders").select(F.col("o_orderkey").alias("definition"), F.col("o_custkey").alias("producer")), reaching, uses)


# Cases are customers; a predicate asks for a status in an order, found in the context of the order's priority.
@register(
    "WITH c AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 17 = 0 THEN 'not_applicable' WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE 'answer' END AS intent, c_custkey % 19 > 0 AS done, CASE WHEN c_custkey % 23 = 0 THEN 'incomplete' WHEN c_custkey % 29 = 0 THEN 'unsupported' ELSE 'complete' END AS whole, c_custkey % 31 AS size FROM customer),"
    " e AS (SELECT DISTINCT o_custkey AS c, o_orderstatus AS st, o_orderpriority AS ctx FROM orders WHERE o_orderstatus IN ('O', 'F')), m AS (SELECT c, count(DISTINCT st) AS met FROM e GROUP BY 1), w AS (SELECT c, ctx FROM e GROUP BY 1, 2 HAVING count(*) = 2),"
    " a AS (SELECT w.c, count(DISTINCT o_totalprice > 200000) AS answers FROM w JOIN orders ON o_custkey = w.c AND o_orderpriority = w.ctx GROUP BY 1)"
    " SELECT c.c AS case, CASE WHEN intent = 'not_applicable' THEN intent WHEN NOT done OR whole = 'complete' THEN 'applicable' ELSE whole END AS applicability, CASE WHEN intent = 'not_applicable' THEN intent WHEN NOT done OR whole <> 'complete' THEN 'inconclusive'"
    " WHEN size > 28 THEN 'budget_infeasible' WHEN answers > 1 THEN 'insufficient' WHEN c.c NOT IN (SELECT c FROM w) THEN 'insufficient' WHEN intent = 'unknown' THEN 'model_relative_unknown' ELSE 'sufficient' END AS epistemic, 2 - coalesce(met, 0) AS missing FROM c LEFT JOIN m USING (c) LEFT JOIN a USING (c)"
)
def judged_cases(spark, t):
    k, o = F.col("c_custkey"), t("orders")
    cases = t("customer").select(
        k.alias("case"), F.when(k % 17 == 0, "not_applicable").when(k % 5 == 0, "unknown").otherwise("answer").alias("intent"), F.when(k % 19 > 0, "completed").otherwise("failed").alias("status"),
        F.when(k % 23 == 0, "incomplete").when(k % 29 == 0, "unsupported").otherwise("complete").alias("completeness"), (k % 31).alias("bytes"), F.lit(28).alias("max_bytes"),
    )
    needs = t("customer").select(k.alias("case"), F.explode(F.array(F.lit("O"), F.lit("F"))).alias("text")).select("case", F.concat(F.lit("status "), F.col("text")).alias("predicate"), F.lit("status").alias("role"), "text")
    evidence = o.select(F.col("o_custkey").alias("case"), F.lit("status").alias("role"), F.col("o_orderstatus").alias("text"), F.col("o_orderpriority").alias("context"))
    worlds = o.select(F.col("o_custkey").alias("case"), F.col("o_orderpriority").alias("context"), (F.col("o_totalprice") > 200000).alias("answer"))
    return judge.judged(cases, needs, evidence, worlds)


# An order is open or pending in a year and a priority, and a dear one is of the same priority, whatever its year.
@register(
    "WITH e AS (SELECT o_custkey AS c, o_orderstatus AS st, o_totalprice > 200000 AS high, o_orderpriority AS pri, year(o_orderdate) AS yr FROM orders), a AS (SELECT c, pri, yr FROM e WHERE st IN ('O', 'P')), h AS (SELECT c, pri FROM e WHERE high),"
    " na AS (SELECT c, count(*) AS na FROM a GROUP BY 1), nh AS (SELECT c, count(*) AS nh FROM h GROUP BY 1), w AS (SELECT c, count(*) AS n FROM (SELECT DISTINCT a.c, a.pri, a.yr FROM a JOIN h USING (c, pri)) GROUP BY 1),"
    " m AS (SELECT c_custkey AS c, concat_ws(',', CASE WHEN NOT coalesce(bool_or(high), false) THEN 'high' END, CASE WHEN NOT coalesce(bool_or(st = 'O'), false) THEN 'open' END, CASE WHEN NOT coalesce(bool_or(st = 'P'), false) THEN 'pending' END) AS missing FROM customer LEFT JOIN e ON c = c_custkey GROUP BY 1),"
    " j AS (SELECT m.c, missing, coalesce(na, 0) * coalesce(nh, 0) AS proofs, coalesce(n, 0) AS n FROM m LEFT JOIN na USING (c) LEFT JOIN nh USING (c) LEFT JOIN w USING (c))"
    " SELECT c AS case, CASE WHEN proofs > 4096 THEN 'inconclusive' WHEN n = 0 THEN 'insufficient' WHEN c % 5 = 0 THEN 'model_relative_unknown' ELSE 'sufficient' END AS epistemic,"
    " CASE WHEN proofs > 4096 THEN 'work_bound' WHEN n > 0 THEN NULL WHEN missing <> '' THEN 'missing_predicates' ELSE 'incompatible_contexts' END AS reason, CASE WHEN proofs > 4096 THEN 0 ELSE n END AS assignments, missing FROM j"
)
def witnessed_cases(spark, t):
    k, o = F.col("c_custkey"), t("orders")
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    none = F.lit(None)
    cases = t("customer").select(k.alias("case"), F.when(k % 5 == 0, "unknown").otherwise("answer").alias("intent"), none.cast(witness.ASSIGNMENT).alias("context"))
    at = F.array(pair("priority", F.col("o_orderpriority")), pair("year", F.year("o_orderdate")))
    said = lambda role, text: o.select(F.col("o_custkey").alias("case"), F.lit(role).alias("role"), text.alias("text"), F.lit("order").alias("anchor"), F.lit("known").alias("status"), at.alias("context"), none.cast("array<struct<id: string, text: string>>").alias("qualifications"))
    evidence = said("status", F.col("o_orderstatus")).union(said("price", F.when(F.col("o_totalprice") > 200000, "high").otherwise("low")))
    asks = F.array(*[F.struct(F.lit(p).alias("predicate"), F.lit(r).alias("role"), F.array(F.lit(x)).alias("texts")) for p, r, x in (("open", "status", "O"), ("pending", "status", "P"), ("high", "price", "high"))])
    predicates = cases.select("case", F.explode(asks).alias("a")).select(
        "case", "a.predicate", "a.role", "a.texts", F.array(F.lit("order")).alias("anchors"), F.lit("known").alias("status"), none.cast(witness.ASSIGNMENT).alias("context"), none.cast("array<struct<id: string, texts: array<string>>>").alias("qualifications")
    )
    tree = [(0, None, 0, "all", None, None), (1, 0, 0, "any", None, None), (2, 1, 0, "leaf", "open", None), (3, 1, 1, "leaf", "pending", None), (4, 0, 1, "exists", None, ["year"]), (5, 4, 0, "leaf", "high", None)]
    shape = spark.createDataFrame(tree, "node int, parent int, ordinal int, kind string, predicate string, variables array<string>")
    nodes = cases.select("case").crossJoin(F.broadcast(shape))  # six rows
    return witness.witnessed(cases, predicates, evidence, nodes).withColumn("missing", F.concat_ws(",", "missing"))


@register("SELECT vec_id, len(embedding)::INTEGER * 4 AS bytes, true AS same FROM embeddings")
def vector_codec(spark, t):
    e = t("embeddings").withColumn("b", V.encoded(F.col("embedding")))
    return e.select("vec_id", F.octet_length("b").alias("bytes"), (V.decoded(F.col("b")) == F.col("embedding")).alias("same"))


_ARCS = "arcs AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"


@register(
    f"WITH {_ARCS}, r AS (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS rank FROM arcs) SELECT rank // 65536 AS chunk, count(*) AS n, sha256(unhex(string_agg(printf('%016x%016x', src, dst), '' ORDER BY rank))) AS digest FROM r GROUP BY 1"
)
def graph_codec(spark, t):
    return graph.encoded(t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))).select("chunk", "n", F.sha2("payload", 256).alias("digest"))


@register(f"WITH {_ARCS} SELECT src, dst FROM arcs")
def graph_codec_round_trip(spark, t):
    return graph.decoded(graph.encoded(t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))))


@register("SELECT n_nationkey, n_name FROM nation")
def typed_decode(spark, t):
    have = {f.name: f.dataType for f in t("nation").schema}
    return validation.typed(t("nation"), T.StructType([T.StructField("n_nationkey", have["n_nationkey"], False), T.StructField("n_name", T.StringType())]))

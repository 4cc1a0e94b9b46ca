"""Receivers, handoffs, narrowing, summaries, replies that fit, replayed models, dependency lines, stored postings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import conditions, graph, paging, resolution, search, validation, terms
from tessera.plans.catalog import register
from tessera.plans.retrieval import _BM25, _POSTS, TERMS


# Targets are orders, called at their customer's site in the context of the order's parity; a site has a call per nation parity, some a second.
@register(
    "WITH t AS (SELECT o_orderkey AS target, o_custkey AS site, o_orderkey % 2 AS context, o_orderstatus <> 'P' AS qualified, CASE WHEN o_orderkey % 9 > 0 THEN 'class_method' END AS descriptor FROM orders),"
    " s AS (SELECT c_custkey AS call, c_custkey AS site, c_custkey % 2 AS context, c_nationkey = 3 AS ann, c_nationkey <> 4 AS attr FROM customer UNION ALL SELECT -s_suppkey, s_suppkey * 3, s_suppkey % 2, false, true FROM supplier),"
    " c AS (SELECT site, context, count(*) AS calls, min(call) AS call, bool_or(ann) AS ann, bool_and(attr) AS attr FROM s GROUP BY 1, 2),"
    " p AS (SELECT c_custkey AS call, count(*) AS vals, min(c_custkey * 10 + k) AS placement, bool_and(c_nationkey <> 5) AS first FROM customer, range(2) r(k) WHERE c_nationkey <> 6 AND (k = 0 OR c_nationkey = 7) GROUP BY 1),"
    " u AS (SELECT *, o_orderkey % 8 = 0 AS lone, o_orderkey % 16 = 8 AS odd FROM t JOIN orders ON o_orderkey = target), r AS (SELECT target, site, c.call, p.placement, CASE WHEN NOT qualified THEN 'qualification_disagreement' WHEN descriptor IS NULL THEN 'descriptor_unknown'"
    " WHEN calls IS NULL THEN 'missing_syntax' WHEN calls > 1 THEN 'ambiguous_syntax' WHEN ann THEN 'qualification_disagreement' WHEN NOT attr THEN 'syntax_disagreement' WHEN vals IS NULL THEN 'missing_placement' WHEN vals > 1 THEN 'ambiguous_placement'"
    " WHEN NOT first THEN 'qualification_disagreement' WHEN target % 13 = 0 THEN 'missing_support' WHEN target % 17 = 0 THEN 'support_disagreement' WHEN c.call % 19 = 0 THEN 'support_disagreement' WHEN p.placement % 110 = 0 THEN 'support_disagreement' ELSE 'class_of' END AS reason"
    " FROM t LEFT JOIN c USING (site, context) LEFT JOIN p ON p.call = c.call)"
    " SELECT target, CASE WHEN reason = 'class_of' THEN call END AS call, CASE WHEN reason = 'class_of' THEN placement END AS placement, reason, CASE WHEN reason = 'class_of' THEN 3 + (target % 5 = 0)::BIGINT END AS premises FROM r"
)
def receivers(spark, t):
    c = F.col
    targets = t("orders").select(c("o_orderkey").alias("target"), c("o_custkey").alias("site"), (c("o_orderkey") % 2).alias("context"), (c("o_orderstatus") != "P").alias("qualified"), F.when(c("o_orderkey") % 9 > 0, "class_method").alias("descriptor"))
    k = c("c_custkey")
    syntax = t("customer").select(k.alias("call"), k.alias("site"), (k % 2).alias("context"), (c("c_nationkey") == 3).alias("in_annotation"), (c("c_nationkey") != 4).alias("attribute")).union(
        t("supplier").select(-c("s_suppkey"), c("s_suppkey") * 3, c("s_suppkey") % 2, F.lit(False), F.lit(True))
    )
    copies = F.explode(F.when(c("c_nationkey") == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    placements = t("customer").filter("c_nationkey <> 6").select(k, "c_nationkey", copies.alias("copy")).select((k * 10 + c("copy")).alias("placement"), k.alias("call"), F.lit(0).alias("ordinal"), (c("c_nationkey") != 5).alias("inside"))
    order = c("o_orderkey")
    told = t("orders").filter(order % 13 != 0).select(F.lit("target").alias("kind"), order.alias("assertion"), F.explode(F.when(order % 5 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("run"), (order % 17 != 0).alias("sound"))
    told = told.union(t("customer").select(F.lit("syntax"), k, F.when(k % 19 == 0, 2).otherwise(1), F.lit(True))).union(placements.select(F.lit("placement"), "placement", F.lit(1), c("placement") % 110 != 0))
    return resolution.receivers(targets, syntax, placements, told)


# The producer's result holds under its status, the use under the line's flag; A and R exclude each other.
@register(
    "SELECT DISTINCT o_custkey AS producer, l_suppkey AS consumer, l_linenumber AS slot, l_orderkey AS site, CASE WHEN l_linestatus = 'O' THEN 'example' ELSE 'test' END AS role, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE 'established' END AS status"
    " FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <> 3 AND (o_orderpriority = '5-LOW' OR NOT (l_returnflag = 'R' AND o_orderstatus = 'F'))"
)
def handoff_assessment(spark, t):
    flag = F.when(F.col("l_returnflag") == "R", '["not", "ready"]').otherwise('["or", "ready", "late"]')
    uses = t("lineitem").select(
        F.col("l_orderkey").alias("use"), F.col("l_orderkey").alias("site"), F.col("l_suppkey").alias("consumer"), F.col("l_linenumber").alias("slot"),
        F.when(F.col("l_linenumber") == 3, F.array(F.lit("implementation"))).when(F.col("l_linestatus") == "O", F.array(F.lit("test"), F.lit("example"))).otherwise(F.array(F.lit("test"))).alias("roles"), flag.alias("condition"),
    )
    held = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string")).when(F.col("o_orderstatus") == "F", '["and", "ready", "seen"]').otherwise("true")
    reaching = t("orders").select(F.col("o_orderkey").alias("definition"), F.col("o_orderkey").alias("use"), held.alias("condition"))
    return resolution.assessed_handoffs(t("orders").select(F.col("o_orderkey").alias("definition"), F.col("o_custkey").alias("producer")), reaching, uses)


# A part's graph: its brand decides between two ways, a third is open; the ways are constants by the part's size.
@register(
    "WITH g AS (SELECT p_partkey AS part, p_brand AS b, p_size % 2 = 0 AS y, p_size % 3 = 0 AS m, p_size % 5 = 0 AS n, p_size % 7 = 0 AS lost FROM part)"
    " SELECT part, CASE WHEN m OR (y AND n) THEN '' WHEN y THEN b WHEN n THEN '!' || b END AS terms, CASE WHEN m OR (y AND n) THEN true WHEN NOT y AND NOT n THEN false END AS always, false AS unknown, lost AS approximated FROM g"
)
def narrowing(spark, t):
    way = lambda k: F.when(F.col("p_size") % k == 0, str(conditions.ALWAYS)).otherwise(str(conditions.NEVER))
    # The root's uncertain way is a node that asks the same atom again with the open way on both sides.
    g = F.format_string('{"nodes": [["%s", %s, 1, %s], ["%s", %s, -2, %s]], "root": 0, "lost": %s}', "p_brand", way(2), way(5), "p_brand", way(3), way(3), F.when(F.col("p_size") % 7 == 0, "true").otherwise("false"))
    x = t("part").select(F.col("p_partkey").alias("part"), conditions.narrowed(8)(g).alias("x"))
    return x.select("part", F.when(F.size("x.terms") > 0, F.concat_ws("|", F.transform("x.terms", lambda c: F.concat_ws("&", c)))).alias("terms"), "x.always", "x.unknown", "x.approximated")


_PROOFS = (
    "WITH RECURSIVE c AS (SELECT p_partkey AS caller, p_partkey // 2 AS callee, (p_size % 3)::BIGINT AS d, (p_size % 5 + 1)::BIGINT AS s FROM part UNION SELECT p_partkey, p_partkey // 3, (p_size % 2)::BIGINT, (p_size % 9 + 1)::BIGINT FROM part),"
    " r AS (SELECT p_partkey AS key, (p_size % 2)::BIGINT AS depth, (p_size % 4 + 1)::BIGINT AS steps FROM part WHERE p_size % 10 = 0 UNION SELECT caller, greatest(d, depth + 1), s + steps + 1 FROM r JOIN c ON callee = key WHERE depth <= 3 AND steps <= 16),"
    " a AS (SELECT * FROM r WHERE depth <= 3 AND steps <= 16), f AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.key = a.key AND x.depth <= a.depth AND x.steps <= a.steps AND (x.depth < a.depth OR x.steps < a.steps)))"
)


@register(
    _PROOFS + ", b AS (SELECT * FROM f UNION ALL SELECT caller, greatest(d, depth + 1), s + steps + 1 FROM f JOIN c ON callee = key), o AS (SELECT DISTINCT key, CASE WHEN depth > 3 THEN 'depth_limit' ELSE 'proof_limit' END AS reason FROM b WHERE (depth > 3 OR steps > 16)"
    " AND NOT EXISTS (SELECT 1 FROM f WHERE f.key = b.key AND f.depth <= b.depth AND f.steps <= b.steps)) SELECT key, depth, steps, NULL AS reason FROM f UNION ALL SELECT key, NULL, NULL, reason FROM o"
)
def summary_worklist(spark, t):
    p = t("part")
    k = F.col("p_partkey")
    arcs = p.select(k.alias("caller"), F.floor(k / 2).alias("callee"), (F.col("p_size") % 3).alias("depth"), (F.col("p_size") % 5 + 1).alias("steps")).union(
        p.select(k, F.floor(k / 3), F.col("p_size") % 2, F.col("p_size") % 9 + 1)
    )
    sources = p.filter("p_size % 10 = 0").select(k.alias("key"), (F.col("p_size") % 2).alias("depth"), (F.col("p_size") % 4 + 1).alias("steps"))
    best, refused = conditions.summaries(sources, arcs, 3, 16)
    none = F.lit(None).cast("long")
    return best.withColumn("reason", F.lit(None).cast("string")).union(refused.select("key", none, none, "reason"))


# A reply is an order: its price is the core, each odd line an optional section, each even line a ranked row.
@register(
    "WITH q AS (SELECT o_orderkey AS request, floor(o_totalprice / 1000)::BIGINT AS core FROM orders), l AS (SELECT l_orderkey AS request, l_linenumber % 2 AS odd, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, floor(l_quantity)::BIGINT * 3 AS b FROM lineitem),"
    " u AS (SELECT *, sum(b) OVER (PARTITION BY request, odd ORDER BY n) AS upto FROM l), a AS (SELECT q.*, coalesce(max(n) FILTER (odd = 0), 0) AS nr, coalesce(max(upto) FILTER (odd = 0), 0) AS br FROM q LEFT JOIN u USING (request) GROUP BY ALL),"
    " s AS (SELECT a.request, max(n) AS sk, max(upto) AS sb FROM a JOIN u USING (request) WHERE odd = 1 AND core + br + upto <= 376 GROUP BY 1), r AS (SELECT a.request, max(n) AS rk, max(upto) AS rb FROM a JOIN u USING (request) WHERE odd = 0 AND (core + upto <= 376 OR n = 1) GROUP BY 1),"
    " j AS (SELECT request, coalesce(sk, 0) AS sk, coalesce(rk, 0) AS rk, nr, core + coalesce(sb, 0) + coalesce(rb, 0) AS b FROM a LEFT JOIN s USING (request) LEFT JOIN r USING (request))"
    " SELECT request, CASE WHEN b <= 376 THEN sk END AS sections_kept, CASE WHEN b <= 376 THEN rk END AS rows_kept, CASE WHEN b <= 376 AND rk < nr THEN 10 + rk END AS next_offset, CASE WHEN b <= 376 THEN b END AS bytes, CASE WHEN b <= 376 THEN 'fits' ELSE 'refused' END AS status FROM j"
)
def page_fit(spark, t):
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = t("lineitem").select(F.col("l_orderkey").alias("request"), (F.col("l_linenumber") % 2).alias("odd"), place.alias("place"), (F.col("l_quantity").cast("long") * 3).alias("bytes"))
    requests = t("orders").select(F.col("o_orderkey").alias("request"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("core"), F.lit(10).alias("offset"))
    return paging.fitted(requests, lines.filter("odd = 1").withColumnRenamed("place", "ordinal"), lines.filter("odd = 0").withColumnRenamed("place", "rank"), 1400)


# Signatures of brands over a shelf's variable; each part is an environment that says what lies on its shelf.
@register(
    "SELECT p_partkey AS env, 'call(list(' || CASE WHEN p_size % 4 = 0 THEN 'T' WHEN p_size % 4 = 1 THEN 'list(' || p_type || ')' ELSE p_type END || '), pair(' || p_brand || ', ' || CASE WHEN p_size % 4 = 0 THEN 'T' WHEN p_size % 4 = 1 THEN 'list(' || p_type || ')' ELSE p_type END || '))' AS text,"
    " CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE 'resolved' END AS status FROM part"
)
def generic_substitution(spark, t):
    p, con = t("part"), lambda name, *args: F.struct(name.alias("name"), (F.array(*args) if args else F.expr("cast(array() as array<string>)")).alias("args"))
    at = lambda s: terms.term_id(F.lit("con"), s["name"], s["args"])
    var = terms.variables(spark.createDataFrame([("T",), ("U",)], "name string"))
    ids = {r["name"]: r["term"] for r in var.collect()}  # two variables
    brand, kind = con(F.col("p_brand")), con(F.col("p_type"))
    listed, pair = con(F.lit("list"), F.lit(ids["T"])), con(F.lit("pair"), at(brand), F.lit(ids["T"]))
    call, wrapped = con(F.lit("call"), at(listed), at(pair)), con(F.lit("list"), F.lit(ids["U"]))
    rows = p.select("p_brand", "p_type").distinct().select(F.explode(F.array(brand, kind, listed, pair, call, wrapped)).alias("c")).select("c.name", "c.args")
    odd = F.when(F.col("p_size") % 4 == 1, at(wrapped)).otherwise(at(kind))
    binds = p.filter("p_size % 4 > 0").select(F.col("p_partkey").alias("env"), F.lit("T").alias("name"), odd.alias("term")).union(p.filter("p_size % 4 = 1").select("p_partkey", F.lit("U"), at(kind)))
    got, all_, _ = terms.substituted(terms.built(rows).union(var), binds, p.select(F.col("p_partkey").alias("env"), at(call).alias("root")))
    return got.join(terms.spelled(all_), "term").select("env", "text", "status")


_FRAME = "strlen({0}::VARCHAR) || ':' || {0}::VARCHAR || ';'"
_WORDS = " || ',' || ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))


@register(f"SELECT count(*) AS n, sha256(count(*)::VARCHAR || ',' || {_WORDS}) AS digest FROM (SELECT sha256({' || '.join(_FRAME.format(c) for c in ('c_custkey', 'c_name', 'c_nationkey'))}) AS h FROM customer)")
def relation_digest(spark, t):
    return validation.content_digest(t("customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey", "c_name", "c_nationkey"])


@register(
    "SELECT 'wrong_subtype' AS kind, 'orders' AS relation, 'o_custkey->customer.c_custkey:tag=1' AS detail, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 1) UNION ALL"
    " SELECT 'invariant', 'customer', 'no debt', count(*) FROM customer WHERE c_acctbal < 0"
)
def replay_rules(spark, t):
    r = {"orders": t("orders"), "customer": t("customer").withColumn("tag", F.col("c_nationkey") % 2)}
    subtypes = [("orders", "o_custkey", "customer", "c_custkey", "tag", 1)]
    rules = [("customer", "no debt", F.col("c_acctbal") >= 0), ("orders", "keyed", F.col("o_orderkey").isNotNull())]
    return validation.replay(r, {"customer": ["c_custkey"]}, [("orders", "o_custkey", "customer", "c_custkey")], subtypes, rules)


@register(
    "SELECT p_partkey AS part, CASE WHEN p_size % 4 < 3 THEN 'x-' || p_partkey END AS name, CASE WHEN p_size % 4 < 3 THEN CASE WHEN p_size % 4 = 0 THEN 'a,b-c' ELSE '' END END AS extras, CASE WHEN p_size % 4 < 3 THEN CASE WHEN p_size % 4 = 2 THEN 'https://h.org/x#y' ELSE '' END END AS url,"
    " CASE WHEN p_size % 4 < 3 THEN CASE WHEN p_size % 4 = 2 THEN '' ELSE '<' || p_size + 1 || ',>=1.0' END END AS specifier, CASE WHEN p_size % 4 < 3 THEN CASE WHEN p_size % 4 = 0 THEN '(os_name == ''nt'' or extra == \"t(\") and python_version >= ''3''' ELSE '' END END AS marker, CASE WHEN p_size % 4 = 3 THEN 'invalid' END AS error FROM part"
)
def requirement_parse(spark, t):
    name, size = F.concat(F.lit("X._-"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string")
    spec = F.concat(F.lit(" >= 1.0, <"), (F.col("p_size") + 1).cast("string"))
    line = (
        F.when(F.col("p_size") % 4 == 0, F.concat(name, F.lit(" [B_c, a]"), spec, F.lit(" ; (os_name == 'nt' or extra == \"t(\") and python_version >= '3'"))).when(F.col("p_size") % 4 == 1, F.concat(name, F.lit("("), spec, F.lit(")")))
        .when(F.col("p_size") % 4 == 2, F.concat(name, F.lit(" @ https://h.org/x#y"))).otherwise(F.concat(name, F.lit(" >> "), size))
    )
    return t("part").select(F.col("p_partkey").alias("part"), X.parsed_requirement(line).alias("r")).select("part", "r.*")


def _stored(spark, t) -> str:
    """An index of all documents in the session's checkpoint folder."""
    path = f"{graph.folder(spark.sparkContext)}/index-{uuid.uuid4().hex}"
    search.write_index(t("documents"), "doc_id", "text", path)
    return path


@register(_BM25 + " SELECT doc, round(score, 6) AS score, matched FROM s")
def bm25_indexed(spark, t):
    return search.bm25_stored(spark, _stored(spark, t), TERMS).select("doc", F.round("score", 6).alias("score"), "matched")


@register("SELECT doc, term, tf FROM (WITH " + _POSTS + " SELECT p.* FROM p) p WHERE term IN ('the', 'der', 'of') AND doc IN (SELECT doc_id FROM labels WHERE quality = 1)")
def posting_probe(spark, t):
    return search.candidates_with(spark, _stored(spark, t), t("labels").filter("quality = 1").select(F.col("doc_id").alias("doc")), ["the", "der", "of"]).select("doc", "term", "tf")

"""Scans, filters, joins, aggregates, sorts, sets, scalar functions and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import parts as P
from tessera.functions import text as X
from tessera.operators import aggregates, graph, joins, paging, predicates, ranking, resolution, validation
from tessera.plans import stages
from tessera.plans.catalog import ORACLES, QUERIES, register
from tessera.sources import sql
from tessera.streaming import windows

# ---------------------------------------------------------------- scans and filters


@register("SELECT r_regionkey, r_name FROM region")
def scan_parquet(spark, t):
    return t("region").select("r_regionkey", "r_name")


@register("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#13' AND p_size > 10")
def sql_named_args(spark, t):
    t("part").createOrReplaceTempView("part_args")
    return sql.query(spark, "SELECT p_partkey, p_name FROM part_args WHERE p_brand = :brand AND p_size > :size", {"brand": "Brand#13", "size": 10})


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 33, 100, 512)")
def filter_id_in(spark, t):
    return sql.by_ids(t("orders"), "o_orderkey", [1, 7, 33, 100, 512]).select("o_orderkey", "o_totalprice")


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE FALSE")
def filter_empty_in(spark, t):
    return sql.by_ids(t("orders"), "o_orderkey", []).select("o_orderkey", "o_totalprice")


@register("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%ARD' OR p_type LIKE '%MY'")
def filter_suffix(spark, t):
    return t("part").filter(predicates.suffix("p_type", "ARD", "MY")).select("p_partkey", "p_type")


@register("SELECT event_id, event_type FROM events WHERE event_type = coalesce(json_extract_string(props, '$.kind'), 'click')")
def filter_null_coalesce(spark, t):
    e = t("events").withColumn("kind", F.get_json_object("props", "$.kind")).withColumn("fallback", F.lit("click"))
    return e.filter(predicates.equals_first("event_type", "kind", "fallback")).select("event_id", "event_type")


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90")
def filter_json_field(spark, t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k > 90")


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal IS NOT NULL")
def filter_code_not_in(spark, t):
    return t("customer").filter(predicates.none_of("c_mktsegment", ["BUILDING", "MACHINERY"]) & predicates.is_null("c_acctbal", False)).select("c_custkey", "c_mktsegment")


@register("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top_k_retain(spark, t):
    return ranking.top(t("customer"), 25, F.desc("c_acctbal"), F.col("c_custkey")).select("c_custkey", "c_name")


@register("SELECT count(*) > 0 AS found FROM (SELECT 1 FROM orders WHERE o_totalprice > 100000 LIMIT 1)")
def exists_probe(spark, t):
    return t("orders").filter("o_totalprice > 100000").limit(1).agg((F.count("*") > 0).alias("found"))


# ---------------------------------------------------------------- joins


@register("SELECT l_orderkey, o_custkey, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def join_inner_fk(spark, t):
    return joins.reference(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey").groupBy("l_orderkey", "o_custkey").agg(F.sum("l_quantity").alias("qty"))


@register("SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_reverse_owner(spark, t):
    return joins.owned_reverse(t("orders"), "o_orderkey", t("lineitem"), "l_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("lines"))


@register("SELECT doc_id AS source_id, CAST(u.i - 1 AS INTEGER) AS ordinal, u.w AS target_id FROM (SELECT doc_id, string_split(lower(text), ' ') AS ws FROM documents), LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) u")
def join_list_unnest(spark, t):
    return joins.list_reference(t("documents").select("doc_id", F.split(F.lower("text"), " ").alias("ws")), "doc_id", "ws")


@register("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 10 LEFT JOIN region ON n_regionkey = r_regionkey")
def join_optional_pairs(spark, t):
    n, r = t("nation").filter("n_nationkey < 10"), t("region")
    return joins.optional_pairs(t("customer"), (n, F.col("c_nationkey") == F.col("n_nationkey")), (r, F.col("n_regionkey") == F.col("r_regionkey"))).select("c_custkey", "n_name", "r_name")


@register("SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity, l_shipdate) AS n FROM lineitem) WHERE n = 1")
def join_first_pair(spark, t):
    order = [F.desc("l_extendedprice"), *map(F.col, ("l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))]
    return joins.first_pairs(t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@register(
    "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest_id FROM events"
)
def join_nearest_pair(spark, t):
    e = joins.nearest_earlier(t("events"), "user_id", "ts", "event_id", F.col("event_type") == "click")
    return e.select("event_id", "user_id", F.col("nearest.key").alias("nearest_id"))


_SPANS = "SELECT user_id, event_id AS id, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + CAST(floor(abs(value)) AS BIGINT) * {m} AS stop FROM events WHERE {w}"


def _spans(t, m, w):
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return t("events").filter(w).select("user_id", F.col("event_id").alias("id"), start.alias("start"), (start + F.floor(F.abs("value")) * m).alias("stop"))


@register(f"SELECT o.id AS outer_id, i.id AS inner_id FROM ({_SPANS.format(m=1000, w='event_id % 3 = 0')}) o JOIN ({_SPANS.format(m=10, w='event_id % 3 <> 0')}) i ON o.user_id = i.user_id AND i.start >= o.start AND i.stop <= o.stop")
def join_span_contains(spark, t):
    return joins.contained(_spans(t, 1000, "event_id % 3 = 0"), _spans(t, 10, "event_id % 3 <> 0"), "user_id").select("outer_id", "inner_id")


@register(
    f"WITH p AS (SELECT o.id AS outer_id, i.id AS inner_id, o.stop - o.start AS w FROM ({_SPANS.format(m=1000, w='event_id % 3 = 0')}) o JOIN ({_SPANS.format(m=10, w='event_id % 3 <> 0')}) i"
    " ON o.user_id = i.user_id AND i.start >= o.start AND i.stop <= o.stop), r AS (SELECT *, rank() OVER (PARTITION BY inner_id ORDER BY w) AS r FROM p)"
    " SELECT inner_id, CASE WHEN count(*) = 1 THEN min(outer_id) END AS outer_id, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM r WHERE r = 1 GROUP BY inner_id"
)
def join_innermost_span(spark, t):
    return joins.innermost(joins.contained(_spans(t, 1000, "event_id % 3 = 0"), _spans(t, 10, "event_id % 3 <> 0"), "user_id"))


@register("SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation WHERE r_regionkey = n_regionkey OR n_nationkey < r_regionkey")
def join_cross_filter(spark, t):
    return t("region").crossJoin(t("nation")).filter("r_regionkey = n_regionkey OR n_nationkey < r_regionkey").select("r_regionkey", "n_nationkey")


@register("SELECT a.l_orderkey, a.l_partkey AS part_a, b.l_partkey AS part_b FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey")
def join_self(spark, t):
    d = t("lineitem").select("l_orderkey", "l_partkey").distinct()
    return d.withColumnRenamed("l_partkey", "part_a").join(d.withColumnRenamed("l_partkey", "part_b"), "l_orderkey").filter("part_a < part_b")


@register("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def anti_orphans(spark, t):
    big = t("lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.without(t("orders"), big, ["o_orderkey"]).select("o_orderkey")


@register("SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def left_join_is_null(spark, t):
    return t("customer").join(t("orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left").filter("o_orderkey IS NULL").select("c_custkey")


@register(
    "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)"
)
def not_exists_pair(spark, t):
    key = F.col("l_partkey").alias("p_partkey")
    a, b = t("lineitem").filter("l_quantity > 48").select(key), t("lineitem").filter("l_discount > 0.09").select(key)
    return joins.without(joins.without(t("part"), a, ["p_partkey"]), b, ["p_partkey"]).select("p_partkey")


@register("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = s_nationkey AND r_name IN ('ASIA', 'EUROPE'))")
def semi_exists_role(spark, t):
    role = t("nation").join(t("region").filter(predicates.one_of("r_name", ["ASIA", "EUROPE"])), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"))
    return joins.having(t("supplier"), role, ["s_nationkey"]).select("s_suppkey")


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def not_in_union(spark, t):
    o = t("orders")
    out = o.filter("o_orderstatus = 'F'").select("o_custkey").unionAll(o.filter("o_totalprice > 400000").select("o_custkey")).withColumnRenamed("o_custkey", "c_custkey")
    return joins.without(t("customer"), out, ["c_custkey"]).select("c_custkey")


@register(
    "SELECT n_name, p_brand, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
    " JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = c_nationkey GROUP BY 1, 2"
)
def join_six_way(spark, t):
    j = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey"))
    j = j.join(t("part"), F.expr("l_partkey = p_partkey")).join(t("supplier"), F.expr("l_suppkey = s_suppkey AND s_nationkey = c_nationkey"))
    return j.groupBy("n_name", "p_brand").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@register("SELECT l_partkey, l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_quantity) AS n FROM lineitem) WHERE n = 1")
def join_best_pair(spark, t):
    return joins.best_pairs(t("lineitem"), ["l_partkey", "l_suppkey"], "l_extendedprice", ["l_orderkey", "l_quantity"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice")


# ---------------------------------------------------------------- aggregates


@register("SELECT l_returnflag, l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2")
def agg_min_first_use(spark, t):
    return aggregates.first_use(t("lineitem"), ["l_returnflag", "l_partkey"], "l_orderkey")


@register("SELECT DISTINCT event_type FROM events WHERE value > 50")
def distinct_partitions(spark, t):
    return t("events").filter("value > 50").select("event_type").distinct()


@register("SELECT DISTINCT id FROM (SELECT user_id AS id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE value > 90 UNION ALL SELECT event_id FROM events WHERE event_type = 'purchase')")
def agg_distinct_family(spark, t):
    e = t("events")
    return aggregates.family([e.filter("event_type = 'click'").select(F.col("user_id").alias("id")), e.filter("value > 90").select(F.col("user_id").alias("id")), e.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"))])


@register("SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def agg_canonical_count(spark, t):
    return aggregates.canonical_counts(t("lineitem"), "l_returnflag", "l_partkey")


_SHARE = "WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM p GROUP BY 1) SELECT l_suppkey, round(sum(1.0::DOUBLE / n), 6) AS share, count(*) AS sites FROM p JOIN n USING (l_orderkey)"


@register(_SHARE + " GROUP BY 1")
def usage_share(spark, t):
    s = aggregates.usage_share(t("lineitem"), "l_orderkey", "l_suppkey")
    return s.select("l_suppkey", F.round("share", 6).alias("share"), "sites")


PAIRS_SQL = "WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem), pairs AS (SELECT x.s AS a, y.s AS b, count(*) AS n FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.s < y.s GROUP BY 1, 2)"


def supplier_pairs(t):
    lines = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("s"))
    n = lines.count()
    d = P.spread(lines, "l_orderkey", rows=n).distinct()
    pairs = d.withColumnRenamed("s", "a").join(d.withColumnRenamed("s", "b"), "l_orderkey").filter("a < b").select("a", "b")
    return P.spread(pairs, "a", "b", rows=2 * n).groupBy("a", "b").agg(F.count("*").alias("n"))


@register(
    PAIRS_SQL + ", st AS (SELECT v, sum(n) AS s FROM (SELECT a AS v, n FROM pairs UNION ALL SELECT b, n FROM pairs) GROUP BY 1), t AS (SELECT percentile_disc(0.95) WITHIN GROUP (ORDER BY s) AS t FROM st),"
    " w AS (SELECT a, b, n * least(1.0::DOUBLE, t::DOUBLE / sa.s) * least(1.0::DOUBLE, t::DOUBLE / sb.s) AS w FROM pairs JOIN st sa ON sa.v = a JOIN st sb ON sb.v = b CROSS JOIN t)"
    " SELECT a, b, round(w / (SELECT sum(w) FROM w), 9) AS weight FROM w"
)
def layer_weights(spark, t):
    return aggregates.layer_weights(supplier_pairs(t)).select("a", "b", F.round("weight", 9).alias("weight"))


@register("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def agg_canonical_pairs(spark, t):
    return aggregates.canonical_pairs(t("lineitem").filter("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.lit(1).cast("long").alias("n")))


@register("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def agg_pricing_summary(spark, t):
    x = t("lineitem").filter("l_shipdate <= TIMESTAMP '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return x.agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


# ---------------------------------------------------------------- ranking, pages, sets


@register("SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY CASE WHEN p_partkey = 77 OR p_brand = 'Brand#11' THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part")
def promotion_order(spark, t):
    exact = (F.col("p_partkey") == 77) | (F.col("p_brand") == "Brand#11")
    return ranking.promoted_first(t("part"), exact, F.desc("p_retailprice"), F.col("p_partkey")).select("p_partkey", "p_name", "rank")


@register(
    "WITH r AS (SELECT p_partkey AS candidate, p_brand AS community, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part WHERE p_size > 5),"
    " c AS (SELECT candidate FROM r WHERE place <= 10 ORDER BY score DESC, candidate LIMIT 30)"
    " SELECT p_partkey AS candidate, p_brand AS community, p_retailprice AS score, CASE WHEN p_size <= 5 THEN 'ineligible' WHEN c.candidate IS NOT NULL THEN 'selected' WHEN r.place > 10 THEN 'community_cap' ELSE 'budget' END AS reason"
    " FROM part LEFT JOIN r ON r.candidate = p_partkey LEFT JOIN c ON c.candidate = p_partkey"
)
def seeds_capped(spark, t):
    c = t("part").select(F.col("p_partkey").alias("candidate"), F.col("p_brand").alias("community"), F.col("p_retailprice").alias("score"), (F.col("p_size") > 5).alias("eligible"))
    return ranking.capped_seeds(c, 30)


@register("SELECT o_orderkey, o_totalprice, greatest((SELECT count(*) FROM orders WHERE o_orderkey > 500) - 20, 0) AS omitted FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 20")
def keyset_page(spark, t):
    return paging.page(t("orders"), "o_orderkey", 20, 500).select("o_orderkey", "o_totalprice", "omitted")


@register("SELECT o_custkey, o_orderkey, place::INTEGER AS place, greatest(n - 3, 0) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE place <= 3")
def nested_pages(spark, t):
    return paging.nested_pages(t("orders"), "o_custkey", "o_orderkey", 3).select("o_custkey", "o_orderkey", "place", "omitted")


@register("SELECT o_orderkey, o_totalprice, rank FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders) WHERE rank BETWEEN 200 AND 299")
def retained_pages(spark, t):
    """The third page of a hundred of the orders by price, after the cursors of the first two; the ranking is made once."""
    path, request = f"{graph.folder(spark.sparkContext)}/rankings-{uuid.uuid4().hex}", {"query": "orders by price"}
    paging.retain({"orders": (t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])}, path, request, "now")
    token = None
    for _ in range(3):
        rows, token = paging.retained_page(spark, path, request, "now", "orders", 100, token)
    return rows


# A supplier asks for its own name, a brand, the brand again, and a size of parts.
@register(
    "WITH c AS (SELECT DISTINCT * FROM (SELECT s_name AS name, s_suppkey AS target, s_acctbal > 0 AS eligible FROM supplier UNION ALL SELECT p_brand, p_partkey, true FROM part WHERE p_size < 3)), k AS (SELECT name, count(*) AS matches, min(target) AS target, max(eligible) AS eligible FROM c GROUP BY 1),"
    " r AS (SELECT s_suppkey AS plan, unnest([s_name, 'Brand#' || (10 + s_nationkey), 'Brand#' || (10 + s_nationkey), NULL]) AS name, unnest([0, 1, 2, 3]) AS ordinal FROM supplier)"
    " SELECT plan, ordinal::INTEGER AS ordinal, name, CASE WHEN matches = 1 THEN target END AS target, coalesce(matches, 0) AS matches, CASE WHEN matches IS NULL THEN 'missing' WHEN matches > 1 THEN 'ambiguous' WHEN eligible THEN 'selected' ELSE 'ineligible' END AS status FROM r LEFT JOIN k USING (name)"
)
def configured_seeds(spark, t):
    brand = F.concat(F.lit("Brand#"), (F.lit(10) + F.col("s_nationkey")).cast("string"))
    requests = t("supplier").select(F.col("s_suppkey").alias("plan"), F.array("s_name", brand, brand, F.lit(None).cast("string")).alias("names"))
    own = t("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("target"), (F.col("s_acctbal") > 0).alias("eligible"))
    return ranking.configured_seeds(requests, own.union(t("part").filter("p_size < 3").select("p_brand", "p_partkey", F.lit(True))))


@register("SELECT source, doc_id, CAST(running AS BIGINT) AS running FROM (SELECT source, doc_id, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 32768")
def byte_pack(spark, t):
    return paging.packed_by(t("documents"), "source", [F.col("doc_id")], F.octet_length("text"), 32_768).select("source", "doc_id", "running")


@register("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def union_except(spark, t):
    return t("customer").select(F.col("c_custkey").alias("id")).subtract(t("orders").filter("o_orderstatus = 'F'").select("o_custkey"))


@register("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def intersect_keys(spark, t):
    o = t("orders")
    return o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")).intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@register("SELECT r_name AS name, 'region' AS kind FROM region UNION ALL SELECT n_name, 'nation' FROM nation")
def union_all_members(spark, t):
    return t("region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")).unionByName(t("nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")))


@register("SELECT event_id, user_id, CAST(rank AS INTEGER) AS rank, round(running, 6) AS running FROM (SELECT event_id, user_id, row_number() OVER w AS rank, sum(value) OVER w AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))")
def window_running(spark, t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", "user_id", F.row_number().over(w).alias("rank"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running"))


# ---------------------------------------------------------------- scalar functions


@register("SELECT p_partkey, substr(sha256('4:part;' || octet_length(encode(p_name))::VARCHAR || ':' || p_name || ';' || length(p_size::VARCHAR)::VARCHAR || ':' || p_size::VARCHAR || ';'), 1, 32) AS id FROM part")
def ids_framed(spark, t):
    return t("part").select("p_partkey", X.framed_id("part", F.col("p_name"), F.col("p_size")).alias("id"))


@register("SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*$') AS dotted, lower(regexp_replace(p_type, '[-_.]+', '-', 'g')) AS normal FROM part")
def name_tests(spark, t):
    return t("part").select("p_partkey", X.is_dotted(F.col("p_name")).alias("dotted"), X.normal_name(F.col("p_type")).alias("normal"))


@register(
    "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*')) AS name FROM documents)"
    " SELECT doc_id, name, count(*) AS n FROM w WHERE regexp_matches(name, '[^_]_+[^_]') OR (length(regexp_replace(name, '[^A-Z]', '', 'g')) >= 2 AND regexp_matches(name, '[a-z]')) GROUP BY 1, 2"
)
def mention_rules(spark, t):
    names = t("documents").select("doc_id", F.explode(X.identifiers(F.col("text"))).alias("name"))
    return names.filter(X.is_distinctive(F.col("name"))).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@register()
def text_windows(spark, t):
    return t("documents").select("doc_id", F.posexplode(X.windows_udf(4096)("text")).alias("ordinal", "part")).select("doc_id", "ordinal", F.octet_length("part").alias("bytes"), F.sha2("part", 256).alias("content_id"))


@register(
    r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*')) AS n, strlen(regexp_extract(text, '(?s)^.*[A-Za-z_][A-Za-z0-9_]*'))::INTEGER AS last_stop FROM documents WHERE regexp_matches(text, '[A-Za-z_]')"
)
def identifier_spans(spark, t):
    return t("documents").select("doc_id", F.explode(X.identifier_spans("text")).alias("s")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("s.stop").alias("last_stop"))


@register("SELECT content_id, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT sha256(text) AS content_id, doc_id FROM documents) GROUP BY 1 HAVING count(*) > 1")
def near_duplicate_ids(spark, t):
    return t("documents").select(X.content_id(F.col("text")).alias("content_id"), "doc_id").groupBy("content_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@register(
    "SELECT page_id, len(list_filter(string_split_regex(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[^a-z0-9]+'), lambda x: x <> ''))::INTEGER AS tokens, length(html)::INTEGER AS chars FROM pages"
)
def page_html_text(spark, t):
    words = F.filter(F.split(F.lower(F.regexp_replace("html", "<[^>]*>", " ")), "[^a-z0-9]+"), lambda w: w != "")
    return t("pages").select("page_id", F.size(words).alias("tokens"), F.length("html").alias("chars"))


@register("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS previous_role, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations")
def conversation_turns(spark, t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t("conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous_role"), F.count("*").over(Window.partitionBy("conv_id")).alias("turns"))


@register("SELECT p_partkey, CASE WHEN a = b THEN 'rest' WHEN len(a) <= len(b) AND b[1:len(a)] = a THEN 'rest' WHEN a[1:len(b)] = b THEN 'shorter' ELSE 'disjoint' END AS relation FROM (SELECT p_partkey, string_split(p_type, ' ') AS a, string_split(split_part(p_type, ' ', 1), ' ') AS b FROM part)")
def path_relations(spark, t):
    return t("part").select("p_partkey", X.path_relation(F.split("p_type", " "), F.split(F.split_part("p_type", F.lit(" "), F.lit(1)), " ")).alias("relation"))


# ---------------------------------------------------------------- resolution and validation


@register(
    "WITH c AS (SELECT source || '/' || n_chars AS name, lang AS candidate FROM documents), n AS (SELECT name, count(DISTINCT candidate) AS n, min(candidate) AS sole FROM c GROUP BY 1)"
    " SELECT doc_id, source || '/' || (n_chars + 1) AS source, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN sole END AS target, CASE WHEN coalesce(n, 0) = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM documents LEFT JOIN n ON n.name = source || '/' || (n_chars + 1)"
)
def resolve_status(spark, t):
    d = t("documents")
    c = d.select(F.concat("source", F.lit("/"), F.col("n_chars")).alias("name"), F.col("lang").alias("candidate"))
    return resolution.resolve(d.select("doc_id", F.concat("source", F.lit("/"), F.col("n_chars") + 1).alias("source")), "doc_id", "source", c, "candidate", "name")


@register(
    "WITH a AS (SELECT o_custkey AS k, o_orderpriority AS s, max(o_orderstatus) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT o_custkey AS k, o_orderpriority AS s, max(o_orderstatus) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2)"
    " SELECT coalesce(a.k, b.k) AS k, coalesce(a.s, b.s) AS s, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN a.v IS NULL OR b.v IS NULL THEN 'unresolved' WHEN a.v = b.v THEN 'same' ELSE 'different' END AS status FROM a FULL JOIN b ON a.k = b.k AND a.s = b.s"
)
def contract_comparison(spark, t):
    side = lambda r: t("orders").filter(f"o_orderkey % 2 = {r}").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("s")).agg(F.max("o_orderstatus").alias("v"))
    return resolution.compared(side(0), side(1), "k", "s", "v")


@register(
    "SELECT 'missing_reference' AS kind, 'lineitem' AS relation, 'l_orderkey->odd.o_orderkey' AS detail, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1) HAVING count(*) > 0"
)
def validate_fk(spark, t):
    r = {"lineitem": t("lineitem"), "odd": t("orders").filter("o_orderkey % 2 = 1"), "orders": t("orders"), "nation": t("nation"), "region": t("region")}
    return validation.replay(r, {}, [("lineitem", "l_orderkey", "odd", "o_orderkey"), ("nation", "n_regionkey", "region", "r_regionkey")])


@register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def validate_keys(spark, t):
    return validation.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@register("SELECT o_orderkey, o_custkey, CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, abs(d)::BIGINT AS n FROM (SELECT o_orderkey, o_custkey, sum(d) AS d FROM (SELECT o_orderkey, o_custkey, 1 AS d FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, o_custkey, -1 FROM orders WHERE o_orderkey % 11 <> 0) GROUP BY 1, 2) WHERE d <> 0")
def reconcile(spark, t):
    o = t("orders").select("o_orderkey", "o_custkey")
    return validation.reconcile(o.filter("o_orderkey % 10 <> 0"), o.filter("o_orderkey % 11 <> 0"))


@register("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, t):
    return windows.tumbling(t("events")).withColumn("total", F.round("total", 4))


def _stream_followed(spark, sf_dir):
    """The same windows by a stream over the table's files, run to its end, whose changes are kept batch by batch."""
    where, path = f"{graph.folder(spark.sparkContext)}/stream-{uuid.uuid4().hex}", f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a glob: the table may be a file or a folder
    windows.follow(events, f"{where}/windows", f"{where}/checkpoint")
    return windows.followed(spark, f"{where}/windows").withColumn("total", F.round("total", 4))


QUERIES["stream_followed"], ORACLES["stream_followed"] = _stream_followed, ORACLES["stream_tumbling"]


# ---------------------------------------------------------------- parts, anchors, schedules


@register("SELECT c_custkey AS scope, o.definition, CASE WHEN ok IS NULL THEN 'not_requested' WHEN ok THEN 'available' ELSE 'failed' END AS availability FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS definition FROM orders) o LEFT JOIN (SELECT o_custkey, o_orderpriority, bool_and(o_orderstatus <> 'F') AS ok FROM orders GROUP BY 1, 2) r ON r.o_custkey = c_custkey AND r.o_orderpriority = o.definition")
def stage_frontier(spark, t):
    planned = t("customer").select(F.col("c_custkey").alias("scope")).crossJoin(t("orders").select(F.col("o_orderpriority").alias("definition")).distinct())
    results = t("orders").groupBy(F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("definition")).agg(F.bool_and(F.col("o_orderstatus") != "F").alias("ok"))
    return stages.frontier(planned, results)


@register("SELECT n_name, count(*) AS customers, max(c_acctbal) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def stage_schedule(spark, t):
    steps = [
        stages.Stage("report", ("joined",), ("report",), lambda r: {"report": r["joined"].groupBy("n_name").agg(F.count("*").alias("customers"), F.max("c_acctbal").alias("best"))}),
        stages.Stage("join", ("customer", "nation"), ("joined",), lambda r: {"joined": joins.reference(r["customer"], "c_nationkey", r["nation"], "n_nationkey")}),
    ]
    return stages.execute(steps, {"customer": t("customer"), "nation": t("nation")})["report"]


@register(
    "SELECT event_id AS id, CASE WHEN NOT bad THEN user_id END AS artifact, CASE WHEN NOT bad THEN cs + start END AS start, CASE WHEN NOT bad THEN cs + stop END AS stop, CASE WHEN bad THEN 'outside' END AS error FROM"
    " (SELECT event_id, user_id, CAST(user_id * 100 AS BIGINT) AS cs, CAST(floor(value) AS BIGINT) AS start, CAST(floor(value) AS BIGINT) + 10 AS stop, floor(value) < 0 OR floor(value) + 10 > 90 AS bad FROM events)"
)
def anchor_ranges(spark, t):
    e = t("events")
    v = F.floor("value").cast("long")
    containers = e.select(F.col("user_id").alias("id"), F.col("user_id").alias("artifact"), (F.col("user_id") * 100).alias("start"), (F.col("user_id") * 100 + 90).alias("stop")).distinct()
    return P.anchored(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("container"), v.alias("start"), (v + 10).alias("stop")), containers)


@register(
    "SELECT o.o_orderkey AS unit, l.l_partkey AS token, o.o_custkey AS source, o.o_custkey * 1000 + greatest(s, 0) AS source_start, o.o_custkey * 1000 + least(e, 40) AS source_stop FROM orders o"
    " JOIN (SELECT DISTINCT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + l_linenumber AS e FROM lineitem) l ON l.l_orderkey = o.o_orderkey WHERE s < 40 AND e > 0 AND e > s"
)
def token_ranges(spark, t):
    q = F.col("l_quantity").cast("long")
    tokens = t("lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("token"), q.alias("start"), (q + F.col("l_linenumber")).alias("stop")).distinct()
    maps = t("orders").select(F.col("o_orderkey").alias("unit"), F.lit(0).cast("long").alias("start"), F.lit(40).cast("long").alias("stop"), F.col("o_custkey").alias("source"), (F.col("o_custkey") * 1000).alias("source_start"))
    return P.token_ranges(tokens, maps)


@register(
    "WITH RECURSIVE p AS (SELECT source AS unit, lang AS context, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS ordinal, floor(length(text) / 4.0)::BIGINT AS tokens FROM documents),"
    " r AS (SELECT *, 0 AS part, tokens AS used FROM p WHERE ordinal = 1 UNION ALL SELECT p.unit, p.context, p.ordinal, p.tokens, r.part + CASE WHEN used + p.tokens <= 1024 OR used = 0 THEN 0 ELSE 1 END, CASE WHEN used + p.tokens <= 1024 OR used = 0 THEN used ELSE 0 END + p.tokens"
    " FROM r JOIN p ON p.unit IS NOT DISTINCT FROM r.unit AND p.context IS NOT DISTINCT FROM r.context AND p.ordinal = r.ordinal + 1) SELECT unit, context, ordinal, tokens, part, tokens > 2048 AS lexical_only FROM r"
)
def token_parts(spark, t):
    d = t("documents").select(F.col("source").alias("unit"), F.col("lang").alias("context"), F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")).alias("ordinal"), (F.length("text") / 4).cast("long").alias("tokens"))
    return P.token_parts(d)


@register(
    "WITH h AS (SELECT o_orderkey AS k, sha256(o_custkey || chr(1) || o_orderkey) AS h FROM orders), r AS (SELECT h, row_number() OVER (ORDER BY k, h) - 1 AS rank FROM h)"
    " SELECT rank // 4096 AS chunk, count(*) AS n, sha256(string_agg(h, '' ORDER BY rank)) AS digest FROM r GROUP BY 1"
)
def chunk_digests(spark, t):
    return P.chunk_digests(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("chunk", "n", "digest")


@register(
    "WITH RECURSIVE par AS (SELECT p_partkey AS c, p_partkey // 3 AS p, CASE WHEN p_size % 10 = 0 THEN 2 WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS r FROM part WHERE p_partkey > 0),"
    " a AS (SELECT c AS class, p AS ancestor, 1 AS depth, r FROM par UNION ALL SELECT class, par.p, depth + 1, greatest(a.r, par.r) FROM a JOIN par ON par.c = a.ancestor)"
    " SELECT class, ancestor, depth::INTEGER AS depth, ['resolved', 'ambiguous', 'unresolved'][r + 1] AS status FROM a"
)
def ancestry_status(spark, t):
    status = F.when(F.col("p_size") % 10 == 0, "unresolved").when(F.col("p_size") % 5 == 0, "ambiguous").otherwise("resolved")
    par = t("part").filter("p_partkey > 0").select(F.col("p_partkey").alias("class"), F.floor(F.col("p_partkey") / 3).alias("parent"), status.alias("status"))
    return resolution.ancestry(par.select("class"), par)


@register(
    "WITH f AS (SELECT doc_id AS doc, lang || n_chars % 200 AS name FROM documents), v AS (SELECT lang || (n_chars + 1) % 200 AS name, doc_id % 3 AS exposure, source AS context FROM documents), l AS (SELECT doc_id AS doc, source AS context FROM documents)"
    " SELECT f.doc, f.name, l.context, count(DISTINCT v.exposure) AS candidates, CASE WHEN count(DISTINCT v.exposure) = 1 THEN min(v.exposure) END AS exposure, CASE count(DISTINCT v.exposure) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status"
    " FROM f JOIN l ON l.doc = f.doc LEFT JOIN v ON v.name = f.name AND v.context = l.context GROUP BY 1, 2, 3"
)
def mention_exposures(spark, t):
    d = t("documents")
    return resolution.mentions(
        d.select(F.col("doc_id").alias("doc"), F.concat("lang", F.col("n_chars") % 200).alias("name")),
        d.select(F.concat("lang", (F.col("n_chars") + 1) % 200).alias("name"), (F.col("doc_id") % 3).alias("exposure"), F.col("source").alias("context")),
        d.select(F.col("doc_id").alias("doc"), F.col("source").alias("context")),
    )


@register("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '''' || p_name || '''' WHEN p_size % 3 = 1 THEN p_size::VARCHAR ELSE '<call>' END AS shown FROM part")
def value_presentation(spark, t):
    kind = F.when(F.col("p_size") % 3 == 0, "text").when(F.col("p_size") % 3 == 1, "int").otherwise("call")
    return t("part").select("p_partkey", P.presented(kind, F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))).alias("shown"))

"""Queries of scans, joins, aggregates, windows, set operations, subqueries and changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from polymera.functions import arrays, json_functions, maths, strings
from polymera.operators import aggregates, arrays as nd, dml, joins, keyvalue, security, temporal, windows
from polymera.plans.base import Tables, both, query


@query(
    "q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def q1(t: Tables):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("count_order"))


both(
    "scan_filter_project",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) AS DOUBLE) AS net FROM {lineitem}
    WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'N') AND l_discount IS NOT NULL AND NOT (l_linestatus = 'F')""",
)
both("point_get", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS total FROM {orders} WHERE o_orderkey = 7")
both("range_scan", "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_custkey >= 100 AND c_custkey < 200")
both("like_and_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END AS is_11 FROM {part} WHERE p_name LIKE '%a%' AND p_type NOT LIKE '%zzz%'")
both("constant_result", "SELECT 1 AS one, 'x' || 'y' AS xy, 7 % 3 AS m, CAST('12' AS INT) AS n")
both("join_inner", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_mktsegment")
both("join_left_residual", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000 GROUP BY c.c_custkey")
both("join_right", "SELECT n_name, count(s_suppkey) AS suppliers FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name")
both("join_full", "SELECT c.c_custkey, s.s_suppkey FROM {customer} c FULL OUTER JOIN {supplier} s ON c.c_custkey = s.s_suppkey")
both("join_semi_exists", "SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
both("join_anti_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
both("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
both("join_theta", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
both("join_using_five_way", "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
both("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders})")
both("lateral_loop", "SELECT n.n_nationkey, x.cnt FROM {nation} n, LATERAL (SELECT count(*) AS cnt FROM {customer} c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > n.n_nationkey * 100) x")
both("group_by_expression_alias", "SELECT upper(substr(p_brand, 1, 7)) AS b, count(*) AS n FROM {part} GROUP BY b")
both("having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 0")
both("aggregate_empty_input", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM {orders} WHERE o_orderkey < 0")
both("aggregate_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS custs, count(DISTINCT o_orderpriority) AS prios FROM {orders} GROUP BY o_orderstatus")
both("statistics", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, min(l_shipdate) AS lo, max(l_quantity) AS hi FROM {lineitem} GROUP BY l_returnflag")
both("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("union_all", "SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey AS k FROM {region}")
both("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
both("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}")
both("intersect_distinct", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}")
both("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}")
both("except_distinct", "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey AS k FROM {customer} WHERE c_acctbal > 0")
both("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
both("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE s > 1000000) SELECT o_custkey, round(s, 2) AS s FROM top")
both("recursive_value", "WITH RECURSIVE f(n, a, b) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT n, a FROM f")
both("recursive_scan", "WITH RECURSIVE d(k, depth) AS (SELECT n_nationkey AS k, 0 AS depth FROM {nation} WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, d.depth + 1 FROM d JOIN {nation} n ON n.n_nationkey = d.k * 2 + 1) SELECT k, depth FROM d")
both("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
both("sort_nulls_last", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey) AS BIGINT) AS r FROM {orders}")
both("window_ranking", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
both("window_offset", "SELECT o_orderkey, lag(o_totalprice) OVER w AS lag1, lead(o_totalprice, 2, 0.0) OVER w AS lead2, first_value(o_totalprice) OVER w AS fv, nth_value(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nv FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("window_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, count(*) OVER w AS n, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a, max(o_totalprice) OVER w AS m FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)")
both("window_range", "SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM {lineitem}")


@query("window_groups", "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS s FROM orders")
def window_groups(t: Tables):
    return windows.groups_frame(t.orders, ["o_orderstatus"], ["o_custkey"], -1, 0, s=F.sum("o_custkey")).select("o_orderkey", "s")


@query("window_ntile", "SELECT c_custkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) * 4 / count(*) OVER (PARTITION BY c_nationkey)) + 1 AS INT) AS bucket FROM customer")
def window_ntile(t: Tables):
    return t.customer.select("c_custkey", windows.ntile(4, ["c_nationkey"], ["c_custkey"]).alias("bucket"))


@query("latest_on", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_on(t: Tables):
    return windows.latest_by_key(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("percentile_cont", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def percentile_cont(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(aggregates.percentile_cont(F.col("l_extendedprice")), 4).alias("med"), F.round(aggregates.percentile_cont(F.col("l_extendedprice"), 0.9), 4).alias("p90"))


@query("string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def string_agg(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(aggregates.string_agg(F.col("n_name")).alias("names"))


@query("array_agg_distinct", "SELECT o_orderstatus, list_sort(list(DISTINCT o_orderpriority)) AS prios FROM orders GROUP BY 1")
def array_agg_distinct(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("prios"))


@query("facet_counts", """SELECT field, value, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM (
    SELECT 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type
    UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size)) WHERE r <= 5""")
def facet_counts(t: Tables):
    return aggregates.facets(t.part, ["p_brand", "p_type", "p_size"], 5)


@query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::TINYINT AS grouping_o_orderstatus, grouping(o_orderpriority)::TINYINT AS grouping_o_orderpriority FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t: Tables):
    return aggregates.grouping_sets(t.orders, [["o_orderstatus"], ["o_orderpriority"], []], ["o_orderstatus", "o_orderpriority"], n=F.count("*"))


@query("heavy_hitters", "SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def heavy_hitters(t: Tables):
    return aggregates.top_k_exact(t.lineitem, "l_partkey", 10)


@query("approx_aggregates")
def approx_aggregates(t: Tables):
    return t.lineitem.agg(aggregates.approx_count_distinct(F.col("l_partkey")).alias("parts"), aggregates.approx_percentile(F.col("l_quantity"), 0.5).alias("median"), aggregates.approx_top_k("l_returnflag", 3).alias("flags"))


@query("materialized_sum", "SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS balance FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def materialized_sum(t: Tables):
    return dml.materialized_sum(t.customer, "c_custkey", t.orders, "o_custkey", "o_totalprice", "balance").select("c_custkey", F.round("balance", 2).alias("balance"))


@query("lateral_top_k", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) ON o_custkey = c_custkey AND n <= 2")
def lateral_top_k(t: Tables):
    return joins.lateral_top_k(t.customer, t.orders, "c_custkey", "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("c_custkey", "o_orderkey")


@query("not_in_plain_anti", "SELECT c_custkey FROM customer ANTI JOIN (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS k FROM orders WHERE o_totalprice > 300000) ON c_custkey = k")
def not_in_plain_anti(t: Tables):
    keys = t.orders.where("o_totalprice > 300000").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("k"))
    return joins.in_subquery(t.customer, "c_custkey", keys, negate=True).select("c_custkey")


@query("interval_join", "SELECT a.event_id, c.s_suppkey FROM events a JOIN supplier c ON a.value BETWEEN floor(c.s_acctbal / 100) AND floor(c.s_acctbal / 100) + 3")
def interval_join(t: Tables):
    spans = t.supplier.withColumn("lo", F.floor(F.col("s_acctbal") / 100)).withColumn("hi", F.col("lo") + 3)
    return joins.interval_join(t.events, spans, "value", "lo", "hi", 4).select("event_id", "s_suppkey")


@query("insert_select", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def insert_select(t: Tables):
    return dml.insert(t.nation.select("n_nationkey", "n_name"), t.region.select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name")))


@query("insert_or_ignore", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_or_ignore(t: Tables):
    new = t.customer.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return dml.insert_or_ignore(t.supplier.select("s_suppkey", "s_name"), new, ["s_suppkey"])


@query("upsert", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def upsert(t: Tables):
    new = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return dml.upsert(t.supplier.select("s_suppkey", "s_name"), new, ["s_suppkey"])


@query("on_conflict_update", "SELECT coalesce(s_suppkey, c_custkey) AS k, CASE WHEN s_suppkey IS NULL THEN c_acctbal WHEN c_custkey IS NULL THEN s_acctbal ELSE round(s_acctbal + c_acctbal, 2) END AS bal FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def on_conflict_update(t: Tables):
    target = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    new = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return dml.on_conflict_update(target, new, ["k"], {"bal": F.round(F.col("target.bal") + F.col("excluded.bal"), 2)})


@query("update_rows", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal * 1.1, 2) ELSE c_acctbal END AS c_acctbal FROM customer")
def update_rows(t: Tables):
    return dml.update(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.round(F.col("c_acctbal") * 1.1, 2)}).drop("c_mktsegment")


@query("update_from", "SELECT c_custkey, coalesce(n_name, c_name) AS c_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
def update_from(t: Tables):
    return dml.update_from(t.customer.select("c_custkey", "c_name", "c_nationkey"), t.nation.where("n_regionkey = 1"), "c_nationkey", "n_nationkey", {"c_name": F.col("source.n_name")}).drop("c_nationkey")


@query("delete_rows", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, FALSE)")
def delete_rows(t: Tables):
    return dml.delete(t.customer.select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0).drop("c_acctbal")


@query("truncate", "SELECT * FROM region WHERE FALSE")
def truncate(t: Tables):
    return dml.truncate(t.region)


@query("merge_three_way", """SELECT k, bal FROM (SELECT coalesce(s_suppkey, c_custkey) AS k, CASE WHEN s_suppkey IS NULL THEN c_acctbal WHEN c_custkey IS NULL THEN 0.0 ELSE c_acctbal END AS bal,
    s_suppkey IS NOT NULL AND c_custkey IS NOT NULL AND c_acctbal < 0 AS gone FROM supplier FULL JOIN customer ON s_suppkey = c_custkey) WHERE NOT gone""")
def merge_three_way(t: Tables):
    target = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    source = t.customer.select(F.col("c_custkey").alias("ck"), F.col("c_acctbal").alias("cb"))
    arms = [
        dml.When("matched", "delete", condition=F.col("source.cb") < 0),
        dml.When("matched", "update", {"bal": F.col("source.cb")}),
        dml.When("not_matched", "insert", {"k": F.col("source.ck"), "bal": F.col("source.cb")}),
        dml.When("not_matched_by_source", "update", {"bal": F.lit(0.0)}),
    ]
    return dml.merge(target, source, "k", "ck", arms)


@query("returning", "SELECT c_custkey, greatest(c_acctbal, 0) AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def returning(t: Tables):
    return dml.update_returning(t.customer, F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.greatest("c_acctbal", F.lit(0.0))}).select("c_custkey", "c_acctbal")


@query("returning_deleted", "SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def returning_deleted(t: Tables):
    return dml.delete_returning(t.customer, F.col("c_acctbal") < 0).select("c_custkey")


@query("bitemporal_as_of", """SELECT o_custkey AS id, o_orderkey AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_orderkey <= 9000)
    WHERE r = 1 AND o_orderstatus <> 'P'""")
def bitemporal_as_of(t: Tables):
    versions = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("n"), F.col("o_orderkey").alias("_sys_from"), F.lit(None).cast("long").alias("_valid_from"), F.lit(None).cast("long").alias("_valid_until"), (F.col("o_orderstatus") == "P").alias("_deleted"))
    return temporal.as_of(versions, ["id"], 9000)


CELLS = "SELECT l_orderkey AS x, l_linenumber AS y, l_quantity AS q FROM lineitem"


def _cells(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), F.col("l_quantity").alias("q"))


@query("array_slice", f"SELECT x, y, q FROM ({CELLS}) WHERE x BETWEEN 10 AND 500 AND y BETWEEN 1 AND 2")
def array_slice(t: Tables):
    return nd.array_slice(_cells(t), {"x": (10, 500), "y": (1, 2)})


@query("array_project", f"SELECT x, y, q FROM ({CELLS})")
def array_project(t: Tables):
    return nd.array_project(_cells(t), ["x", "y"], ["q"])


@query("array_agg_by_dim", f"SELECT y, round(avg(q), 9) AS value FROM ({CELLS}) GROUP BY y")
def array_agg_by_dim(t: Tables):
    return nd.array_agg(_cells(t), "q", "mean", "y").select("y", F.round("value", 9).alias("value"))


@query("array_elementwise", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.v <> 0 THEN a.v / b.v END AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) a FULL JOIN (SELECT s_suppkey AS k, floor(s_acctbal / 5000) AS v FROM supplier) b ON a.k = b.k")
def array_elementwise(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.floor(F.col("s_acctbal") / 5000).cast("double").alias("v"))
    return nd.array_elementwise(a, b, ["k"], "v", "/")


@query("array_rechunk", f"SELECT x, y, q, CAST(floor(x / 64.0) AS BIGINT) AS tile_x, CAST(floor(y / 4.0) AS BIGINT) AS tile_y FROM ({CELLS})")
def array_rechunk(t: Tables):
    return nd.tile_id(_cells(t), ["x", "y"], [64, 4])


@query("array_versions", "SELECT x, q FROM (SELECT o_custkey AS x, o_totalprice AS q, o_orderstatus <> 'P' AS live, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND live")
def array_versions(t: Tables):
    versions = t.orders.select(F.col("o_custkey").alias("x"), F.col("o_totalprice").alias("q"), F.col("o_orderkey").alias("_sys_from"), (F.col("o_orderstatus") != "P").alias("_live"))
    return nd.live_cells(versions, nd.ArraySchema(("x",), ("q",)))


@query("kv_leaderboard", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer ORDER BY rank LIMIT 25")
def kv_leaderboard(t: Tables):
    return keyvalue.top(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 25)


@query("kv_rank_of", "SELECT count(*) + 1 AS rank FROM customer a, (SELECT * FROM customer WHERE c_custkey = 42) b WHERE a.c_acctbal > b.c_acctbal OR (a.c_acctbal = b.c_acctbal AND a.c_custkey < b.c_custkey)")
def kv_rank_of(t: Tables):
    return keyvalue.rank_of(t.customer, "c_custkey", "c_acctbal", 42)


@query("kv_ttl", "SELECT event_id FROM events WHERE event_id % 3 = 0 OR event_id * 10 + 500 > 30000")
def kv_ttl(t: Tables):
    kv = keyvalue.with_ttl(t.events, F.col("event_id") * 10, 500).withColumn("expire_at", F.when(F.col("event_id") % 3 != 0, F.col("expire_at")))
    return keyvalue.live(kv, 30000).select("event_id")


@query("kv_weekly_windows", "SELECT epoch(date_trunc('week', ts))::BIGINT AS week, user_id, round(sum(value), 3) AS score FROM events GROUP BY 1, 2")
def kv_weekly_windows(t: Tables):
    week = F.unix_seconds(keyvalue.window_start("weekly", F.col("ts").cast("timestamp")))
    return t.events.groupBy(week.alias("week"), "user_id").agg(F.round(F.sum("value"), 3).alias("score"))


@query("row_security_redaction", "SELECT c_custkey, sha256(c_name) AS c_name, '***' AS c_mktsegment FROM customer WHERE c_nationkey = 3")
def row_security_redaction(t: Tables):
    return security.redact(security.restrict(t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), [F.col("c_nationkey") == 3]), {"c_name": "hash", "c_mktsegment": "***"}).drop("c_nationkey")


@query("string_functions", """SELECT doc_id, strlen(text)::INT AS bytes, upper(lang) AS lang, reverse(source) AS source, substr(text, 1, 5) AS head, replace(source, 'src', 'S') AS s,
    coalesce(lang, '') || coalesce(source, '') AS both_ FROM documents""")
def string_functions(t: Tables):
    c = F.col
    return t.documents.select("doc_id", strings.length(c("text")).alias("bytes"), F.upper("lang").alias("lang"), F.reverse("source").alias("source"), strings.substring(c("text"), -3, 5).alias("head"), F.replace(c("source"), F.lit("src"), F.lit("S")).alias("s"), strings.concat(c("lang"), c("source")).alias("both_"))


@query("chunk_text", """SELECT doc_id, i AS no, substr(text, i * 80 + 1, 100) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil((length(text) - 20) / 80.0)) END AS INT))) AS i FROM documents)""")
def chunk_text(t: Tables):
    return t.documents.select("doc_id", F.explode(strings.chunk_text(F.col("text"), 100, 20)).alias("c")).select("doc_id", F.col("c.no").cast("long").alias("no"), "c.chunk")


@query("math_functions", "SELECT p_partkey, round_even(p_retailprice, 0) AS r, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(ln(p_retailprice), 9) AS l, p_size % 7 AS m, round(sqrt(p_size), 9) AS s FROM part")
def math_functions(t: Tables):
    p = F.col("p_retailprice")
    return t.part.select("p_partkey", maths.round_to(p, 0).alias("r"), F.ceil(p).cast("double").alias("c"), F.floor(p).cast("double").alias("f"), F.round(maths.ln(p), 9).alias("l"), maths.mod(F.col("p_size"), F.lit(7)).alias("m"), F.round(maths.sqrt(F.col("p_size")), 9).alias("s"))


@query("array_functions", """SELECT vec_id, len(embedding)::INT AS n, list_contains([label, 3], 3) AS has3, list_position([5, label], label)::BIGINT AS pos, [label, 1, 2] AS pre FROM embeddings""")
def array_functions(t: Tables):
    l = F.col("label")
    return t.embeddings.select("vec_id", arrays.array_length(F.col("embedding")).alias("n"), arrays.array_contains(F.array(l, F.lit(3)), F.lit(3)).alias("has3"), arrays.array_position(F.array(F.lit(5), l), l).alias("pos"), arrays.array_prepend(l, F.array(F.lit(1), F.lit(2))).alias("pre"))


@query("json_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has_k FROM events")
def json_paths(t: Tables):
    p = F.col("props")
    return t.events.select("event_id", json_functions.json_extract(p, "k").alias("k"), json_functions.json_exists(p, "k").alias("has_k"))


@query("json_edits", """SELECT event_id, CAST(json_merge_patch(props, '{"seen":true}') AS VARCHAR) AS "set", CAST(json_merge_patch(props, '{"k":null}') AS VARCHAR) AS removed,
    lower(json_type(props)) AS type, len(json_keys(props))::INT AS n FROM events""")
def json_edits(t: Tables):
    p = F.col("props")
    return t.events.select("event_id", json_functions.json_set(p, "seen", F.lit("true")).alias("set"), json_functions.json_remove(p, "k").alias("removed"), json_functions.json_type(p).alias("type"), json_functions.json_length(p).alias("n"))


@query("conversation_windows", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations")
def conversation_windows(t: Tables):
    w = Window.partitionBy("conv_id")
    return t.conversations.select("conv_id", "turn", F.lag("role").over(w.orderBy("turn")).alias("before"), F.count("*").over(w).alias("turns"))

"""Queries of the named query functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from polymera.operators import lookups
from polymera.plans.base import Tables, query


@query("temporal_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderkey <= (SELECT max(o_orderkey) * 0.9 FROM orders) ORDER BY o_orderkey DESC LIMIT 1")
def temporal_lookup(t: Tables):
    last = t.orders.agg(F.max("o_orderkey")).first()[0] * 0.9
    return lookups.temporal_lookup(t.orders, "o_custkey", "o_orderkey", 7, last).select("o_orderkey", "o_totalprice")


@query("convert_currency", """SELECT o.o_orderkey, round(o.o_totalprice * (SELECT s.s_acctbal FROM supplier s WHERE s.s_nationkey = o.o_custkey % 25 AND s.s_suppkey <= o.o_orderkey ORDER BY s.s_suppkey DESC LIMIT 1), 0) AS converted FROM orders o""")
def convert_currency(t: Tables):
    amounts = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 25).cast("int").alias("cur"))
    out = lookups.convert_currency(amounts, t.supplier, "o_totalprice", "cur", "o_orderkey", "s_nationkey", "s_acctbal", "s_suppkey", 0)
    return out.select("o_orderkey", "converted")


@query("balance_as_of", "SELECT c_custkey, round(c_acctbal - coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderkey > 100), 0), 2) AS c_acctbal FROM customer")
def balance_as_of(t: Tables):
    out = lookups.balance_as_of(t.customer, t.orders, "c_custkey", "o_custkey", "c_acctbal", "o_totalprice", "o_orderkey", 100)
    return out.select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("verify_balance", "SELECT o_custkey AS k, round(sum(CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END), 2) AS stored, round(sum(o_totalprice), 2) AS computed FROM orders GROUP BY 1 HAVING bool_or(o_orderkey % 10 = 0)")
def verify_balance(t: Tables):
    stored = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))).alias("b"))
    out = lookups.verify_balance(stored, t.orders, "k", "o_custkey", "b", "o_totalprice", 0.005)
    return out.select("k", F.round("stored", 2).alias("stored"), F.round("computed", 2).alias("computed"))


@query("verify_hash_chain", """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS s, r_name AS p FROM region), c AS (SELECT s, sha256('' || p) AS h FROM o WHERE s = 1 UNION ALL SELECT o.s, sha256(c.h || o.p) FROM c JOIN o ON o.s = c.s + 1)
    SELECT TRUE AS valid, count(*) AS entries, max_by(h, s) AS last_hash FROM c""")
def verify_hash_chain(t: Tables):
    rows = t.region.select((F.col("r_regionkey") + 1).cast("long").alias("s"), F.col("r_name").alias("p"))
    return lookups.verify_hash_chain(lookups.hash_chain(rows, "s", "p"), "s", "p").select("valid", "entries", "last_hash")


#: A tree by halving keys, as SQL.
_TREE = "(SELECT c_custkey // 2 AS src, c_custkey AS dst FROM customer WHERE c_custkey > 1)"


def _tree(t: Tables):
    return t.customer.where("c_custkey > 1").select(F.floor(F.col("c_custkey") / 2).cast("long").alias("src"), F.col("c_custkey").alias("dst"))


@query("tree_children", f"WITH RECURSIVE d AS (SELECT dst AS id, 1 AS depth FROM {_TREE} WHERE src = 3 UNION ALL SELECT e.dst, d.depth + 1 FROM d JOIN {_TREE} e ON e.src = d.id) SELECT id, depth FROM d")
def tree_children(t: Tables):
    return lookups.tree_children(_tree(t), 3)


@query("tree_sum", f"WITH RECURSIVE d AS (SELECT 3::BIGINT AS id UNION ALL SELECT e.dst FROM d JOIN {_TREE} e ON e.src = d.id) SELECT round(sum(c_acctbal), 2) AS total FROM customer JOIN d ON c_custkey = id")
def tree_sum(t: Tables):
    return lookups.tree_sum(_tree(t), t.customer, 3, "c_acctbal", "c_custkey").select(F.round("total", 2).alias("total"))


@query("estimate_count")
def estimate_count(t: Tables):
    return lookups.estimate_count(t.lineitem, "l_partkey")


@query("show_changes", "SELECT event_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def show_changes(t: Tables):
    return lookups.show_changes(t.events, "event_id", 100, 50).select("event_id")


@query("version_diff", """SELECT s_suppkey, 'changed' AS change, 's_name' AS "column", s_name AS old, 'new ' || s_name AS new FROM supplier WHERE s_suppkey % 4 = 1 AND s_suppkey % 5 <> 0
    UNION ALL SELECT s_suppkey, 'removed', NULL, NULL, NULL FROM supplier WHERE s_suppkey % 5 = 0""")
def version_diff(t: Tables):
    before = t.supplier.select("s_suppkey", "s_name")
    after = before.where("s_suppkey % 5 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("new "), F.col("s_name"))).otherwise(F.col("s_name")))
    return lookups.diff(before, after, ["s_suppkey"])


@query("graph_rag_fusion")
def graph_rag_fusion(t: Tables):
    seeds = t.embeddings.select(F.col("vec_id").alias("id"), F.abs(F.col("vec_id") - 40).cast("double").alias("distance"))
    edges = t.embeddings.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 3 + 1) % 50).alias("dst"))
    return lookups.graph_rag(seeds, edges, 10)

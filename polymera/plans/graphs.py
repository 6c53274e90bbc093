"""Queries of graph operators over a graph of nations, suppliers' parts and numbered nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from polymera.operators import graph, match
from polymera.plans.base import Tables, query

#: A small directed graph with a hub, cycles and chains, as SQL both engines read.
_E = "(SELECT DISTINCT s_suppkey AS src, (s_suppkey * 7 + s_nationkey) % 60 AS dst FROM supplier UNION SELECT s_suppkey, s_nationkey FROM supplier)"


def _edges(t: Tables):
    a = t.supplier.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % 60).alias("dst"))
    return a.unionAll(t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long"))).distinct()


_U = f"(SELECT src, dst FROM {_E} WHERE src <> dst UNION SELECT dst, src FROM {_E} WHERE src <> dst)"
_N = f"(SELECT src AS id FROM {_E} UNION SELECT dst FROM {_E})"


@query("graph_pagerank", f"""WITH RECURSIVE e AS MATERIALIZED {_E}, n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), c AS (SELECT count(*)::DOUBLE AS n FROM n),
    d AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY src),
    r AS (SELECT 0 AS i, id, 1 / c.n AS rank FROM n, c UNION ALL
      SELECT i + 1, x.id, 0.15 / c.n + 0.85 * (x.given + x.loose / c.n) FROM (
        SELECT p.i, n.id, coalesce((SELECT sum(q.rank / d.d) FROM r q JOIN e ON e.src = q.id JOIN d ON d.src = q.id WHERE e.dst = n.id), 0) AS given,
          coalesce((SELECT sum(q.rank) FROM r q WHERE q.id NOT IN (SELECT src FROM d)), 0) AS loose FROM n, (SELECT max(i) AS i FROM r) p) x, c WHERE x.i < 60)
    SELECT id AS node_id, round(rank, 7) AS rank FROM r WHERE i = 60""")
def graph_pagerank(t: Tables):
    return graph.pagerank(_edges(t), tolerance=1e-8).select("node_id", F.round("rank", 7).alias("rank"))


@query("graph_wcc", f"WITH RECURSIVE u AS {_U}, r AS (SELECT src AS id, src AS m FROM u UNION SELECT dst, dst FROM u UNION SELECT r.id, u.dst FROM r JOIN u ON u.src = r.m) SELECT id AS node_id, min(m) AS component_id FROM r GROUP BY id")
def graph_wcc(t: Tables):
    return graph.wcc(_edges(t))


@query("graph_degree", f"SELECT n.id AS node_id, round((SELECT count(*) FROM {_E} e WHERE e.src = n.id) / ((SELECT count(*) FROM {_N}) - 1.0), 9) AS centrality FROM {_N} n")
def graph_degree(t: Tables):
    return graph.degree(_edges(t), "out").select("node_id", F.round("centrality", 9).alias("centrality"))


@query("graph_triangles", f"WITH u AS {_U} SELECT n.id AS node_id, coalesce(c, 0) AS triangles FROM {_N} n LEFT JOIN (SELECT a.src AS id, count(*) // 2 AS c FROM u a JOIN u b ON a.src = b.src AND a.dst <> b.dst JOIN u x ON x.src = a.dst AND x.dst = b.dst GROUP BY 1) z ON z.id = n.id")
def graph_triangles(t: Tables):
    return graph.triangles(_edges(t))


@query("graph_lcc", f"WITH u AS {_U}, d AS (SELECT src AS id, count(*) AS d FROM u GROUP BY 1), z AS (SELECT a.src AS id, count(*) AS c FROM u a JOIN u b ON a.src = b.src AND a.dst <> b.dst JOIN u x ON x.src = a.dst AND x.dst = b.dst GROUP BY 1) SELECT n.id AS node_id, round(CASE WHEN d.d >= 2 THEN coalesce(c, 0) / (d.d * (d.d - 1.0)) ELSE 0 END, 9) AS coefficient FROM {_N} n LEFT JOIN d ON d.id = n.id LEFT JOIN z ON z.id = n.id")
def graph_lcc(t: Tables):
    return graph.lcc(_edges(t)).select("node_id", F.round("coefficient", 9).alias("coefficient"))


_BFS = f"WITH RECURSIVE e AS {_E}, b AS (SELECT 5::BIGINT AS id, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.id WHERE b.depth < 30)"


@query("graph_bfs", f"{_BFS} SELECT id, min(depth)::INT AS depth FROM b GROUP BY id")
def graph_bfs(t: Tables):
    e = _edges(t)
    return graph.bfs(e, graph.vertices(e).where("id = 5"), 30)


@query("graph_sssp", f"WITH RECURSIVE e AS (SELECT src, dst, 1.0 + (src * 3 + dst) % 5 AS w FROM {_E}), b AS (SELECT 5::BIGINT AS id, 0.0::DOUBLE AS d, 0 AS h UNION SELECT e.dst, b.d + e.w, b.h + 1 FROM b JOIN e ON e.src = b.id WHERE b.h < 14) SELECT id AS node_id, min(d) AS distance FROM b GROUP BY id")
def graph_sssp(t: Tables):
    return graph.sssp(_edges(t).withColumn("weight", 1.0 + (F.col("src") * 3 + F.col("dst")) % 5), 5)


@query("graph_neighbors", f"SELECT DISTINCT CASE WHEN src = 5 THEN dst ELSE src END AS id FROM {_E} WHERE src = 5 OR dst = 5")
def graph_neighbors(t: Tables):
    return graph.neighbors(_edges(t), 5, "both")


@query("graph_harmonic", f"WITH RECURSIVE e AS {_E}, n AS {_N}, b AS (SELECT id AS s, id, 0 AS depth FROM n UNION SELECT b.s, e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.id WHERE b.depth < 12), m AS (SELECT s, id, min(depth) AS d FROM b GROUP BY s, id) SELECT s AS node_id, round(sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0 END) / ((SELECT count(*) FROM n) - 1), 7) AS centrality FROM m GROUP BY s")
def graph_harmonic(t: Tables):
    return graph.harmonic(_edges(t)).select("node_id", F.round("centrality", 7).alias("centrality"))


@query("graph_closeness", f"WITH RECURSIVE e AS {_E}, n AS {_N}, b AS (SELECT id AS s, id, 0 AS depth FROM n UNION SELECT b.s, e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.id WHERE b.depth < 12), m AS (SELECT s, id, min(depth) AS d FROM b GROUP BY s, id), g AS (SELECT s, count(*) - 1 AS r, sum(d) AS t FROM m GROUP BY s) SELECT s AS node_id, round(CASE WHEN t > 0 THEN r / ((SELECT count(*) FROM n) - 1.0) * r / t ELSE 0 END, 7) AS centrality FROM g")
def graph_closeness(t: Tables):
    return graph.closeness(_edges(t)).select("node_id", F.round("centrality", 7).alias("centrality"))


@query("graph_diameter", f"WITH RECURSIVE u AS {_U}, b AS (SELECT DISTINCT src AS s, src AS id, 0 AS depth FROM u UNION SELECT b.s, u.dst, b.depth + 1 FROM b JOIN u ON u.src = b.id WHERE b.depth < 12), m AS (SELECT s, id, min(depth) AS d FROM b GROUP BY s, id), x AS (SELECT s, max(d) AS ecc FROM m GROUP BY s) SELECT max(ecc)::INT AS diameter, min(ecc)::INT AS radius FROM x")
def graph_diameter(t: Tables):
    return graph.diameter(_edges(t))


@query("graph_betweenness", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_E} WHERE src <> dst), n AS MATERIALIZED {_N}, b AS (SELECT id AS s, id, 0 AS depth FROM n UNION SELECT b.s, e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.id WHERE b.depth < 16),
    d AS MATERIALIZED (SELECT s, id, min(depth) AS d FROM b GROUP BY s, id),
    p AS (SELECT id AS s, id, 0 AS d, 1.0::DOUBLE AS paths FROM n UNION ALL
      SELECT s, id, d, sum(paths) AS paths FROM (SELECT p.s, e.dst AS id, p.d + 1 AS d, p.paths FROM p JOIN e ON e.src = p.id JOIN d ON d.s = p.s AND d.id = e.dst AND d.d = p.d + 1) GROUP BY s, id, d),
    q AS MATERIALIZED (SELECT s, id, d, sum(paths) AS paths FROM p GROUP BY s, id, d),
    x AS (SELECT v.id, sum(a.paths * z.paths / t.paths) AS c FROM q v JOIN q a ON a.s = v.s AND a.id = v.id JOIN q z ON z.s = v.id JOIN q t ON t.s = a.s AND t.id = z.id AND t.d = a.d + z.d WHERE a.s <> v.id AND z.id <> v.id AND a.s <> z.id GROUP BY v.id),
    c AS (SELECT count(*)::DOUBLE AS n FROM n)
    SELECT n.id AS node_id, round(coalesce(x.c, 0) / ((c.n - 1) * (c.n - 2)), 9) AS centrality FROM n CROSS JOIN c LEFT JOIN x ON x.id = n.id""")
def graph_betweenness(t: Tables):
    return graph.betweenness(_edges(t), sample_size=None).select("node_id", F.round("centrality", 9).alias("centrality"))


#: A node's coreness is the least fixed point of: the greatest k such that k neighbours have at least k.
_CORE_STEP = "SELECT i + 1, r.id, (SELECT coalesce(max(least(p.k, p.rn)), 0) FROM (SELECT q.k, row_number() OVER (ORDER BY q.k DESC) AS rn FROM u JOIN l q ON q.id = u.dst WHERE u.src = r.id) p) FROM l r WHERE r.i < 40"


@query("graph_k_core", f"""WITH RECURSIVE u AS MATERIALIZED {_U}, n AS MATERIALIZED {_N}, l AS (SELECT 0 AS i, n.id, (SELECT count(*) FROM u WHERE u.src = n.id) AS k FROM n UNION ALL {_CORE_STEP}) SELECT id AS node_id, k::INT AS coreness FROM l WHERE i = 40""")
def graph_k_core(t: Tables):
    return graph.k_core(_edges(t))


@query("graph_label_propagation")
def graph_label_propagation(t: Tables):
    return graph.label_propagation(_edges(t))


@query("graph_louvain")
def graph_louvain(t: Tables):
    return graph.louvain(_edges(t))


@query("graph_match", "SELECT c.c_custkey AS c, o.o_orderkey AS o, l.l_partkey + 10000000 AS p FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l ON l.l_orderkey = o.o_orderkey")
def graph_match(t: Tables):
    big = 10_000_000
    places = t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("placed").alias("label"))
    holds = t.lineitem.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + big).alias("dst"), F.lit("holds").alias("label")).distinct()
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.lit("Customer").alias("label"))
    return match.match(nodes, places.unionByName(holds), "(c:Customer)-[:placed]->(o)-[:holds]->(p)").select("c", "o", "p")


@query("graph_match_range", f"WITH e AS {_E} SELECT a.src AS a, b.dst AS b FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 5 UNION SELECT src, dst FROM e WHERE src = 5")
def graph_match_range(t: Tables):
    e = _edges(t).withColumn("label", F.lit("x"))
    nodes = graph.vertices(e).withColumn("label", F.when(F.col("id") == 5, "Start").otherwise("Other"))
    return match.match(nodes, e, "(a:Start)-[:x*1..2]->(b)").select("a", "b")


@query("graph_stats", "SELECT o_orderpriority AS label, count(*) AS edges, count(DISTINCT o_custkey) AS sources, count(DISTINCT o_orderkey) AS targets, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders x WHERE x.o_orderpriority = o.o_orderpriority GROUP BY o_custkey)) AS max_out_degree FROM orders o GROUP BY 1")
def graph_stats(t: Tables):
    return graph.statistics(t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderpriority").alias("label")))

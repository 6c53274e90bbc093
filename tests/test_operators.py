"""Small cases with known answers."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from polymera.functions import arrays, datetimes, geo, ids, json_functions, maths, strings
from polymera.operators import dml, graph, joins, match, promql, search, temporal, timeseries as ts, windows
from polymera.operators import arrays as nd
from polymera.operators.components import connected_components


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_series_kernels(spark):
    w = Window.orderBy("t")
    df = spark.createDataFrame([(float(i), v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 5.0])], "t double, v double")
    assert [r[0] for r in df.select(ts.moving_avg(F.col("v"), 3, w)).collect()] == [None, None, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(float(i), v) for i, v in enumerate([1.0, 3.0, 5.0, 7.0, 9.0])], "t double, v double")
    assert [r[0] for r in df.select(ts.moving_percentile(F.col("v"), 3, 0.5, w)).collect()] == [None, None, 3.0, 5.0, 7.0]
    df = spark.createDataFrame([(0.0, 100.0), (1.0, 50.0), (2.0, 20.0)], "t double, v double")
    assert [r[0] for r in df.select(ts.derivative(F.col("v"), F.col("t"), w)).collect()] == [None, -50.0, -30.0]
    assert [r[0] for r in df.select(ts.rate(F.col("v"), F.col("t"), w)).collect()] == [None, 50.0, 20.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([10.0, 20.0, 30.0])], "k string, t int, v double")
    assert [r["ema"] for r in ts.ema(df, ["k"], "t", "v", 0.5).orderBy("t").collect()] == [10.0, 15.0, 22.5]


def test_interpolation_and_gaps(spark):
    df = spark.createDataFrame([(0.0, None), (1.0, 10.0), (2.0, None), (3.0, 30.0), (4.0, None)], "t double, v double")
    w = Window.orderBy("t")
    assert [r[0] for r in df.select(ts.interpolate(F.col("v"), F.col("t"), w)).collect()] == [10.0, 10.0, 20.0, 30.0, 30.0]
    assert [r[0] for r in df.select(ts.interpolate(F.col("v"), F.col("t"), w, "zero")).collect()] == [0.0, 10.0, 0.0, 30.0, 0.0]
    buckets = spark.createDataFrame([(10, 1.0), (30, 3.0)], "bucket long, v double")
    assert values(ts.gap_fill(buckets, 0, 50, 10, ["v"], "linear"), "bucket", "v")[1:4] == [(10, 1.0), (20, 2.0), (30, 3.0)]
    assert values(ts.gap_fill(buckets, 0, 50, 10, ["v"], 7.0), "bucket", "v") == [(0, 7.0), (10, 1.0), (20, 7.0), (30, 3.0), (40, 7.0)]
    assert ts.gap_fill(buckets, 50, 50, 10, ["v"]).count() == 0


def test_durations():
    assert [datetimes.interval_ms(x) for x in ("5m", "1h", "1h30m", "1d", "1w", "15 minutes", "INTERVAL '1 day'")] == [300000, 3600000, 5400000, 86400000, 604800000, 900000, 86400000]
    with pytest.raises(ValueError):
        datetimes.interval_ms("soon")


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("a", 35), ("b", 5), (None, 10)], "k string, t long")
    right = spark.createDataFrame([("a", 9, "x"), ("a", 20, "y"), ("a", 21, "z"), ("b", 6, "w")], "k string, t long, v string")
    assert values(joins.asof_join(left.where("k IS NOT NULL"), right, "t", "t", ["k"]), "k", "t", "right_v") == [("a", 10, "x"), ("a", 20, "y"), ("a", 35, "z"), ("b", 5, None)]
    found = {(r["k"], r["t"]): r["right_v"] for r in joins.asof_join(left, right, "t", "t", ["k"], tolerance=5).collect()}
    assert found == {("a", 10): "x", ("a", 20): "y", ("a", 35): None, ("b", 5): None, (None, 10): None}
    assert values(joins.asof_join(left.where("k = 'a'"), right, "t", "t", ["k"], tolerance=0).where("right_v IS NOT NULL"), "t") == [(20,)]
    spread = joins.asof_join_bucketed(left.where("k IS NOT NULL"), right, "t", "t", 5, ["k"])
    assert {(r["k"], r["t"]): r["right_v"] for r in spread.collect()} == {("a", 10): "x", ("a", 20): "y", ("a", 35): None, ("b", 5): None}


def test_interval_join(spark):
    points = spark.createDataFrame([(1,), (7,), (20,)], "p long")
    spans = spark.createDataFrame([(0, 5, "a"), (6, 20, "b"), (9, 3, "bad")], "lo long, hi long, n string")
    assert values(joins.interval_join(points, spans, "p", "lo", "hi", 4), "p", "n") == [(1, "a"), (7, "b"), (20, "b")]


def test_merge(spark):
    target = spark.createDataFrame([("a", "alpha", 10), ("b", "beta", 20)], "id string, name string, score int")
    source = spark.createDataFrame([("a", "ALPHA_UPD", 99), ("c", "gamma", 30)], "id string, name string, score int")
    arms = [dml.When("matched", "update", {"name": F.col("source.name"), "score": F.col("source.score")}), dml.When("not_matched", "insert", {c: F.col(f"source.{c}") for c in target.columns})]
    assert values(dml.merge(target, source, "id", "id", arms), "id", "name", "score") == [("a", "ALPHA_UPD", 99), ("b", "beta", 20), ("c", "gamma", 30)]
    with pytest.raises(Exception, match="21000"):
        dml.merge(target, source.unionAll(source), "id", "id", arms).collect()


def test_as_of(spark):
    versions = spark.createDataFrame([("a", 1, 10, None, None, False), ("a", 2, 20, None, None, False), ("b", 5, 10, None, None, False), ("b", 5, 30, None, None, True)], "id string, n int, _sys_from long, _valid_from long, _valid_until long, _deleted boolean")
    assert values(temporal.as_of(versions, ["id"], 15), "id", "n") == [("a", 1), ("b", 5)]
    assert values(temporal.as_of(versions, ["id"]), "id", "n") == [("a", 2)]


def test_windows(spark):
    df = spark.range(10)
    sizes = df.select(windows.ntile(4, [], ["id"]).alias("b")).groupBy("b").count()
    assert [r["count"] for r in sizes.orderBy("b").collect()] == [3, 2, 3, 2]
    with pytest.raises(ValueError, match="2201W"):
        windows.limit_rows(df, -1)
    with pytest.raises(ValueError):
        windows.check_frame("groups", 0, None, None)


def test_functions(spark):
    s = F.lit("héllo")
    assert one(spark, strings.length(s), strings.substring(s, -2, 2), strings.concat(s, F.lit(None)), strings.trim(F.lit("\t x　"))) == (6, "hé", "héllo", "x")
    assert one(spark, maths.round_to(F.lit(2.5)), maths.round_to(F.lit(2.5), 0, "HALF_UP"), maths.round_to(F.lit(-2.1), 0, "CEILING"), maths.sqrt(F.lit(-1.0))) == (2.0, 3.0, -3.0, None)
    a = F.array(F.lit(1), F.lit(None), F.lit(1))
    assert one(spark, arrays.array_position(a, F.lit(9)), arrays.array_contains(F.lit(None).cast("array<int>"), F.lit(1)), arrays.array_remove(a, F.lit(None))) == (None, False, [1, 1])
    j = F.lit('{"a":{"b":[1,2]},"k":"v"}')
    assert one(spark, json_functions.json_extract(j, "a.b[1]"), json_functions.json_type(j), json_functions.json_length(j), json_functions.has_key(j, "k"), json_functions.json_value(j, "$.a")) == ("2", "object", 2, True, None)
    assert one(spark, json_functions.contains(j, F.lit('{"a":{"b":[2]}}')), json_functions.json_remove(j, "a"), json_functions.json_set(F.lit("{}"), "n", F.lit("1"))) == (True, '{"k":"v"}', '{"n":1}')
    assert one(spark, ids.id_type(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV")), ids.ulid_timestamp(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) == ("ulid", 1469922850259)
    made = spark.range(3).select(ids.uuid_v7().alias("a"), ids.ulid().alias("b"), ids.cuid2().alias("c"), ids.nanoid().alias("d")).where(ids.is_uuid(F.col("a")) & ids.is_ulid(F.col("b")) & ids.is_cuid2(F.col("c")) & ids.is_nanoid(F.col("d")))
    assert made.count() == 3


def test_geo(spark):
    d = geo.haversine(F.lit(-73.9857), F.lit(40.758), F.lit(2.3522), F.lit(48.8566))
    assert abs(one(spark, d)[0] / 1000 - 5833) < 15
    assert one(spark, geo.geohash(F.lit(-5.6), F.lit(42.6), 5)) == ("ezs42",)
    x, y = geo.geohash_decode("ezs42")
    assert abs(x + 5.6) < 0.03 and abs(y - 42.6) < 0.03
    square = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"
    assert one(spark, geo.st_contains(F.lit(square), F.lit("POINT(1 1)")), geo.st_intersects(F.lit(square), F.lit("LINESTRING(-1 2, 5 2)")), geo.st_isvalid(F.lit("POLYGON((0 0, 2 2, 2 0, 0 2, 0 0))"))) == (True, True, False)


def test_search(spark):
    docs = spark.createDataFrame([(1, "rust python"), (2, "rust ruby"), (3, "python ruby"), (4, None)], "doc_id long, text string")
    assert values(search.bm25(docs, "rust NOT python"), "id") == [(2,)]
    with pytest.raises(ValueError):
        search.bm25(docs, "NOT rust")
    sparse = spark.createDataFrame([("a", {3: 1.0, 7: 1.0}), ("b", {3: 1.0}), ("c", {7: 1.0}), ("d", {1: 1.0})], "id string, terms map<int,float>")
    assert values(search.sparse_scores(sparse, {3: 1.0, 7: 0.5}), "id", "score") == [("a", 1.5), ("b", 1.0), ("c", 0.5)]
    fused = search.rrf([spark.createDataFrame([("x", 0), ("y", 1)], "id string, rank int"), spark.createDataFrame([("y", 0), ("x", 1)], "id string, rank int")])
    assert [r["id"] for r in fused.orderBy("rank").collect()] == ["x", "y"]


def test_arrays(spark):
    cells = spark.createDataFrame([(x, y, 3.0 * x + y) for x in range(3) for y in range(3)], "x long, y long, temp double")
    assert nd.array_slice(cells, {"x": (0, 1), "y": (0, 1)}).count() == 4
    schema = nd.ArraySchema(("x", "y"), ("temp",), ((0, 9), (0, 9)), (5, 5))
    stored = nd.insert_cells(cells.limit(0).withColumns({"_sys_from": F.lit(0).cast("long"), "_live": F.lit(True)}), cells, schema, 1)
    gone = nd.delete_cells(stored, cells.where("x = 0").select("x", "y"), schema, 2)
    assert nd.live_cells(gone, schema).count() == 6 and nd.live_cells(gone, schema, 1).count() == 9


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    assert values(connected_components(edges), "id", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)]
    assert values(graph.k_core(edges), "node_id", "coreness") == [(1, 2), (2, 2), (3, 2), (4, 1), (5, 1), (6, 1)]
    assert graph.shortest_path(edges, 1, 4) == [1, 2, 3, 4] and graph.shortest_path(edges, 1, 6) == []
    weighted = spark.createDataFrame([("n1", "n2", 1.0), ("n2", "n3", 1.0)], "src string, dst string, weight double")
    assert values(graph.sssp(weighted, "n1"), "node_id", "distance") == [("n1", 0.0), ("n2", 1.0), ("n3", 2.0)]
    two = spark.createDataFrame([(a, b) for g in ((1, 2, 3, 4), (5, 6, 7, 8)) for a in g for b in g if a < b] + [(4, 5)], "src long, dst long")
    assert values(graph.louvain(two), "node_id", "community_id") == [(i, 1 if i < 5 else 5) for i in range(1, 9)]
    between = dict(values(graph.betweenness(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), None, normalized=False), "node_id", "centrality"))
    assert between == {1: 0.0, 2: 1.0, 3: 0.0}


def test_match(spark):
    nodes = spark.createDataFrame([("alice", "P"), ("bob", "P"), ("carol", "P")], "id string, label string")
    edges = spark.createDataFrame([("alice", "bob", "knows"), ("bob", "carol", "knows")], "src string, dst string, label string")
    assert values(match.match(nodes, edges, "(a:P)-[:knows]->(b)").where("a = 'alice'"), "b") == [("bob",)]
    assert values(match.match(nodes, edges, "(a)-[:knows*1..2]->(b)").where("a = 'alice'"), "b") == [("bob",), ("carol",)]
    both = match.match(nodes, edges, "(a)-[:knows]->(b)", optional="(b)-[e:knows]->(c)")
    assert {(r["a"], r["c"]) for r in both.collect()} == {("alice", "carol"), ("bob", None)}


def test_promql(spark):
    rows = [("up", {"job": j}, t * 1000, v) for j, k in (("a", 1.0), ("b", 2.0)) for t, v in ((0, 0.0), (60, 60 * k), (120, 120 * k))]
    samples = spark.createDataFrame(rows, "name string, labels map<string,string>, ts long, value double")
    assert [r["value"] for r in promql.evaluate("sum(rate(up[5m]))", samples, 120_000).collect()] == [3.0]
    assert values(promql.evaluate('up{job="a"} > 50', samples, 0, 120_000, 60_000), "ts", "value") == [(60_000, 60.0), (120_000, 120.0)]
    assert [r["value"] for r in promql.evaluate("topk(1, up)", samples, 120_000).collect()] == [240.0]
    with pytest.raises(ValueError):
        promql.parse("sum(")

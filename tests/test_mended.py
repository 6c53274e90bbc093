"""What must raise, what must not be lost, and functions by their SQL names."""

import pytest
from pyspark.sql import functions as F

from polymera import sql_functions, storage
from polymera.operators import aggregates, dml, graph, joins, lookups, search, spatial
from polymera.session import Engine
from polymera.streaming import changes


def test_paths_longer_than_the_limit_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    assert {r["node_id"]: r["distance"] for r in graph.sssp(chain, 0).collect()} == {i: float(i) for i in range(7)}
    with pytest.raises(RuntimeError):
        graph.sssp(chain, 0, max_iterations=3)
    with pytest.raises(RuntimeError):
        graph._distances(chain, graph.vertices(chain), max_depth=3)
    with pytest.raises(RuntimeError):
        graph.k_core(chain, max_rounds=1)


def test_label_propagation_settles_on_bipartite_parts(spark):
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(8)], "src long, dst long")
    for rounds in (9, 10):
        got = {r["node_id"]: r["community_id"] for r in graph.label_propagation(pairs, rounds).collect()}
        assert all(got[2 * i] == got[2 * i + 1] for i in range(8))


def test_accents_of_queries_and_texts(spark):
    docs = spark.createDataFrame([(1, "un café noir"), (2, "cafe"), (3, "thé")], "doc_id long, text string")
    for query in ("café", "cafe", "CAFÉ"):
        assert {r["id"] for r in search.bm25(docs, query).collect()} == {1, 2}
    assert search.parse_query("thé NOT café -x1") == (["the"], ["cafe", "x1"])


def test_returning_gives_what_was_touched(spark):
    t = spark.createDataFrame([(1, 5), (2, 7), (3, None)], "k long, v long")
    same = dml.update_returning(t, F.col("k") < 3, {"v": F.col("v")})
    assert sorted(map(tuple, same.collect())) == [(1, 5), (2, 7)]
    assert [tuple(r) for r in dml.delete_returning(t, F.col("v") > 5).collect()] == [(2, 7)]
    assert [tuple(r) for r in dml.insert_returning(t, spark.createDataFrame([(9,)], "k long")).collect()] == [(9, None)]
    new = spark.createDataFrame([(1, 1), (1, 2)], "k long, v long")
    assert [tuple(r) for r in dml.upsert_returning(t, new, ["k"], ["v"]).collect()] == [(1, 2)]


def test_pairs_across_longitude_180(spark):
    a = spark.createDataFrame([(1, 179.9, 0.0), (2, 10.0, 10.0)], "a long, ax double, ay double")
    b = spark.createDataFrame([(1, -179.9, 0.0), (2, 10.1, 10.0), (3, -180.0, 0.1)], "b long, bx double, by double")
    got = sorted((r["a"], r["b"]) for r in spatial.distance_join(a, b, 100_000, ("ax", "ay"), ("bx", "by")).collect())
    assert got == [(1, 1), (1, 3), (2, 2)]


def test_fused_lists_are_whole(spark):
    seeds = spark.createDataFrame([(0, 0.1)], "id long, distance double")
    edges = spark.createDataFrame([(0, i) for i in range(1, 1301)], "src long, dst long")
    got = lookups.graph_rag(seeds, edges, 5_000)
    assert got.count() == 1301
    assert lookups.graph_rag(seeds, edges, 5_000, list_size=1_000).count() == 1000


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("id")).repartition(7)
    assert [(r["id"], r["rank"]) for r in search.numbered(df, [F.col("id").desc()]).orderBy("rank").collect()] == [(999 - i, i) for i in range(1000)]


def test_a_change_table_that_lost_its_folder_raises(spark, tmp_path):
    run = changes.apply_to(str(tmp_path / "t"), ["k"], "seq")
    batch = spark.createDataFrame([(1, 1, "insert")], "k long, seq long, op string")
    run(batch, 0)
    run(spark.createDataFrame([(2, 2, "insert")], "k long, seq long, op string"), 1)
    assert spark.read.parquet(str(tmp_path / "t/1")).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        run(batch, 5)


def test_lateral_left_keeps_unmatched_and_repeated_rows(spark):
    outer = spark.createDataFrame([(1, None), (1, None), (2, 5), (3, 9)], "k long, v long")
    inner = spark.createDataFrame([(4,), (6,)], "x long")
    got = joins.lateral_loop(outer, inner, F.col("x") > F.col("v"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, None, None), (1, None, None), (2, 5, 6), (3, 9, None)]))
    plan = joins.lateral_loop(outer, inner, F.col("x") > F.col("v"), how="inner")._jdf.queryExecution().toString()
    assert "BuildLeft" in plan
    with pytest.raises(ValueError):
        joins.lateral_loop(outer, inner, F.lit(True), how="full")


def test_percentiles_of_ties_and_single_rows(spark):
    rows = [("a", float(v)) for v in [1, 1, 1, 2, 9]] + [("b", 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["p"]): r["value"] for r in aggregates.percentiles(df, ["g"], "v", [0.0, 0.5, 0.8, 1.0]).collect()}
    want = {(r["g"], p): r[str(p)] for p in (0.0, 0.5, 0.8, 1.0) for r in df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.lit(p)).alias(str(p))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_cluster_needs_a_shared_folder():
    storage.refuse_cluster("local[4]")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            storage.refuse_cluster(master)


def test_every_sql_name_is_defined(spark):
    engine = Engine(spark)
    known = {f.name.split(".")[-1] for f in spark.catalog.listFunctions()}
    assert set(sql_functions.names()) <= known
    one = lambda text: engine.sql(f"SELECT {text} AS v").first()["v"]
    assert one("time_bucket('5m', TIMESTAMP '2024-01-01 00:07:30')") == 1704067500000
    assert one("json_get('{\"a\":{\"b\":[1,2]}}', 'a.b[1]')") == "2" and one("json_value('{\"a\":[1]}', 'a')") is None
    assert one("json_query('{\"a\":[1]}', '$.a')") == "[1]" and one("json_type('[1]')") == "array"
    assert one("pg_json_contains('{\"a\":1,\"b\":2}', '{\"a\":1}')") is True and one("pg_json_contained_by('{\"a\":1}', '{\"a\":2}')") is False
    assert one("st_x(st_geomfromgeojson('{\"type\":\"Point\",\"coordinates\":[3.5,4]}'))") == 3.5
    assert one("st_makeline(array('POINT(0 0)', 'POINT(1 1)'))") == "LINESTRING(0 0, 1 1)"
    assert abs(one("st_length('LINESTRING(0 0, 0 1)')") - one("st_distance('POINT(0 0)', 'POINT(0 1)')")) < 1e-6
    assert abs(one("st_perimeter('POLYGON((0 0, 0 1, 1 1, 1 0, 0 0))')") / 444_770 - 1) < 0.01
    assert len(one("geo_geohash_neighbors('u4pruy')")) == 8 and one("st_npoints('LINESTRING(0 0, 1 1, 2 2)')") == 3
    assert one("pg_plainto_tsquery('The Cats')") == "'the' & 'cats'" and one("ndb_chunk_text('abcdefgh', 5, 2)") == ["abcde", "defgh"]
    assert len(one("ulid()")) == 26 and one("is_ulid(ulid())") and one("uuid_version(uuid_v7())") == 7 and one("is_nanoid(nanoid())") and one("is_cuid2(cuid2())")
    assert one("vector_cosine_distance(array(1D, 0D), array(0D, 2D))") == 1.0 and one("sparse_score(map(1, 2D, 3, 1D), map(1, 0.5D))") == 1.0
    assert one("array_has(array('a', NULL), NULL)") is True and one("round_half_even(2.5)") == 2.0


def test_geohash_neighbours_touch(spark):
    for text in ("u4pruy", "8", "xbpbpb"):
        west, south, east, north = sql_functions._geohash_cell(text)
        for other in sql_functions.geohash_neighbours(text):
            w, s, e, n = sql_functions._geohash_cell(other)
            turns = (0, 360, -360)
            assert any(w + t <= east + 1e-9 and e + t >= west - 1e-9 for t in turns) and s <= north + 1e-9 and n >= south - 1e-9 and other != text

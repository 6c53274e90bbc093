"""Queries of vector, text, hybrid and spatial search."""

from __future__ import annotations

from pyspark.sql import functions as F

from polymera.functions import geo, vectors
from polymera.operators import search, spatial
from polymera.plans.base import Tables, query

#: One vector of the table, as both engines take it.
_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 7)"


def _query_vector(t: Tables) -> list[float]:
    return t.embeddings.where("vec_id = 7").first()["embedding"]


_L2 = "list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


@query("knn_l2", f"SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings, {_Q} ORDER BY {_L2}, vec_id LIMIT 10")
def knn_l2(t: Tables):
    return search.knn(t.embeddings, _query_vector(t), 10, id_column="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("knn_cosine_filtered", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, {_Q} WHERE label = 1 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 10")
def knn_cosine_filtered(t: Tables):
    return search.knn(t.embeddings, _query_vector(t), 10, id_column="vec_id", metric="cosine", where=F.col("label") == 1).select("vec_id", F.round("distance", 6).alias("distance"))


@query("vector_metrics", f"""SELECT vec_id, round(-list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 5) + 0.0 AS ip,
    round(list_sum(list_transform(list_zip(embedding, q), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 5) AS l1,
    round(list_max(list_transform(list_zip(embedding, q), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 5) AS linf FROM embeddings, {_Q}""")
def vector_metrics(t: Tables):
    q, v = vectors.literal(_query_vector(t)), F.col("embedding")
    return t.embeddings.select("vec_id", (F.round(vectors.neg_inner_product(v, q), 5) + F.lit(0.0)).alias("ip"), F.round(vectors.l1(v, q), 5).alias("l1"), F.round(vectors.linf(v, q), 5).alias("linf"))


@query("knn_join", "SELECT query_id, id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), b.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 5")
def knn_join(t: Tables):
    e = t.embeddings
    return search.knn_join(e.where("vec_id % 50 = 0"), e, 5, "vec_id", "embedding", "vec_id", "embedding").select("query_id", "id", "rank")


@query("sparse_search", "SELECT doc AS id, sum(w * CASE dim WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 END) AS score FROM (SELECT o_custkey AS doc, o_orderkey % 5 AS dim, count(*)::DOUBLE AS w FROM orders GROUP BY 1, 2) WHERE dim IN (1, 2) GROUP BY 1")
def sparse_search(t: Tables):
    counts = t.orders.groupBy(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 5).cast("int").alias("dim")).agg(F.count("*").cast("float").alias("w"))
    docs = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "w"))).alias("terms"))
    return search.sparse_scores(docs, {1: 1.0, 2: 0.5})


@query("multi_vector_max_sim", f"SELECT label, round(max(list_inner_product(embedding::DOUBLE[], q::DOUBLE[])), 6) AS score FROM embeddings, {_Q} GROUP BY label")
def multi_vector_max_sim(t: Tables):
    docs = t.embeddings.groupBy("label").agg(F.collect_list("embedding").alias("vs"))
    return docs.select("label", F.round(search.multi_vector_score(F.col("vs"), [_query_vector(t)]), 6).alias("score"))


_TOKENS = r"list_filter(regexp_extract_all(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}_-]+'), lambda x: strlen(x) >= 2)"


def _bm25_sql(terms: list[str], table: str = "documents") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean)) ELSE 0 END" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"SELECT doc_id AS id, {score} AS score FROM (SELECT doc_id, len(t) AS length, {tf} FROM (SELECT doc_id, {_TOKENS} AS t FROM {table})) a, (SELECT count(*) AS n, avg(length) AS mean, {df} FROM (SELECT len(t) AS length, {tf} FROM (SELECT {_TOKENS} AS t FROM {table}))) s WHERE {hit}"


@query("bm25_search", f"SELECT id, round(score, 6) AS score FROM ({_bm25_sql(['idiot', 'the', 'license'])})")
def bm25_search(t: Tables):
    return search.bm25(t.documents, "idiot the license").select("id", F.round("score", 6).alias("score"))


@query("text_match_negation", f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'the') AND NOT list_contains(t, 'of')")
def text_match_negation(t: Tables):
    return search.text_match(t.documents, "the NOT of").select("doc_id")


@query("phrase_search", f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')")
def phrase_search(t: Tables):
    return search.phrase_match(t.documents, "of the").select("doc_id")


@query("fuzzy_search", f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE len(list_filter(t, lambda x: levenshtein(x, 'stupid') <= 1)) > 0")
def fuzzy_search(t: Tables):
    return search.fuzzy_match(t.documents, "stupid").select("doc_id")


@query("highlight", "SELECT item_id, regexp_replace(text, '(?i)\\b(the|of)\\b', '<b>\\1</b>', 'g') AS marked FROM benchmark")
def highlight(t: Tables):
    return t.benchmark.select("item_id", search.highlight(F.col("text"), "the of").alias("marked"))


_TEXT_LIST = f"(SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM ({_bm25_sql(['the', 'and'])}) ORDER BY rank LIMIT 50)"
_VECTOR_LIST = f"(SELECT vec_id AS id, row_number() OVER (ORDER BY {_L2}, vec_id) - 1 AS rank FROM embeddings, {_Q} ORDER BY rank LIMIT 50)"


@query("hybrid_rrf", f"SELECT id, round(sum(1.0 / (60 + rank + 1)), 9) AS score FROM (SELECT * FROM {_TEXT_LIST} UNION ALL SELECT * FROM {_VECTOR_LIST}) GROUP BY id ORDER BY sum(1.0 / (60 + rank + 1)) DESC, id LIMIT 20")
def hybrid_rrf(t: Tables):
    text = search.bm25(t.documents, "the and").withColumn("score", F.round("score", 9))
    near = t.embeddings.select(F.col("vec_id").alias("id"), vectors.l2_squared(F.col("embedding"), vectors.literal(_query_vector(t))).alias("distance"))
    return search.hybrid(text, near, 20, 50).select("id", F.round("score", 9).alias("score"))


#: Points made of keys: no table has geometry.
_P = "(SELECT s_suppkey AS id, (s_suppkey * 37 % 360) - 180.0 AS x, (s_suppkey * 17 % 120) - 60.0 AS y FROM supplier)"
_HAV = "2 * 6371000.0 * asin(sqrt(least(1, pow(sin(radians({b}y - {a}y) / 2), 2) + cos(radians({a}y)) * cos(radians({b}y)) * pow(sin(radians({b}x - {a}x) / 2), 2))))"


def _points(t: Tables, x: str = "x", y: str = "y", id_: str = "id"):
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias(id_), (k * 37 % 360 - 180).cast("double").alias(x), (k * 17 % 120 - 60).cast("double").alias(y))


@query("spatial_dwithin", f"SELECT id, round({_HAV.format(a='', b='c.')}, 2) AS distance FROM {_P}, (SELECT 10.0 AS x, 20.0 AS y) c WHERE {_HAV.format(a='', b='c.')} <= 4000000".replace("radians(y)", "radians(y)").replace("c.y - y", "c.y - p.y").replace("c.x - x", "c.x - p.x").replace("radians(y)", "radians(p.y)").replace(f"FROM {_P},", f"FROM {_P} p,"))
def spatial_dwithin(t: Tables):
    return spatial.within_distance(_points(t), "x", "y", (10.0, 20.0), 4_000_000).select("id", F.round("distance", 2).alias("distance"))


@query("spatial_distance_join", f"SELECT a.id AS a, b.id AS b, round({_HAV.format(a='a.', b='b.')}, 2) AS distance FROM {_P} a, {_P} b WHERE a.id < b.id AND {_HAV.format(a='a.', b='b.')} <= 500000")
def spatial_distance_join(t: Tables):
    j = spatial.distance_join(_points(t, "ax", "ay", "a"), _points(t, "bx", "by", "b"), 500_000, ("ax", "ay"), ("bx", "by"))
    return j.where("a < b").select("a", "b", F.round("distance", 2).alias("distance"))


@query("spatial_in_polygon", f"SELECT id FROM {_P} WHERE x > -100.5 AND x < 40.5 AND y > -30.5 AND y < 50.5 AND y - x * 0.5 < 60.25")
def spatial_in_polygon(t: Tables):
    ring = [(-100.5, -30.5), (40.5, -30.5), (40.5, 50.5), (-19.5, 50.5), (-100.5, 10.0)]
    return spatial.in_polygon(_points(t), "x", "y", ring).select("id")


@query("spatial_measures", f"SELECT id, round({_HAV.format(a='', b='c.')}, 1) AS d FROM {_P} p, (SELECT 2.3522 AS x, 48.8566 AS y) c".replace("c.y - y", "c.y - p.y").replace("c.x - x", "c.x - p.x").replace("radians(y)", "radians(p.y)"))
def spatial_measures(t: Tables):
    return _points(t).select("id", F.round(geo.haversine(F.col("x"), F.col("y"), F.lit(2.3522), F.lit(48.8566)), 1).alias("d"))


@query("spatial_geohash")
def spatial_geohash(t: Tables):
    return _points(t).select("id", geo.geohash(F.col("x"), F.col("y"), 8).alias("geohash"), geo.as_text(geo.point(F.col("x"), F.col("y"))).alias("wkt"))


@query("spatial_predicates")
def spatial_predicates(t: Tables):
    wkt = F.concat(F.lit("POINT("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    box = F.lit("POLYGON((-50 -30, 60 -30, 60 40, -50 40, -50 -30))")
    return _points(t).select("id", geo.st_within(wkt, box).alias("within"), geo.st_intersects(box, wkt).alias("intersects"), geo.st_disjoint(box, wkt).alias("disjoint"), geo.st_isvalid(box).alias("valid"))

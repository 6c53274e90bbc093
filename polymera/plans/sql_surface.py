"""Queries that call the engine's functions by their SQL names, a family each, with the same said in DuckDB."""

from __future__ import annotations

from polymera import sql_functions
from polymera.plans.base import Tables, query


def _sql(t: Tables, text: str):
    sql_functions.register(t.spark)
    return t.sql(text)


@query(
    "sql_time_functions",
    """SELECT event_id, (epoch_us(ts) // 900000000 * 900000)::BIGINT AS bucket, (epoch_us(ts + INTERVAL 90 MINUTE) // 1000)::BIGINT AS later, (epoch_us(ts - INTERVAL 1 DAY) // 1000)::BIGINT AS before,
    5400000::BIGINT AS d, (epoch_us(ts) // 1000000)::BIGINT AS secs FROM events""",
)
def sql_time_functions(t: Tables):
    return _sql(t, """SELECT event_id, time_bucket('15m', CAST(ts AS TIMESTAMP)) AS bucket, epoch_millis(datetime_add(CAST(ts AS TIMESTAMP), '1h30m')) AS later,
        epoch_millis(datetime_sub(CAST(ts AS TIMESTAMP), '1 day')) AS before, to_duration('1h30m') AS d, epoch_secs(CAST(ts AS TIMESTAMP)) AS secs FROM {events}""")


@query(
    "sql_json_functions",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.nope') AS has_nope, lower(json_type(props)) AS type,
    len(json_keys(props))::INT AS n, CAST(json_merge_patch(props, '{"seen":true}') AS VARCHAR) AS merged, len(list_filter(json_keys(props), lambda x: x = 'k')) > 0 AS key_k FROM events""",
)
def sql_json_functions(t: Tables):
    return _sql(t, """SELECT event_id, json_get(props, 'k') AS k, doc_exists(props, '$.k') AS has_k, json_exists(props, 'nope') AS has_nope, json_type(props) AS type,
        json_length(props) AS n, json_merge(props, '{{"seen":true}}') AS merged, pg_json_has_any_key(props, array('k', 'x')) AS key_k FROM {events}""")


@query(
    "sql_vector_functions",
    """SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))), 6) AS l2,
    round(-list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS nip, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos
    FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b""",
)
def sql_vector_functions(t: Tables):
    return _sql(t, """SELECT a.vec_id, round(vector_distance(a.embedding, b.embedding), 6) AS l2, round(vector_neg_inner_product(a.embedding, b.embedding), 6) AS nip,
        round(vector_cosine_distance(a.embedding, b.embedding), 6) AS cos FROM {embeddings} a, (SELECT embedding FROM {embeddings} ORDER BY vec_id LIMIT 1) b""")


@query(
    "sql_text_functions",
    """WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')), '[\\p{L}\\p{N}_-]+'), lambda x: strlen(x) >= 2) AS t, text FROM benchmark)
    SELECT item_id, len(t)::INT AS n, len(list_filter(t, lambda x: x IN ('the', 'of'))) > 0 AS any_, list_contains(t, 'the') AND list_contains(t, 'of') AS all_,
    greatest(1, ceil((length(text) - 10) / 40.0))::INT AS chunks FROM t""",
)
def sql_text_functions(t: Tables):
    return _sql(t, """SELECT item_id, size(text_tokens(text)) AS n, text_match(text, 'the of') AS any_, pg_fts_match(text, 'the of') AS all_, size(ndb_chunk_text(text, 50, 10)) AS chunks FROM {benchmark}""")


_X, _Y = "(s_suppkey * 37 % 360) - 180.0", "(s_suppkey * 17 % 120) - 60.0"


@query(
    "sql_geometry_functions",
    f"""SELECT s_suppkey, x, y, 'POINT' AS kind, x > -50 AND x < 60 AND y > -30 AND y < 40 AS inside, 4326 AS srid,
    round(2 * 6371000.0 * asin(sqrt(least(1, pow(sin(radians(48.8566 - y) / 2), 2) + cos(radians(y)) * cos(radians(48.8566)) * pow(sin(radians(2.3522 - x) / 2), 2)))), 1) AS metres
    FROM (SELECT s_suppkey, ({_X})::DOUBLE + 0.25 AS x, ({_Y})::DOUBLE + 0.25 AS y FROM supplier)""",
)
def sql_geometry_functions(t: Tables):
    return _sql(t, f"""SELECT s_suppkey, st_x(p) AS x, st_y(p) AS y, upper(st_geometrytype(p)) AS kind, st_within(p, 'POLYGON((-50 -30, 60 -30, 60 40, -50 40, -50 -30))') AS inside,
        geo_srid(p) AS srid, round(st_distance(p, 'POINT(2.3522 48.8566)'), 1) AS metres
        FROM (SELECT s_suppkey, st_point(CAST({_X} AS DOUBLE) + 0.25, CAST({_Y} AS DOUBLE) + 0.25) AS p FROM {{supplier}})""")


@query(
    "sql_id_functions",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'uuid' ELSE 'unknown' END AS kind, o_orderkey % 2 = 0 AS is_uuid, CASE WHEN o_orderkey % 2 = 0 THEN 4 END AS version, 1469918176385::BIGINT AS ms FROM orders""",
)
def sql_id_functions(t: Tables):
    return _sql(t, """SELECT o_orderkey, id_type(s) AS kind, is_uuid(s) AS is_uuid, uuid_version(s) AS version, ulid_timestamp('01ARYZ6S41TSV4RRFFQ69G5FAV') AS ms
        FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '3f2b8c1a-9d4e-4f6a-8b7c-0123456789ab' ELSE o_comment_ END AS s FROM (SELECT o_orderkey, concat('order ', o_orderkey) AS o_comment_ FROM {orders}))""")


@query(
    "sql_array_functions",
    """SELECT p_partkey, len(a)::INT AS n, list_contains(a, p_brand) AS has, list_reverse(a) AS back, len(list_concat(a, ['x']))::INT AS more FROM (SELECT p_partkey, p_brand, [p_brand, p_type] AS a FROM part)""",
)
def sql_array_functions(t: Tables):
    return _sql(t, "SELECT p_partkey, array_length(a) AS n, array_has(a, p_brand) AS has, array_reverse(a) AS back, array_length(array_cat(a, array('x'))) AS more FROM (SELECT p_partkey, p_brand, array(p_brand, p_type) AS a FROM {part})")


@query("percentiles_of_large_groups", "SELECT l_returnflag, p, round(CASE p WHEN 0.5 THEN m ELSE q END, 4) AS value FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.9) AS q FROM lineitem GROUP BY 1), (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE]) AS p)")
def percentiles_of_large_groups(t: Tables):
    from pyspark.sql import functions as F

    from polymera.operators import aggregates

    return aggregates.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.5, 0.9]).select("l_returnflag", "p", F.round("value", 4).alias("value"))


@query("lateral_left", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON s_acctbal > 4000 + n_nationkey * 250")
def lateral_left(t: Tables):
    from pyspark.sql import functions as F

    from polymera.operators import joins

    return joins.lateral_loop(t.nation, t.supplier, F.col("s_acctbal") > 4000 + F.col("n_nationkey") * 250).select("n_nationkey", "s_suppkey")

"""The engine's functions by their SQL names: SQL bodies that Catalyst inlines, and Arrow-batched ones where Spark has no expression.

A name that Spark defines with another meaning (array_append of nulls aside) keeps the engine's: temporary
functions come before built-in ones. Names that Spark already defines alike are not repeated here.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from polymera.functions import geo, ids, json_functions
from polymera.functions.datetimes import interval_ms

_DURATION_MS = "duration_ms({})"
_SUM = "aggregate({}, 0.0D, (s, x) -> s + x)"
_PATH = "concat('$', regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(LEADING '$' FROM path), '\\\\[(\\\\d+)\\\\]', '.$1'), '^\\\\.', ''), '([^.]+)\\\\.?', '[\\'$1\\']'), '\\\\[\\'(\\\\d+)\\'\\\\]', '[$1]'))"


def _zip(f: str) -> str:
    return _SUM.format(f"zip_with(a, b, (x, y) -> CAST({f} AS DOUBLE))")


_NORM = "sqrt(aggregate({0}, 0.0D, (s, x) -> s + CAST(x AS DOUBLE) * x))"
_VECTOR = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_POINTS = "lng1 DOUBLE, lat1 DOUBLE, lng2 DOUBLE, lat2 DOUBLE"

#: Signature and body, by family.
BODIES: dict[str, dict[str, str]] = {
    "arrays": {
        "array_length(a ARRAY<STRING>) RETURNS INT": "CASE WHEN a IS NOT NULL THEN size(a) END",
        "array_cat(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS ARRAY<STRING>": "CASE WHEN b IS NULL THEN a ELSE concat(a, b) END",
        "array_concat(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS ARRAY<STRING>": "CASE WHEN b IS NULL THEN a ELSE concat(a, b) END",
        "array_reverse(a ARRAY<STRING>) RETURNS ARRAY<STRING>": "reverse(a)",
        "array_has(a ARRAY<STRING>, v STRING) RETURNS BOOLEAN": "coalesce(exists(a, x -> x <=> v), false)",
        "array_contains_all(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS BOOLEAN": "forall(b, y -> coalesce(exists(a, x -> x <=> y), false))",
        "array_overlap(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS BOOLEAN": "exists(b, y -> coalesce(exists(a, x -> x <=> y), false))",
        "make_array(a STRING, b STRING) RETURNS ARRAY<STRING>": "array(a, b)",
    },
    "times": {
        "time_bucket(width STRING, ts TIMESTAMP) RETURNS BIGINT": f"CAST(floor(unix_micros(ts) / 1000 / {_DURATION_MS.format('width')}) * {_DURATION_MS.format('width')} AS BIGINT)",
        "bucket_ms(width BIGINT, ms BIGINT) RETURNS BIGINT": "CAST(floor(ms / width) * width AS BIGINT)",
        "datetime(s STRING) RETURNS TIMESTAMP": "try_to_timestamp(s)",
        "to_datetime(s STRING) RETURNS TIMESTAMP": "try_to_timestamp(s)",
        "unix_secs(ts TIMESTAMP) RETURNS BIGINT": "unix_seconds(ts)",
        "epoch_secs(ts TIMESTAMP) RETURNS BIGINT": "unix_seconds(ts)",
        "epoch_millis(ts TIMESTAMP) RETURNS BIGINT": "unix_millis(ts)",
        "datetrunc(part STRING, ts TIMESTAMP) RETURNS TIMESTAMP": "date_trunc(part, ts)",
        "datetime_add(ts TIMESTAMP, width STRING) RETURNS TIMESTAMP": f"timestamp_micros(unix_micros(ts) + {_DURATION_MS.format('width')} * 1000)",
        "datetime_sub(ts TIMESTAMP, width STRING) RETURNS TIMESTAMP": f"timestamp_micros(unix_micros(ts) - {_DURATION_MS.format('width')} * 1000)",
        "datetime_diff(a TIMESTAMP, b TIMESTAMP) RETURNS BIGINT": "unix_micros(a) - unix_micros(b)",
        "duration(width STRING) RETURNS BIGINT": _DURATION_MS.format("width"),
        "to_duration(width STRING) RETURNS BIGINT": _DURATION_MS.format("width"),
        "to_decimal(x STRING) RETURNS DECIMAL(38, 9)": "try_cast(x AS DECIMAL(38, 9))",
    },
    "numbers": {
        "safe_sqrt(x DOUBLE) RETURNS DOUBLE": "CASE WHEN x >= 0 THEN sqrt(x) END",
        "safe_ln(x DOUBLE) RETURNS DOUBLE": "CASE WHEN x > 0 THEN ln(x) END",
        "round_half_even(x DOUBLE) RETURNS DOUBLE": "bround(x, 0)",
        "round_half_up(x DOUBLE) RETURNS DOUBLE": "round(x, 0)",
        "char_bytes(s STRING) RETURNS INT": "octet_length(s)",
        "concat_nulls(a STRING, b STRING) RETURNS STRING": "coalesce(a, '') || coalesce(b, '')",
        "type_of(v STRING) RETURNS STRING": "typeof(v)",
    },
    "ids": {
        "uuid_v4() RETURNS STRING": "uuid()",
        "gen_random_uuid() RETURNS STRING": "uuid()",
        "is_uuid(s STRING) RETURNS BOOLEAN": f"s RLIKE '{ids.UUID_PATTERN}'",
        "is_ulid(s STRING) RETURNS BOOLEAN": f"s RLIKE '{ids.ULID_PATTERN}'",
        "is_cuid2(s STRING) RETURNS BOOLEAN": f"s RLIKE '{ids.CUID2_PATTERN}'",
        "is_nanoid(s STRING) RETURNS BOOLEAN": f"s RLIKE '{ids.NANOID_PATTERN}'",
        "id_type(s STRING) RETURNS STRING": f"CASE WHEN s RLIKE '{ids.UUID_PATTERN}' THEN 'uuid' WHEN s RLIKE '{ids.ULID_PATTERN}' THEN 'ulid' WHEN s RLIKE '{ids.CUID2_PATTERN}' THEN 'cuid2' WHEN s RLIKE '{ids.NANOID_PATTERN}' THEN 'nanoid' ELSE 'unknown' END",
        "uuid_version(s STRING) RETURNS INT": f"CASE WHEN s RLIKE '{ids.UUID_PATTERN}' THEN CAST(conv(substring(s, 15, 1), 16, 10) AS INT) END",
        "ulid_timestamp(s STRING) RETURNS BIGINT": f"CASE WHEN upper(s) RLIKE '{ids.ULID_PATTERN}' THEN aggregate(sequence(1, 10), 0L, (a, i) -> a * 32 + instr('{ids.CROCKFORD}', substring(upper(s), i, 1)) - 1) END",
    },
    "json": {
        "json_get(j STRING, path STRING) RETURNS STRING": f"get_json_object(j, {_PATH})",
        "json_extract(j STRING, path STRING) RETURNS STRING": f"get_json_object(j, {_PATH})",
        "json_exists(j STRING, path STRING) RETURNS BOOLEAN": f"get_json_object(j, {_PATH}) IS NOT NULL",
        "json_value(j STRING, path STRING) RETURNS STRING": f"CASE WHEN NOT get_json_object(j, {_PATH}) RLIKE '^\\\\s*[\\\\[{{]' THEN get_json_object(j, {_PATH}) END",
        "json_query(j STRING, path STRING) RETURNS STRING": f"CASE WHEN get_json_object(j, {_PATH}) RLIKE '^\\\\s*[\\\\[{{]' THEN get_json_object(j, {_PATH}) END",
        "json_keys(j STRING) RETURNS ARRAY<STRING>": "json_object_keys(j)",
        "json_values(j STRING) RETURNS ARRAY<STRING>": "transform(json_object_keys(j), k -> get_json_object(j, concat('$[\\'', k, '\\']')))",
        "json_length(j STRING) RETURNS INT": "coalesce(json_array_length(j), size(json_object_keys(j)), octet_length(get_json_object(concat('{\"v\":', j, '}'), '$.v')))",
        "json_len(j STRING) RETURNS INT": "coalesce(json_array_length(j), size(json_object_keys(j)), octet_length(get_json_object(concat('{\"v\":', j, '}'), '$.v')))",
        "json_type(j STRING) RETURNS STRING": "CASE WHEN schema_of_variant(try_parse_json(j)) = 'VOID' THEN 'null' WHEN schema_of_variant(try_parse_json(j)) = 'BOOLEAN' THEN 'boolean' WHEN schema_of_variant(try_parse_json(j)) = 'STRING' THEN 'string' WHEN schema_of_variant(try_parse_json(j)) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant(try_parse_json(j)) LIKE 'OBJECT%' THEN 'object' WHEN try_parse_json(j) IS NOT NULL THEN 'number' END",
        "json_array(a STRING, b STRING) RETURNS STRING": "to_json(array(a, b))",
        "json_object(k STRING, v STRING) RETURNS STRING": "to_json(map(k, v))",
        "json_has(j STRING, v STRING) RETURNS BOOLEAN": "CASE WHEN json_array_length(j) IS NOT NULL THEN array_contains(from_json(j, 'array<string>'), v) ELSE coalesce(array_contains(json_object_keys(j), v), false) END",
        "doc_get(j STRING, path STRING) RETURNS STRING": f"get_json_object(j, {_PATH})",
        "doc_exists(j STRING, path STRING) RETURNS BOOLEAN": f"get_json_object(j, {_PATH}) IS NOT NULL",
        "doc_array_contains(j STRING, path STRING, v STRING) RETURNS BOOLEAN": f"coalesce(array_contains(from_json(get_json_object(j, {_PATH}), 'array<string>'), v), false)",
        "pg_json_get(j STRING, k STRING) RETURNS STRING": "get_json_object(j, concat('$[\\'', k, '\\']'))",
        "pg_json_get_text(j STRING, k STRING) RETURNS STRING": "get_json_object(j, concat('$[\\'', k, '\\']'))",
        "pg_json_path_get(j STRING, path STRING) RETURNS STRING": f"get_json_object(j, {_PATH})",
        "pg_json_path_get_text(j STRING, path STRING) RETURNS STRING": f"get_json_object(j, {_PATH})",
        "pg_json_has_key(j STRING, k STRING) RETURNS BOOLEAN": "coalesce(array_contains(json_object_keys(j), k), false)",
        "pg_json_has_all_keys(j STRING, ks ARRAY<STRING>) RETURNS BOOLEAN": "forall(ks, k -> coalesce(array_contains(json_object_keys(j), k), false))",
        "pg_json_has_any_key(j STRING, ks ARRAY<STRING>) RETURNS BOOLEAN": "exists(ks, k -> coalesce(array_contains(json_object_keys(j), k), false))",
    },
    "vectors": {
        f"vector_dot({_VECTOR}) RETURNS DOUBLE": _zip("x * y"),
        f"vector_l2({_VECTOR}) RETURNS DOUBLE": _zip("(x - y) * (x - y)"),
        f"vector_distance({_VECTOR}) RETURNS DOUBLE": _zip("(x - y) * (x - y)"),
        f"vector_neg_inner_product({_VECTOR}) RETURNS DOUBLE": f"-({_zip('x * y')})",
        f"vector_cosine_distance({_VECTOR}) RETURNS DOUBLE": f"CASE WHEN {_NORM.format('a')} * {_NORM.format('b')} < 1e-12 THEN 1.0D ELSE greatest(0.0D, 1 - ({_zip('x * y')}) / ({_NORM.format('a')} * {_NORM.format('b')})) END",
        f"vector_l1({_VECTOR}) RETURNS DOUBLE": _zip("abs(x - y)"),
        "rrf_score(rank BIGINT) RETURNS DOUBLE": "1.0D / (60 + rank + 1)",
        "sparse_score(a MAP<INT, DOUBLE>, b MAP<INT, DOUBLE>) RETURNS DOUBLE": "aggregate(map_entries(a), 0.0D, (s, e) -> s + e.value * coalesce(b[e.key], 0.0D))",
    },
    "text": {
        "text_tokens(s STRING) RETURNS ARRAY<STRING>": "filter(regexp_extract_all(translate(lower(coalesce(s, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\\\p{L}\\\\p{N}_-]+', 0), t -> octet_length(t) >= 2)",
        "text_match(s STRING, query STRING) RETURNS BOOLEAN": "exists(text_tokens(query), q -> array_contains(text_tokens(s), q))",
        "pg_to_tsvector(s STRING) RETURNS ARRAY<STRING>": "array_sort(array_distinct(text_tokens(s)))",
        "pg_plainto_tsquery(s STRING) RETURNS STRING": "array_join(transform(text_tokens(s), t -> concat('\\'', t, '\\'')), ' & ')",
        "pg_to_tsquery(s STRING) RETURNS STRING": "array_join(transform(text_tokens(s), t -> concat('\\'', t, '\\'')), ' & ')",
        "pg_phraseto_tsquery(s STRING) RETURNS STRING": "array_join(transform(text_tokens(s), t -> concat('\\'', t, '\\'')), ' <-> ')",
        "pg_fts_match(s STRING, query STRING) RETURNS BOOLEAN": "forall(text_tokens(query), q -> array_contains(text_tokens(s), q)) AND size(text_tokens(query)) > 0",
        "ndb_chunk_text(s STRING, size INT, overlap INT) RETURNS ARRAY<STRING>": "CASE WHEN overlap < 0 OR overlap >= size THEN CAST(raise_error('overlap must be at least 0 and less than size') AS ARRAY<STRING>) WHEN s IS NULL THEN NULL WHEN char_length(s) = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE transform(sequence(0, CAST(greatest(1, ceil((char_length(s) - overlap) / (size - overlap))) AS INT) - 1), i -> substr(s, i * (size - overlap) + 1, size)) END",
    },
    "space": {
        f"geo_distance({_POINTS}) RETURNS DOUBLE": "2 * 6371000.0D * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2))))",
        f"haversine_distance({_POINTS}) RETURNS DOUBLE": "geo_distance(lng1, lat1, lng2, lat2)",
        f"haversine_bearing({_POINTS}) RETURNS DOUBLE": "geo_bearing(lng1, lat1, lng2, lat2)",
        "st_point(lng DOUBLE, lat DOUBLE) RETURNS STRING": "concat('POINT(', lng, ' ', lat, ')')",
        "st_makepoint(lng DOUBLE, lat DOUBLE) RETURNS STRING": "concat('POINT(', lng, ' ', lat, ')')",
        "geo_point(lng DOUBLE, lat DOUBLE) RETURNS STRING": "concat('POINT(', lng, ' ', lat, ')')",
        "st_makeenvelope(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS STRING": "concat('POLYGON((', x1, ' ', y1, ', ', x2, ' ', y1, ', ', x2, ' ', y2, ', ', x1, ' ', y2, ', ', x1, ' ', y1, '))')",
        "geo_bbox(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS STRING": "st_makeenvelope(x1, y1, x2, y2)",
        "st_makeline(ps ARRAY<STRING>) RETURNS STRING": "concat('LINESTRING(', array_join(transform(ps, p -> regexp_extract(p, '\\\\(\\\\s*([^()]*?)\\\\s*\\\\)', 1)), ', '), ')')",
        "geo_line(ps ARRAY<STRING>) RETURNS STRING": "st_makeline(ps)",
        "st_makepolygon(line STRING) RETURNS STRING": "concat('POLYGON((', regexp_extract(line, '\\\\(\\\\s*([^()]*?)\\\\s*\\\\)', 1), '))')",
        "geo_polygon(line STRING) RETURNS STRING": "st_makepolygon(line)",
        "geo_srid(g STRING) RETURNS INT": "CASE WHEN g IS NOT NULL THEN 4326 END",
        "st_dwithin(a STRING, b STRING, metres DOUBLE) RETURNS BOOLEAN": "st_distance(a, b) <= metres",
    },
}

#: Functions that one body defines and a later one calls come first.
ORDER = ("arrays", "times", "numbers", "ids", "json", "vectors", "text", "space")


def _measured(geometry: dict | None, closed: bool) -> float | None:
    """Metres along lines (or rings, if closed) of a geometry on the sphere."""
    if geometry is None:
        return None
    kinds = {True: ("Polygon", "MultiPolygon"), False: ("LineString", "MultiLineString")}[closed]
    if geometry["type"] not in kinds:
        return 0.0
    lines: list = []

    def walk(c) -> None:
        if c and isinstance(c[0][0], int | float):
            lines.append(c)
        else:
            for x in c:
                walk(x)

    walk(geometry["coordinates"])
    return sum(geo_metres(*a[:2], *b[:2]) for line in lines for a, b in zip(line, line[1:]))


def geo_metres(lng1: float, lat1: float, lng2: float, lat2: float) -> float:
    """Great-circle metres between two places."""
    import math

    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * geo.EARTH * math.asin(math.sqrt(min(1.0, h)))


def _bearing(lng1: float, lat1: float, lng2: float, lat2: float) -> float:
    import math

    a, b, d = math.radians(lat1), math.radians(lat2), math.radians(lng2 - lng1)
    return math.degrees(math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d))) % 360


def _first_point(text: str | None) -> list | None:
    g = geo.parse_wkt(text) if text else None
    return g["coordinates"] if g and g["type"] == "Point" else None


def _distance(a: str | None, b: str | None) -> float | None:
    p, q = _first_point(a), _first_point(b)
    return geo_metres(*p[:2], *q[:2]) if p and q else None


def _coordinate(i: int):
    def of(text: str | None) -> float | None:
        p = _first_point(text)
        return float(p[i]) if p else None

    return of


def _wkt_of(text: str | None) -> str | None:
    """WKT of a GeoJSON geometry; null if it is none."""
    try:
        g = json.loads(text) if text else None
        return wkt(g) if isinstance(g, dict) and "coordinates" in g else None
    except (ValueError, TypeError, IndexError, KeyError):
        return None


def wkt(g: dict) -> str:
    """WKT of a geometry."""

    def nested(c) -> str:
        return " ".join(f"{x:g}" if float(x).is_integer() else repr(float(x)) for x in c) if isinstance(c[0], int | float) else "(" + ", ".join(map(nested, c)) + ")"

    inside = nested(g["coordinates"])
    return f"{g['type'].upper()}{inside if inside.startswith('(') else f'({inside})'}"


def _geohash_cell(text: str) -> tuple[float, float, float, float]:
    """West, south, east and north of a geohash."""
    box = [[-180.0, 180.0], [-90.0, 90.0]]
    digits = "0123456789bcdefghjkmnpqrstuvwxyz"
    for i in range(5 * len(text)):
        half, side = digits.index(text[i // 5]) >> (4 - i % 5) & 1, box[i % 2]
        side[1 - half] = (side[0] + side[1]) / 2
    return box[0][0], box[1][0], box[0][1], box[1][1]


def geohash_of(lng: float, lat: float, size: int) -> str:
    """The geohash of a place in so many characters."""
    box, at, bits = [[-180.0, 180.0], [-90.0, 90.0]], (lng, lat), 0
    for i in range(5 * size):
        side = box[i % 2]
        middle = (side[0] + side[1]) / 2
        up = at[i % 2] >= middle
        side[0 if up else 1] = middle
        bits = bits << 1 | up
    return "".join("0123456789bcdefghjkmnpqrstuvwxyz"[bits >> 5 * (size - 1 - i) & 31] for i in range(size))


def geohash_neighbours(text: str | None) -> list[str] | None:
    """The geohashes around one from the north clockwise, past longitude 180 too; those beyond a pole are left out."""
    if not text:
        return None
    west, south, east, north = _geohash_cell(text)
    w, h = east - west, north - south
    x, y = (west + east) / 2, (south + north) / 2
    steps = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
    return [geohash_of((x + dx * w + 180) % 360 - 180, y + dy * h, len(text)) for dx, dy in steps if -90 < y + dy * h < 90]


def _rows(f, kind: str):
    """A row function of a few arguments as an Arrow-batched one; an argument that never changes is parsed anew but once."""

    def run(*columns: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for x in zip(*columns):
            if x not in memo:
                if len(memo) > 10_000:
                    memo.clear()
                memo[x] = f(*x)
            out.append(memo[x])
        return pd.Series(out, dtype=object)

    arity = f.__code__.co_argcount
    if arity == 1:
        made = lambda a: run(a)  # noqa: E731  the number of arguments tells Spark the kind
    elif arity == 2:
        made = lambda a, b: run(a, b)
    else:
        made = lambda a, b, c, d: run(a, b, c, d)
    return lambda: F.pandas_udf(made, kind)  # which needs a session


def _parsed(text: str | None) -> dict | None:
    return geo.parse_wkt(text) if text else None


def _test(f):
    def of(a, b):
        p, q = _parsed(a), _parsed(b)
        return None if p is None or q is None else bool(f(p, q))

    return of


def _both_json(f):
    return lambda a, b: None if a is None or b is None else f(json_functions._load(a), json_functions._load(b))


#: Makers of Arrow-batched functions: what Spark has no expression for.
BATCHED = {
    "duration_ms": _rows(lambda text: None if text is None else interval_ms(text), "long"),
    "geo_bearing": _rows(lambda a, b, c, d: None if None in (a, b, c, d) else _bearing(a, b, c, d), "double"),
    "st_distance": _rows(lambda a, b: _distance(a, b), "double"),
    "st_x": _rows(lambda a: _coordinate(0)(a), "double"),
    "st_y": _rows(lambda a: _coordinate(1)(a), "double"),
    "geo_x": _rows(lambda a: _coordinate(0)(a), "double"),
    "geo_y": _rows(lambda a: _coordinate(1)(a), "double"),
    "st_length": _rows(lambda a: _measured(_parsed(a), False), "double"),
    "geo_length": _rows(lambda a: _measured(_parsed(a), False), "double"),
    "st_perimeter": _rows(lambda a: _measured(_parsed(a), True), "double"),
    "geo_perimeter": _rows(lambda a: _measured(_parsed(a), True), "double"),
    "st_geomfromgeojson": _rows(lambda a: _wkt_of(a), "string"),
    "geo_from_geojson": _rows(lambda a: _wkt_of(a), "string"),
    "st_astext": _rows(lambda a: wkt(_parsed(a)) if _parsed(a) else None, "string"),
    "geo_as_wkt": _rows(lambda a: wkt(_parsed(a)) if _parsed(a) else None, "string"),
    "st_asgeojson": _rows(lambda a: json.dumps(_parsed(a), separators=(",", ":")) if _parsed(a) else None, "string"),
    "geo_as_geojson": _rows(lambda a: json.dumps(_parsed(a), separators=(",", ":")) if _parsed(a) else None, "string"),
    "geo_type": _rows(lambda a: _parsed(a)["type"] if _parsed(a) else None, "string"),
    "st_geometrytype": _rows(lambda a: _parsed(a)["type"] if _parsed(a) else None, "string"),
    "st_contains": _rows(lambda a, b: _test(geo.contains)(a, b), "boolean"),
    "st_within": _rows(lambda a, b: _test(geo.contains)(b, a), "boolean"),
    "st_intersects": _rows(lambda a, b: _test(geo.intersects)(a, b), "boolean"),
    "st_disjoint": _rows(lambda a, b: None if _test(geo.intersects)(a, b) is None else not _test(geo.intersects)(a, b), "boolean"),
    "st_isvalid": _rows(lambda a: geo.is_valid(_parsed(a)), "boolean"),
    "geo_is_valid": _rows(lambda a: geo.is_valid(_parsed(a)), "boolean"),
    "st_npoints": _rows(lambda a: len(geo._points(_parsed(a))) if _parsed(a) else None, "int"),
    "geo_num_points": _rows(lambda a: len(geo._points(_parsed(a))) if _parsed(a) else None, "int"),
    "geo_geohash_neighbors": _rows(lambda a: geohash_neighbours(a), "array<string>"),
    "geo_geohash_decode": _rows(lambda a: list(geo.geohash_decode(a)) if a else None, "array<double>"),
    "json_set": lambda: json_functions._set,
    "json_remove": lambda: json_functions._remove,
    "json_merge": lambda: json_functions._merge,
    "json_patch": lambda: json_functions._merge,
    "pg_json_contains": _rows(lambda a, b: _both_json(json_functions._holds)(a, b), "boolean"),
    "pg_json_contained_by": _rows(lambda a, b: _both_json(json_functions._holds)(b, a), "boolean"),
}

#: Generators: a new value for each row.
GENERATORS = {"uuid_v7": ids._v7, "ulid": ids._ulid, "cuid2": ids._cuid2}


def _generator(make):
    return F.udf(make, "string").asNondeterministic()


def names() -> list[str]:
    """All SQL names that register() defines."""
    return sorted([signature.split("(")[0] for family in ORDER for signature in BODIES[family]] + list(BATCHED) + list(GENERATORS) + ["nanoid"])


def register(spark: SparkSession) -> None:
    """Define every function in a session."""
    for name, make in BATCHED.items():
        spark.udf.register(name, make())
    for name, make in GENERATORS.items():
        spark.udf.register(name, _generator(make))
    spark.udf.register("nanoid", _generator(lambda: "".join(ids.NANOID[b & 63] for b in __import__("os").urandom(21))))
    for family in ORDER:
        for signature, body in BODIES[family].items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")

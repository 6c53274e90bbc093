"""Geometry as structs of a type, coordinates and text forms; distances on a sphere as native expressions."""

from __future__ import annotations

import json
import math
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: metres of the mean earth radius.
EARTH = 6_371_000.0
#: Fixed value: geohash's base 32.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def point(lng: Column, lat: Column) -> Column:
    """A point as (x, y) degrees."""
    return F.struct(lng.cast("double").alias("x"), lat.cast("double").alias("y"))


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Metres between two places."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Degrees clockwise from north, 0 to 360, of the way from one place to another."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def distance(a: Column, b: Column) -> Column:
    return haversine(a["x"], a["y"], b["x"], b["y"])


def dwithin(a: Column, b: Column, metres: float) -> Column:
    """Within a distance: a test of latitudes first, which needs no trigonometry."""
    return (F.abs(a["y"] - b["y"]) <= math.degrees(metres / EARTH) * 1.000001) & (distance(a, b) <= metres)


def as_text(p: Column) -> Column:
    """WKT of a point."""
    return F.concat(F.lit("POINT("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")"))


def line_length(coords: Column) -> Column:
    """Metres along an array of (x, y)."""
    legs = F.zip_with(F.slice(coords, F.lit(1), F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, F.lit(2), F.greatest(F.size(coords) - 1, F.lit(0))), distance)
    return F.aggregate(legs, F.lit(0.0), lambda acc, d: acc + d)


def envelope(coords: Column) -> Column:
    """(min_x, min_y, max_x, max_y) of an array of points."""
    xs, ys = F.transform(coords, lambda p: p["x"]), F.transform(coords, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def circle(lng: Column, lat: Column, metres: float, n: int = 32) -> Column:
    """A closed ring of n + 1 points at a distance."""
    r = metres / EARTH

    def at(i):
        t = i * (2 * math.pi / n)
        y = F.asin(F.sin(F.radians(lat)) * math.cos(r) + F.cos(F.radians(lat)) * math.sin(r) * F.cos(t))
        x = F.radians(lng) + F.atan2(F.sin(t) * math.sin(r) * F.cos(F.radians(lat)), math.cos(r) - F.sin(F.radians(lat)) * F.sin(y))
        return point(F.degrees(x), F.degrees(y))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: at(F.pmod(i, F.lit(n))))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """True inside a ring of points by crossings; the ring may be open or closed."""
    n = F.size(ring)

    def crosses(i):
        a, b = F.element_at(ring, i), F.element_at(ring, F.pmod(i, n) + 1)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(False), lambda acc, i: acc != F.coalesce(crosses(i), F.lit(False)))


def ring_area(ring: Column) -> Column:
    """Square metres of a ring on the sphere."""
    n = F.size(ring)

    def part(i):
        a, b = F.element_at(ring, i), F.element_at(ring, F.pmod(i, n) + 1)
        return F.radians(b["x"] - a["x"]) * (2 + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"])))

    return F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + part(i))) * EARTH * EARTH / 2


def geohash(lng: Column, lat: Column, precision: int = 12) -> Column:
    """Base 32 of interleaved bits, longitude first, all native: each axis is scaled to whole cells first."""
    bits = precision * 5
    n_x, n_y = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.least(F.floor((v - low) / span * (1 << n)), F.lit((1 << n) - 1)).cast("long")
    x, y = cell(lng, -180, 360, n_x), cell(lat, -90, 180, n_y)
    out = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5):
            k = c * 5 + b
            axis, at = (x, n_x - 1 - k // 2) if k % 2 == 0 else (y, n_y - 1 - k // 2)
            value = value * 2 + F.shiftright(axis, at).bitwiseAND(F.lit(1))
        out.append(F.substr(F.lit(GEOHASH), value.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


# geometries in text and binary forms, by Arrow-batched functions


def parse_wkt(text: str | None) -> dict | None:
    """GeoJSON-shaped geometry of WKT; null for what is not WKT."""
    m = re.match(r"\s*([A-Za-z]+)\s*(.*)$", text or "", re.S)
    if not m:
        return None
    body = re.sub(r"(-?[\d.]+(?:[eE][-+]?\d+)?)\s+(-?[\d.]+(?:[eE][-+]?\d+)?)", r"[\1,\2]", m[2]).replace("(", "[").replace(")", "]")
    kinds = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    try:
        kind, coords = kinds[m[1].upper()], json.loads(body)
    except (KeyError, ValueError):
        return None
    return {"type": kind, "coordinates": coords[0] if kind == "Point" else [c[0] if isinstance(c[0], list) and kind == "MultiPoint" else c for c in coords]}


def parse_wkb(data: bytes | None) -> dict | None:
    """GeoJSON-shaped geometry of WKB points, lines and polygons."""
    try:
        order = "<" if data[0] == 1 else ">"
        (kind,) = struct.unpack(order + "I", data[1:5])
        at = 5

        def take(fmt):
            nonlocal at
            out = struct.unpack_from(order + fmt, data, at)
            at += struct.calcsize(order + fmt)
            return out

        line = lambda: [list(take("dd")) for _ in range(take("I")[0])]
        if kind == 1:
            return {"type": "Point", "coordinates": list(take("dd"))}
        if kind == 2:
            return {"type": "LineString", "coordinates": line()}
        if kind == 3:
            return {"type": "Polygon", "coordinates": [line() for _ in range(take("I")[0])]}
    except (TypeError, IndexError, struct.error):
        pass
    return None


def _segments(g: dict) -> list:
    c, kind = g["coordinates"], g["type"]
    lines = {"Point": [], "MultiPoint": [], "LineString": [c], "MultiLineString": c, "Polygon": c}.get(kind)
    lines = [r for p in c for r in p] if lines is None else lines
    return [(a, b) for line in lines for a, b in zip(line, line[1:])]


def _points(g: dict) -> list:
    out: list = []

    def walk(c):
        if isinstance(c[0], int | float):
            out.append(c)
        else:
            for x in c:
                walk(x)

    walk(g["coordinates"])
    return out


def _side(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a, b, p) -> bool:
    return abs(_side(a, b, p)) < 1e-12 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _meet(s, t) -> bool:
    (a, b), (c, d) = s, t
    if any((_on(a, b, c), _on(a, b, d), _on(c, d, a), _on(c, d, b))):
        return True
    return _side(a, b, c) * _side(a, b, d) < 0 and _side(c, d, a) * _side(c, d, b) < 0


def _inside(g: dict, p) -> bool:
    polygons = {"Polygon": [g["coordinates"]], "MultiPolygon": g["coordinates"]}.get(g["type"], [])
    return any(_in_ring(rings[0], p) and not any(_in_ring(h, p) and not any(_on(a, b, p) for a, b in zip(h, h[1:])) for h in rings[1:]) for rings in polygons)


def _in_ring(ring, p) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if _on(a, b, p):
            return True
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def intersects(a: dict, b: dict) -> bool:
    """True if two geometries share a point."""
    pa, pb, sa, sb = _points(a), _points(b), _segments(a), _segments(b)
    if any(_inside(a, p) for p in pb) or any(_inside(b, p) for p in pa) or any(_meet(s, t) for s in sa for t in sb):
        return True
    return any(_on(*s, p) for s in sa for p in pb) or any(_on(*s, p) for s in sb for p in pa) or any(p[:2] == q[:2] for p in pa for q in pb)


def contains(a: dict, b: dict) -> bool:
    """True if all of b is in the polygon a."""
    proper = lambda s, t: _side(*s, t[0]) * _side(*s, t[1]) < 0 and _side(*t, s[0]) * _side(*t, s[1]) < 0
    return all(_inside(a, p) for p in _points(b)) and not any(proper(s, t) for s in _segments(a) for t in _segments(b))


def is_valid(g: dict | None) -> bool:
    """Closed rings of at least four points whose edges do not cross."""
    if g is None:
        return False
    rings = {"Polygon": g["coordinates"], "MultiPolygon": [r for p in g["coordinates"] for r in p] if g["type"] == "MultiPolygon" else []}.get(g["type"], [])
    for r in rings:
        if len(r) < 4 or r[0] != r[-1]:
            return False
        s = list(zip(r, r[1:]))
        for i in range(len(s)):
            for j in range(i + 2, len(s)):
                if (i or j != len(s) - 1) and _meet(s[i], s[j]):
                    return False
    return True


def centroid(g: dict) -> list:
    """Area-weighted for polygons, else the mean of the points."""
    if g["type"] == "Polygon":
        r = g["coordinates"][0]
        cross = [a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])]
        if sum(cross):
            return [sum((a[k] + b[k]) * c for a, b, c in zip(r, r[1:], cross)) / (3 * sum(cross)) for k in (0, 1)]
    p = _points(g)
    return [sum(x[k] for x in p) / len(p) for k in (0, 1)]


def _batched(f, kind: str):
    def run(*columns: Column) -> Column:
        made = F.pandas_udf(lambda *s: pd.Series([f(*row) for row in zip(*s)]), kind)
        return made(*columns)

    return run


def _both(f):
    def test(a, b):
        x, y = _geometry(a), _geometry(b)
        return None if x is None or y is None else f(x, y)

    return test


def _geometry(text):
    if text is None:
        return None
    return json.loads(text) if text.lstrip().startswith("{") else parse_wkt(text)


#: Predicates and makers over geometries written as WKT or GeoJSON.
st_intersects = _batched(_both(intersects), "boolean")
st_disjoint = _batched(_both(lambda a, b: not intersects(a, b)), "boolean")
st_contains = _batched(_both(contains), "boolean")
st_within = _batched(_both(lambda a, b: contains(b, a)), "boolean")
st_isvalid = _batched(lambda a: None if a is None else is_valid(_geometry(a)), "boolean")
st_geometrytype = _batched(lambda a: (_geometry(a) or {}).get("type"), "string")
st_npoints = _batched(lambda a: None if _geometry(a) is None else len(_points(_geometry(a))), "int")
st_asgeojson = _batched(lambda a: None if _geometry(a) is None else json.dumps(_geometry(a), separators=(",", ":")), "string")
st_centroid = _batched(lambda a: None if _geometry(a) is None else json.dumps({"type": "Point", "coordinates": centroid(_geometry(a))}, separators=(",", ":")), "string")
st_geomfromwkb = _batched(lambda a: None if parse_wkb(a) is None else json.dumps(parse_wkb(a), separators=(",", ":")), "string")


def geohash_decode(text: str) -> tuple[float, float]:
    """Centre (lng, lat) of a geohash cell."""
    bits = [GEOHASH.index(c) >> b & 1 for c in text for b in range(4, -1, -1)]
    out = []
    for axis, (low, high) in ((bits[::2], (-180.0, 180.0)), (bits[1::2], (-90.0, 90.0))):
        for b in axis:
            low, high = ((low + high) / 2, high) if b else (low, (low + high) / 2)
        out.append((low + high) / 2)
    return out[0], out[1]


def st_geohashdecode(h: Column) -> Column:
    made = F.pandas_udf(lambda s: pd.DataFrame([geohash_decode(x) if x else (None, None) for x in s], columns=["x", "y"]), "x double, y double")
    return made(h)

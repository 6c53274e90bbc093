"""Spatial scans and joins: cells first by equality, then the exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polymera.functions import geo


def within_distance(df: DataFrame, lng: str, lat: str, at: tuple[float, float], metres: float) -> DataFrame:
    """Rows within metres of a place, with their distance: a bounding box that the scan can use, then the sphere."""
    dy = math.degrees(metres / geo.EARTH)
    dx = dy / max(1e-9, math.cos(math.radians(min(89.9, abs(at[1]) + dy))))
    box = F.col(lat).between(at[1] - dy, at[1] + dy)
    if at[0] - dx >= -180 and at[0] + dx <= 180:
        box = box & F.col(lng).between(at[0] - dx, at[0] + dx)
    d = geo.haversine(F.col(lng), F.col(lat), F.lit(float(at[0])), F.lit(float(at[1])))
    return df.where(box).withColumn("distance", d).where(F.col("distance") <= metres)


def in_polygon(df: DataFrame, lng: str, lat: str, ring: list[tuple[float, float]]) -> DataFrame:
    """Rows inside a ring: its box first, then crossings, all native."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    r = F.array(*[geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in ring])
    return df.where(F.col(lng).between(min(xs), max(xs)) & F.col(lat).between(min(ys), max(ys)) & geo.point_in_ring(F.col(lng), F.col(lat), r))


def distance_join(left: DataFrame, right: DataFrame, metres: float, left_xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] = ("x", "y"), max_latitude: float = 85.0) -> DataFrame:
    """Pairs of left and right points within metres, with `distance`: right points enter the nine cells around theirs.

    Columns must differ by name. Cells are as wide as the distance at max_latitude, beyond which rows are
    refused, so no pair is lost; cells go on from longitude 180 at -180. A pair is found once.
    """
    dy = math.degrees(metres / geo.EARTH) * 1.000001
    around = max(1, math.floor(360 * math.cos(math.radians(max_latitude)) / dy))  # whole cells about the earth
    dx = 360 / around

    def cells(lng: str, lat: str) -> tuple[Column, Column]:
        ok = F.when(F.abs(F.col(lat)) <= max_latitude, F.col(lat)).otherwise(F.raise_error(F.lit("latitude out of range")).cast("double"))
        return F.pmod(F.floor(F.col(lng) / dx), F.lit(around)), F.floor(ok / dy)

    (ax, ay), (bx, by) = cells(*left_xy), cells(*right_xy)
    l = left.withColumn("__cx", ax).withColumn("__cy", ay)
    r = right.withColumn("__cx", F.explode(F.array_distinct(F.transform(F.sequence(bx - 1, bx + 1), lambda c: F.pmod(c, F.lit(around)))))).withColumn("__cy", F.explode(F.sequence(by - 1, by + 1)))
    d = geo.haversine(F.col(left_xy[0]), F.col(left_xy[1]), F.col(right_xy[0]), F.col(right_xy[1]))
    return l.join(r, ["__cx", "__cy"]).withColumn("distance", d).where(F.col("distance") <= metres).drop("__cx", "__cy")


def polygon_join(points: DataFrame, polygons: DataFrame, lng: str, lat: str, ring: str, cell: float = 1.0) -> DataFrame:
    """Points with the polygons (a ring column) that hold them: polygons enter the cells of their boxes."""
    e = geo.envelope(F.col(ring))
    p = polygons.withColumn("__e", e)
    p = p.withColumn("__cx", F.explode(F.sequence(F.floor(F.col("__e.min_x") / cell), F.floor(F.col("__e.max_x") / cell))))
    p = p.withColumn("__cy", F.explode(F.sequence(F.floor(F.col("__e.min_y") / cell), F.floor(F.col("__e.max_y") / cell)))).drop("__e")
    l = points.withColumn("__cx", F.floor(F.col(lng) / cell)).withColumn("__cy", F.floor(F.col(lat) / cell))
    return l.join(p, ["__cx", "__cy"]).where(geo.point_in_ring(F.col(lng), F.col(lat), F.col(ring))).drop("__cx", "__cy")

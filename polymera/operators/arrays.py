"""Sparse multi-dimensional arrays as long tables of dimensions and attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ArraySchema:
    """Dimensions with their closed bounds and tile extents, and attributes."""

    dims: tuple[str, ...]
    attrs: tuple[str, ...]
    bounds: tuple[tuple[int, int], ...] = ()
    extents: tuple[int, ...] = ()


def insert_cells(array: DataFrame, cells: DataFrame, schema: ArraySchema, system: int) -> DataFrame:
    """The array's versions and new ones of these cells; a cell outside the bounds is an error."""
    for d, (lo, hi) in zip(schema.dims, schema.bounds):
        cells = cells.withColumn(d, F.when(F.col(d).between(lo, hi), F.col(d)).otherwise(F.raise_error(F.concat(F.lit(f"{d} out of bounds: "), F.col(d).cast("string"))).cast("long")))
    return array.unionByName(cells.withColumns({"_sys_from": F.lit(system).cast("long"), "_live": F.lit(True)}))


def delete_cells(array: DataFrame, coordinates: DataFrame, schema: ArraySchema, system: int) -> DataFrame:
    """The array's versions and tombstones of these coordinates."""
    marks = {"_sys_from": F.lit(system).cast("long"), "_live": F.lit(False)}
    empty = {a: F.lit(None).cast(array.schema[a].dataType) for a in schema.attrs}
    return array.unionByName(coordinates.select(*schema.dims).withColumns(empty | marks))


def live_cells(array: DataFrame, schema: ArraySchema, as_of: int | None = None) -> DataFrame:
    """Each coordinate's newest version by a system time, unless it is a tombstone."""
    seen = array if as_of is None else array.where(F.col("_sys_from") <= as_of)
    w = Window.partitionBy(*schema.dims).orderBy(F.col("_sys_from").desc())
    return seen.withColumn("__n", F.row_number().over(w)).where("__n = 1 AND _live").select(*schema.dims, *schema.attrs)


def array_slice(cells: DataFrame, ranges: Mapping[str, tuple | None], attrs: Sequence[str] | None = None, dims: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Cells inside closed ranges (None: all), with some attributes."""
    for d, r in ranges.items():
        if r is not None:
            cells = cells.where(F.col(d).between(*r))
    cells = cells if attrs is None else cells.select(*dims, *attrs)
    return cells if limit is None else cells.limit(limit)


def array_project(cells: DataFrame, dims: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    return cells.select(*dims, *attrs)


def array_agg(cells: DataFrame, attr: str, how: str, group_dim: str | None = None) -> DataFrame:
    """SUM, COUNT, MIN, MAX or MEAN of an attribute, over all cells or by a dimension."""
    forms = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "mean": F.avg}
    made = forms[how.lower()](attr).alias("value")
    return cells.groupBy(group_dim).agg(made) if group_dim else cells.agg(made)


def array_elementwise(a: DataFrame, b: DataFrame, dims: Sequence[str], attr: str, op: str) -> DataFrame:
    """a op b by coordinate over the cells of either; a missing side or a division by 0 gives null."""
    j = a.select(*dims, F.col(attr).alias("__a")).join(b.select(*dims, F.col(attr).alias("__b")), list(dims), "full_outer")
    x, y = F.col("__a"), F.col("__b")
    forms = {"+": x + y, "-": x - y, "*": x * y, "/": F.when(y != 0, x / y)}
    return j.select(*dims, forms[op].alias(attr))


def tile_id(cells: DataFrame, dims: Sequence[str], extents: Sequence[int]) -> DataFrame:
    """Cells with their tile along each dimension; rechunking is this with new extents."""
    return cells.withColumns({f"tile_{d}": F.floor(F.col(d) / e).cast("long") for d, e in zip(dims, extents)})


def z_order(cells: DataFrame, dims: Sequence[str], bits: int = 16) -> DataFrame:
    """Cells with the interleaved bits of their coordinates, in which near cells stand near."""
    z = F.lit(0).cast("long")
    for b in range(bits):
        for i, d in enumerate(dims):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(F.col(d).cast("long"), b).bitwiseAND(F.lit(1)), b * len(dims) + i))
    return cells.withColumn("z", z)


def compact(array: DataFrame, schema: ArraySchema, path: str) -> None:
    """Write the live cells laid out by tile."""
    tiled = tile_id(live_cells(array, schema), schema.dims, schema.extents)
    tiles = [f"tile_{d}" for d in schema.dims]
    tiled.repartitionByRange(*tiles).sortWithinPartitions(*tiles, *schema.dims).drop(*tiles).write.mode("overwrite").parquet(path)


def array_flush() -> dict[str, bool]:
    """Nothing is staged: writes are whole tables."""
    return {"result": True}

"""Window functions and frames that Spark lacks or defines otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ntile(n: int, partition_by: Sequence[str], order_by: Sequence[Column | str]) -> Column:
    """floor(position * n / rows) + 1: buckets may differ from SQL's NTILE in where the longer ones stand."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return (F.floor((F.row_number().over(w) - 1) * n / F.count(F.lit(1)).over(Window.partitionBy(*partition_by))) + 1).cast("int")


def groups_frame(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column | str], start: int, end: int, **aggregates: Column) -> DataFrame:
    """Aggregates over a GROUPS frame: the groups of peers from start to end around the row's own."""
    ranked = df.withColumn("__group", F.dense_rank().over(Window.partitionBy(*partition_by).orderBy(*order_by)))
    w = Window.partitionBy(*partition_by).orderBy("__group").rangeBetween(start, end)
    return ranked.withColumns({name: a.over(w) for name, a in aggregates.items()}).drop("__group")


def running(partition_by: Sequence[str], order_by: Sequence[Column | str]) -> WindowSpec:
    """The default frame: from the partition's start to the row's last peer."""
    return Window.partitionBy(*partition_by).orderBy(*order_by).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def nth_value(x: Column, n: int, partition_by: Sequence[str], order_by: Sequence[Column | str]) -> Column:
    """Null until the row's position reaches n."""
    return F.nth_value(x, n).over(Window.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def check_frame(mode: str, order_keys: int, start: int | None, end: int | None) -> None:
    """Refuse GROUPS without an order, and RANGE with offsets unless exactly one key orders."""
    if mode == "groups" and not order_keys:
        raise ValueError("GROUPS needs ORDER BY")
    if mode == "range" and order_keys != 1 and (start or end):
        raise ValueError("RANGE with an offset needs exactly one ORDER BY key")


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """LATEST ON: the last row of each key in this order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() if isinstance(c, Column) else F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def limit_rows(df: DataFrame, limit, offset=0) -> DataFrame:
    """LIMIT and OFFSET, refusing what is not a count (2201W)."""
    for n in (limit, offset):
        if isinstance(n, bool) or not isinstance(n, int) or not 0 <= n < 1 << 31:
            raise ValueError(f"2201W: {n!r} is not a row count")
    return df.offset(offset).limit(limit)

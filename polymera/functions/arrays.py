"""Array functions with the engine's rules for nulls and absent values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_length(a: Column) -> Column:
    """Elements; null for null. cardinality means the same."""
    return F.when(a.isNotNull(), F.size(a))


def array_append(a: Column, v: Column) -> Column:
    return F.array_append(a, v)


def array_prepend(v: Column, a: Column) -> Column:
    """The value comes first, the array second."""
    return F.array_prepend(a, v)


def array_remove(a: Column, v: Column) -> Column:
    """Without all equal elements; a null value removes nulls."""
    return F.filter(a, lambda x: ~x.eqNullSafe(v))


def array_concat(a: Column, b: Column) -> Column:
    """Both in order; a null right side adds nothing. array_cat means the same."""
    return F.when(b.isNull(), a).otherwise(F.concat(a, b))


def array_distinct(a: Column) -> Column:
    return F.array_distinct(a)


def array_contains(a: Column, v: Column) -> Column:
    """False, not null, for a null array; a null value finds nulls."""
    return F.coalesce(F.exists(a, lambda x: x.eqNullSafe(v)), F.lit(False))


def array_position(a: Column, v: Column) -> Column:
    """1-based place of the first equal element; null when there is none."""
    return F.nullif(F.array_position(a, v), F.lit(0))


def array_reverse(a: Column) -> Column:
    return F.reverse(a)


def array_contains_all(a: Column, b: Column) -> Column:
    return F.forall(b, lambda x: array_contains(a, x))


def array_overlap(a: Column, b: Column) -> Column:
    return F.exists(b, lambda x: array_contains(a, x))

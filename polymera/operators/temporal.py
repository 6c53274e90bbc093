"""Bitemporal tables: system and valid time, read as of either."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a versioned table beside its own; deleted marks a tombstone.
SYSTEM, VALID_FROM, VALID_UNTIL, DELETED = "_sys_from", "_valid_from", "_valid_until", "_deleted"


def as_of(versions: DataFrame, keys: Sequence[str], system: int | None = None, valid: int | None = None, keep_versions: bool = False) -> DataFrame:
    """The rows as the system knew them at `system` (None: now), valid at `valid` (None: whenever).

    Of each key's versions written by then, the newest decides; a tombstone hides the key.
    """
    seen = versions if system is None else versions.where(F.col(SYSTEM) <= system)
    if valid is not None:
        seen = seen.where((F.coalesce(F.col(VALID_FROM), F.lit(-(1 << 63))) <= valid) & (F.coalesce(F.col(VALID_UNTIL), F.lit((1 << 63) - 1)) > valid))
    w = Window.partitionBy(*keys).orderBy(F.col(SYSTEM).desc())
    live = seen.withColumn("__n", F.row_number().over(w)).where(f"__n = 1 AND NOT coalesce({DELETED}, false)").drop("__n")
    return live if keep_versions else live.drop(SYSTEM, VALID_FROM, VALID_UNTIL, DELETED)


def history(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every version with the system time that ended it (null: current)."""
    w = Window.partitionBy(*keys).orderBy(SYSTEM)
    return versions.withColumn("_sys_until", F.lead(SYSTEM).over(w))


def write_version(versions: DataFrame, rows: DataFrame, system: int, valid_from: int | None = None, valid_until: int | None = None, deleted: bool = False) -> DataFrame:
    """The versions and new ones of these rows."""
    new = rows.withColumns({SYSTEM: F.lit(system).cast("long"), VALID_FROM: F.lit(valid_from).cast("long"), VALID_UNTIL: F.lit(valid_until).cast("long"), DELETED: F.lit(deleted)})
    return versions.unionByName(new)


def purge(versions: DataFrame, keys: Sequence[str], before: int) -> DataFrame:
    """Without versions that ended before a system time; the newest of each key always stays."""
    return history(versions, keys).where(f"_sys_until IS NULL OR _sys_until >= {int(before)}").drop("_sys_until")

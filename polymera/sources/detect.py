"""Finding a table's time column: by type, then name, then values that look like epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names a time column may have.
NAMES = ("timestamp", "time", "ts", "datetime", "date", "created_at", "event_time", "_time")
#: Least values of epochs in seconds, milliseconds, microseconds and nanoseconds (2001), each over a thousandfold.
EPOCHS = {
    "s": 10**9,
    "ms": 10**12,
    "us": 10**15,
    "ns": 10**18,
}


def time_column(df: DataFrame, sample: int = 1_000) -> tuple[str, str] | None:
    """(column, how): 'type', 'name' or the epoch's unit; None if no column will do. Only the last way reads rows."""
    timed = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType)]
    if timed:
        return timed[0], "type"
    named = [c for n in NAMES for c in df.columns if c.lower() == n]
    if named:
        return named[0], "name"
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.LongType | T.DoubleType)]
    rows = df.select(*numbers).limit(sample).agg(*[F.min(c).alias(f"{c}_lo") for c in numbers], *[F.max(c).alias(f"{c}_hi") for c in numbers]).first() if numbers else None
    for c in numbers:
        lo, hi = rows[f"{c}_lo"], rows[f"{c}_hi"]
        for unit, least in EPOCHS.items():
            if lo is not None and least <= lo and hi < least * 10:
                return c, unit
    return None

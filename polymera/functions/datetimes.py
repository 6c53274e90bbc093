"""Time functions: durations written as text, buckets from the epoch, exact decimals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of the duration units.
UNITS_MS = {
    "ms": 1,
    "s": 1_000,
    "m": 60_000,
    "h": 3_600_000,
    "d": 86_400_000,
    "w": 604_800_000,
}
_NAMES = {"milli": "ms", "sec": "s", "min": "m", "hour": "h", "hr": "h", "day": "d", "week": "w"}


def interval_ms(text: str) -> int:
    """Milliseconds of '5m', '1h30m', '15 minutes', "INTERVAL '1 day'"; several parts add up."""
    inner = re.sub(r"(?i)^\s*interval\s*", "", text.strip()).strip("' ")
    found = re.findall(r"(\d+)\s*([A-Za-z]+)", inner)
    if not found or re.sub(r"(\d+)\s*([A-Za-z]+)", "", inner).strip():
        raise ValueError(f"not a duration: {text!r}")
    total = 0
    for number, unit in found:
        u = unit.lower()
        u = u if u in UNITS_MS else next((short for name, short in _NAMES.items() if u.startswith(name)), None)
        if u is None:
            raise ValueError(f"unknown unit {unit!r} in {text!r}")
        total += int(number) * UNITS_MS[u]
    return total


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp (with or without zone)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def time_bucket(interval: str | int, ts: Column) -> Column:
    """Start, in epoch milliseconds, of the bucket from the epoch that holds a timestamp."""
    width = interval if isinstance(interval, int) else interval_ms(interval)
    return (F.floor(epoch_ms(ts) / width) * width).cast("long")


def bucket_start(interval: str | int, ts: Column) -> Column:
    """time_bucket as a timestamp."""
    return F.timestamp_millis(time_bucket(interval, ts))


def datetime(text: Column) -> Column:
    """Timestamp of a text, null if it is none; to_datetime means the same."""
    return F.try_to_timestamp(text)


def unix_secs(ts: Column) -> Column:
    return F.floor(epoch_ms(ts) / 1000).cast("long")


def unix_millis(ts: Column) -> Column:
    return epoch_ms(ts)


def extract(part: str, ts: Column) -> Column:
    return F.date_part(F.lit(part), ts)


def date_trunc(part: str, ts: Column) -> Column:
    return F.date_trunc(part, ts)


def date_add(ts: Column, duration: str) -> Column:
    """Timestamp plus a duration, not days."""
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + interval_ms(duration) * 1000)


def date_sub(ts: Column, duration: str) -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) - interval_ms(duration) * 1000)


def date_diff(a: Column, b: Column) -> Column:
    """Microseconds from b to a."""
    return F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))


def decimal(x: Column, scale: int = 9) -> Column:
    """Exact decimal of 38 digits."""
    return x.cast(f"decimal(38,{scale})")

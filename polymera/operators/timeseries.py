"""Time-series kernels over rows of (series keys, time, value), all as window expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def series(keys: Sequence[str], ts: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def rate(value: Column, seconds: Column, w: WindowSpec) -> Column:
    """Per-second rate of a counter: a fall means it began again at 0; the first row and steps of no time are null."""
    before, dt = F.lag(value).over(w), seconds - F.lag(seconds).over(w)
    return F.when(dt > 0, F.when(value >= before, value - before).otherwise(value) / dt)


def derivative(value: Column, seconds: Column, w: WindowSpec) -> Column:
    """Per-second slope, falls included."""
    dt = seconds - F.lag(seconds).over(w)
    return F.when(dt > 0, (value - F.lag(value).over(w)) / dt)


def delta(value: Column, w: WindowSpec) -> Column:
    return value - F.lag(value).over(w)


def _rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def _full(x: Column, w: WindowSpec, n: int) -> Column:
    return F.when(F.count(F.lit(1)).over(_rows(w, n)) >= n, x)


def moving_avg(value: Column, n: int, w: WindowSpec) -> Column:
    """Mean of the last n rows; null until there are n."""
    return _full(F.avg(value).over(_rows(w, n)), w, n)


def moving_percentile(value: Column, n: int, p: float, w: WindowSpec) -> Column:
    return _full(F.percentile(value, F.lit(p)).over(_rows(w, n)), w, n)


def zscore(value: Column, n: int, w: WindowSpec) -> Column:
    """Against the last n rows; 0 when they do not vary."""
    mean, spread = F.avg(value).over(_rows(w, n)), F.stddev_pop(value).over(_rows(w, n))
    return _full(F.when(spread == 0, 0.0).otherwise((value - mean) / spread), w, n)


def bollinger(value: Column, n: int, k: float, w: WindowSpec) -> dict[str, Column]:
    """mid, upper, lower and width: mean, mean +- k population deviations, and their distance over the mean."""
    mean, spread = moving_avg(value, n, w), F.stddev_pop(value).over(_rows(w, n))
    return {"mid": mean, "upper": mean + k * spread, "lower": mean - k * spread, "width": 2 * k * spread / mean}


def stddev(value: Column) -> Column:
    """Population deviation; null under two rows."""
    return F.when(F.count(value) >= 2, F.stddev_pop(value))


def correlate(a: Column, b: Column) -> Column:
    return F.corr(a, b)


def percentile(value: Column, p: float) -> Column:
    """Exact with linear interpolation; NaN is skipped."""
    return F.percentile(F.when(~F.isnan(value.cast("double")), value), F.lit(p))


def ema(df: DataFrame, keys: Sequence[str], ts: str, value: str, alpha: float, out: str = "ema") -> DataFrame:
    """Append e = alpha v + (1 - alpha) e_before, e = v at first; a null value keeps the one before.

    A series is a recurrence over all its rows, so each series is one group of one task.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        return pdf.assign(**{out: pdf[value].astype(float).ewm(alpha=alpha, adjust=False, ignore_na=True).mean()})

    schema = df.select("*", F.lit(0.0).cast("double").alias(out)).schema
    for f in schema:
        f.nullable = True
    return df.groupBy(*keys).applyInPandas(run, schema)


def interpolate(value: Column, seconds: Column, w: WindowSpec, method: str = "linear") -> Column:
    """Nulls replaced: linear between the known neighbours and flat beyond them, prev, next or zero."""
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(value.isNotNull(), F.struct(seconds.alias("t"), value.cast("double").alias("v")))
    a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    line = F.when(b["t"] == a["t"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (seconds - a["t"]) / (b["t"] - a["t"]))
    forms = {"linear": F.coalesce(line, a["v"], b["v"]), "prev": a["v"], "next": b["v"], "zero": F.lit(0.0)}
    return F.coalesce(value.cast("double"), forms[method])


def generate_buckets(df: DataFrame, start: int, end: int, width: int, keys: Sequence[str] = (), bucket: str = "bucket") -> DataFrame:
    """Every bucket start in [start, end) for each different key of df."""
    first = (start // width) * width
    numbers = F.sequence(F.lit(first).cast("long"), F.lit(end - 1).cast("long"), F.lit(width).cast("long")) if end > first else F.array().cast("array<bigint>")
    base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    return base.select(*keys, F.explode(numbers).alias(bucket))


def gap_fill(buckets: DataFrame, start: int, end: int, width: int, values: Sequence[str], fill: str | float | None = None, keys: Sequence[str] = (), bucket: str = "bucket") -> DataFrame:
    """Buckets of each key made complete over [start, end); missing values are null, 'prev', 'linear' or a literal.

    linear leaves leading and trailing gaps null; prev leaves leading ones null.
    """
    full = generate_buckets(buckets, start, end, width, keys, bucket).join(buckets, [*keys, bucket], "left")
    w = Window.partitionBy(*keys).orderBy(bucket)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = {}
    for v in values:
        if fill is None:
            continue
        if fill == "prev":
            out[v] = F.last(v, ignorenulls=True).over(back)
        elif fill == "linear":
            known = F.when(F.col(v).isNotNull(), F.struct(F.col(bucket).alias("t"), F.col(v).cast("double").alias("v")))
            a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
            out[v] = F.coalesce(F.col(v).cast("double"), a["v"] + (b["v"] - a["v"]) * (F.col(bucket) - a["t"]) / (b["t"] - a["t"]))
        else:
            out[v] = F.coalesce(F.col(v), F.lit(fill))
    return full.withColumns(out) if out else full


def last_values(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """The newest time and value of each series."""
    return df.groupBy(*keys).agg(F.max(ts).alias(ts), F.max_by(value, F.struct(ts, value)).alias(value))


def tag_values(df: DataFrame, tag: str) -> DataFrame:
    return df.select(tag).where(F.col(tag).isNotNull()).distinct()


def retain(df: DataFrame, ts_ms: Column, now_ms: int, period_ms: int) -> DataFrame:
    """Rows not older than the period."""
    return df.where(ts_ms >= now_ms - period_ms)


def downsample(df: DataFrame, ts_ms: Column, width: int, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates by time bucket and keys."""
    return df.groupBy((F.floor(ts_ms / width) * width).cast("long").alias("bucket"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def sorted_copy(df: DataFrame, path: str, tag: str, ts: str) -> None:
    """A copy of the rows laid out by (tag, ts), for scans of one tag's history."""
    df.repartitionByRange(tag, ts).sortWithinPartitions(tag, ts).write.mode("overwrite").parquet(path)

"""Aggregates: the engine's own results for sums, strings and sketches, and facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """sum is always a double."""
    return F.sum(x.cast("double"))


def percentile_cont(x: Column, p: float = 0.5) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(x, F.lit(p))


def percentiles(df: DataFrame, keys: Sequence[str], column: str, ps: Sequence[float], slices: int = 512) -> DataFrame:
    """(keys, p, value): percentile_cont of each group, exact, for groups that fit no task.

    Rows are counted by group and slice of the whole column's range of values; only the slice that holds
    a rank is sorted. Null values take no part.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("__v"))
    edges = sorted(set(rows.approxQuantile("__v", [i / slices for i in range(1, slices)], 0.0005)))
    rows = rows.withColumn("__s", F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < F.col("__v"))))
    counts = rows.groupBy(*keys, "__s").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    wanted = counts.withColumn("p", F.explode(F.array(*map(F.lit, ps)))).withColumn("__at", F.col("p") * (F.col("__all") - 1))
    low, high = F.floor("__at"), F.ceil("__at")
    wanted = wanted.withColumn("__rank", F.explode(F.array_distinct(F.array(low, high))))
    wanted = wanted.where((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__n")))
    picked = wanted.groupBy(*keys, "__s").agg(F.first("__before").alias("__before"), F.collect_list(F.struct("p", "__at", "__rank")).alias("__want"))
    slots = rows.join(picked, [*keys, "__s"])
    order = Window.partitionBy(*keys, "__s").orderBy("__v")
    ranked = slots.withColumn("__r", F.col("__before") + F.row_number().over(order) - 1)
    found = ranked.select(*keys, "__v", F.explode(F.filter("__want", lambda w: w["__rank"] == F.col("__r"))).alias("w"))
    share = F.col("w.__at") - F.floor("w.__at")
    part = F.when(F.col("w.__rank") == F.floor("w.__at"), (1 - share) * F.col("__v")).otherwise(share * F.col("__v"))
    return found.groupBy(*keys, F.col("w.p").alias("p")).agg(F.sum(part).alias("value"))


def string_agg(x: Column, order: Column | None = None) -> Column:
    """Non-null texts joined by commas, in a stated order or their own."""
    pairs = F.collect_list(F.when(x.isNotNull(), F.struct((x if order is None else order).alias("o"), x.cast("string").alias("v"))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["v"]), ",")


def approx_count_distinct(x: Column) -> Column:
    return F.approx_count_distinct(x, 0.008)


def approx_percentile(x: Column, p: float, accuracy: int = 10_000) -> Column:
    return F.approx_percentile(x, F.lit(p), F.lit(accuracy))


def approx_top_k(column: str, k: int = 10) -> Column:
    """Array of (item, count) of about the most frequent values."""
    return F.expr(f"approx_top_k(`{column}`, {int(k)})")


def count_min_sketch(x: Column, error: float = 0.001, confidence: float = 0.99, seed: int = 1) -> Column:
    return F.count_min_sketch(x, F.lit(error), F.lit(confidence), F.lit(seed))


def top_k_exact(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties to the smaller."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(k)


def facets(df: DataFrame, fields: Sequence[str], limit: int | None = None) -> DataFrame:
    """(field, value, count) of several fields in one pass, most frequent first; `limit` values of each."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("count"))
    if limit is None:
        return counts
    w = Window.partitionBy("field").orderBy(F.desc("count"), F.col("value").asc_nulls_last())
    return counts.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates by several sets of keys at once; absent keys are null, and grouping_<key> tells them from null values."""

    marks = [F.grouping(k).alias(f"grouping_{k}") for k in keys]
    return df.groupingSets([[df[c] for c in s] for s in sets], *[df[c] for c in keys]).agg(*[a.alias(n) for n, a in aggregates.items()], *marks)


def salted_sum(df: DataFrame, keys: Sequence[str], value: str, salts: int = 64) -> DataFrame:
    """Sum by key in two steps, for plans in which a partial sum cannot be taken before the shuffle."""
    first = df.groupBy(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(salts)).alias("__salt")).agg(F.sum(value).alias("__s"))
    return first.groupBy(*keys).agg(F.sum("__s").alias(value))

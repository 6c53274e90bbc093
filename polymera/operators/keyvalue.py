"""Key-value tables: expiry, scans by pattern, counters and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(df: DataFrame, now_ms: int, expire_at: str = "expire_at") -> DataFrame:
    """Entries without an expiry or with one still to come."""
    return df.where(F.col(expire_at).isNull() | (F.col(expire_at) > now_ms))


def with_ttl(df: DataFrame, written_ms: Column, ttl_ms: int) -> DataFrame:
    return df.withColumn("expire_at", written_ms + ttl_ms)


def get(df: DataFrame, key, column: str = "key") -> DataFrame:
    return df.where(F.col(column) == key)


def scan(df: DataFrame, glob: str = "*", column: str = "key") -> DataFrame:
    """Keys that match a pattern of * and ?."""
    like = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return df.where(F.col(column).like(like))


def increments(df: DataFrame, column: str = "key", by: str = "by") -> DataFrame:
    """Final counters of a log of increments."""
    return df.groupBy(column).agg(F.sum(by).alias("value"))


def window_start(kind: str, ts: Column) -> Column:
    """Start of the daily, weekly (Monday) or monthly window that holds a time."""
    return F.date_trunc({"daily": "day", "weekly": "week", "monthly": "month"}[kind], ts)


def leaderboard(scores: DataFrame, key: str, score: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Entries with their rank: greater scores first, ties by key."""
    w = Window.partitionBy(*partition_by).orderBy(F.col(score).desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(w))


def top(scores: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The first k without ranking the rest."""
    return leaderboard(scores.orderBy(F.col(score).desc(), F.col(key)).limit(k), key, score)


def rank_of(scores: DataFrame, key: str, score: str, who) -> DataFrame:
    """An entry's rank, counted and not sorted."""
    mine = scores.where(F.col(key) == who).select(F.col(score).alias("__s"), F.col(key).alias("__k"))
    ahead = scores.join(F.broadcast(mine), (F.col(score) > F.col("__s")) | ((F.col(score) == F.col("__s")) & (F.col(key) < F.col("__k"))))
    return ahead.agg((F.count("*") + 1).alias("rank"))


def score_range(scores: DataFrame, score: str, low, high) -> DataFrame:
    return scores.where(F.col(score).between(low, high))

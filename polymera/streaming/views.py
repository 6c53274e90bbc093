"""Streaming materialized views and continuous aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Aggregates of views by name.
VIEW_AGGREGATES = {
    "count": lambda c: F.count(c) if c else F.count("*"),
    "sum": lambda c: F.sum(F.col(c).cast("double")),
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
}


def materialized_view(stream: DataFrame, group_by: Sequence[str], aggregates: dict[str, tuple[str, str | None]], where: Column | None = None) -> DataFrame:
    """GROUP BY with COUNT, SUM, MIN, MAX and AVG, as out name -> (aggregate, column); batch or streaming."""
    rows = stream if where is None else stream.where(where)
    return rows.groupBy(*group_by).agg(*[VIEW_AGGREGATES[how](c).alias(name) for name, (how, c) in aggregates.items()])


def continuous_aggregate(stream: DataFrame, ts: str, bucket: str, group_by: Sequence[str] = (), watermark: str | None = None, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by time bucket (tumbling, or sliding if slide is given) and keys; final once the watermark passes a bucket.

    first and last are min_by and max_by of the time; sketches and distinct counts are approximate ones in streams.
    """
    rows = stream.withWatermark(ts, watermark) if watermark else stream
    window = F.window(ts, bucket, slide) if slide else F.window(ts, bucket)
    out = rows.groupBy(window.alias("w"), *group_by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("w.start").alias("bucket"), *group_by, *aggregates)


def sessions(stream: DataFrame, ts: str, gap: str, group_by: Sequence[str], watermark: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by sessions that end after a gap without rows."""
    rows = stream.withWatermark(ts, watermark) if watermark else stream
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *group_by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *group_by, *aggregates)


#: Triggers of the refresh policies.
REFRESH = {
    "on_flush": {},
    "on_seal": {"availableNow": True},
    "manual": {"availableNow": True},
}


def refresh(view: DataFrame, path: str, checkpoint: str, policy: str = "manual", every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Start writing a view as Parquet; 'periodic' takes `every`. The checkpoint folder keeps its state across restarts."""
    trigger = {"processingTime": every} if policy == "periodic" else REFRESH[policy]
    writer = view.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def live_select(stream: DataFrame, on_rows, checkpoint: str | None = None) -> StreamingQuery:
    """Call on_rows(DataFrame, batch number) with each batch of new rows."""
    writer = stream.writeStream.foreachBatch(on_rows)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()

"""Queries of streaming operators, run to the end of the events table, and of line protocol and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polymera.sources import lines
from polymera.plans.base import Tables, query
from polymera.storage import new_folder
from polymera.streaming import alerts, changes, views


def _stream(t: Tables) -> DataFrame:
    schema = t.events.schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(t: Tables, view: DataFrame, mode: str) -> DataFrame:
    """The result of a streaming query that has read all there is."""
    name = f"drained_{uuid.uuid4().hex}"
    writer = view.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", new_folder(t.spark, "stream"))
    started = writer.trigger(availableNow=True).start()
    started.awaitTermination()
    return t.spark.table(name)


@query("streaming_mv", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events WHERE value > 1 GROUP BY 1")
def streaming_mv(t: Tables):
    aggregates = {"n": ("count", None), "total": ("sum", "value"), "mean": ("avg", "value"), "lo": ("min", "value"), "hi": ("max", "value")}
    out = _drained(t, views.materialized_view(_stream(t), ["event_type"], aggregates, F.col("value") > 1), "complete")
    return out.select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "lo", "hi")


@query("continuous_aggregate", "SELECT (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def continuous_aggregate(t: Tables):
    view = views.continuous_aggregate(_stream(t), "ts", "1 hour", ["event_type"], n=F.count("*"), total=F.sum("value"))
    out = _drained(t, view, "complete")
    return out.select(F.unix_seconds("bucket").alias("bucket"), "event_type", "n", F.round("total", 4).alias("total"))


@query("session_windows", """SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_windows(t: Tables):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return views.sessions(rows, "ts", "2 hours", ["user_id"], n=F.count("*")).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("cdc_compaction", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def cdc_compaction(t: Tables):
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"))
    return changes.compacted(rows, ["user_id"], "event_id").select("user_id", "event_id")


@query("alert_rules", """WITH w AS (SELECT event_type, (epoch_us(ts) // 3600000000)::BIGINT AS bucket, avg(value) > 50 AS breach FROM events GROUP BY 1, 2),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY bucket) AS run FROM (SELECT *, CASE WHEN breach = lag(breach) OVER (PARTITION BY event_type ORDER BY bucket) THEN 0 ELSE 1 END AS fresh FROM w)),
    n AS (SELECT *, row_number() OVER (PARTITION BY event_type, run ORDER BY bucket) AS n FROM r), m AS (SELECT * FROM n WHERE n = 2),
    c AS (SELECT *, lag(breach) OVER (PARTITION BY event_type ORDER BY bucket) AS before FROM m)
    SELECT event_type, bucket, CASE WHEN breach THEN 'fire' ELSE 'recover' END AS event FROM c WHERE breach <> coalesce(before, FALSE)""")
def alert_rules(t: Tables):
    hours = t.events.groupBy("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("long").alias("bucket")).agg(F.avg("value").alias("v"))
    return alerts.alert_events(alerts.breaches(hours, "v", ">", 50.0), ["event_type"], "bucket", 2, 2)


@query("line_protocol", "SELECT event_id, event_type, value FROM events")
def line_protocol(t: Tables):
    text = F.concat(F.lit("m,type="), F.col("event_type"), F.lit(" v="), F.col("value").cast("string"), F.lit(",id="), F.col("event_id").cast("string"), F.lit("i 1700000000000000000"))
    parsed = lines.parse_lines(t.events.select(text.alias("value")))
    field = lambda n, k: lines.field_value(F.col("fields"), n)[k]
    return parsed.select(field("id", "long").alias("event_id"), F.col("tags")["type"].alias("event_type"), field("v", "double").alias("value"))

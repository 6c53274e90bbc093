"""Queries of time-series kernels, as-of joins, PromQL and streaming results."""

from __future__ import annotations

from pyspark.sql import functions as F

from polymera.functions import datetimes
from polymera.operators import joins, promql, timeseries as ts
from polymera.plans.base import Tables, query

#: Seconds of an event, and rows of one series in order, as SQL.
_EVENTS = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS s, ts FROM events)"
_W = "(PARTITION BY user_id ORDER BY s, event_id)"


def _events(t: Tables):
    return t.events.select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), "ts")


def _series():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("s", "event_id")


@query("time_bucket", "SELECT (floor(epoch_us(ts) / 1000.0 / 3600000) * 3600000)::BIGINT AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1, 2")
def time_bucket(t: Tables):
    return t.events.groupBy(datetimes.time_bucket("1h", F.col("ts")).alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("v"))


@query("ts_rate", f"""SELECT event_id, round(CASE WHEN s - ps > 0 THEN (CASE WHEN value >= pv THEN value - pv ELSE value END) / (s - ps) END, 6) AS rate,
    round(CASE WHEN s - ps > 0 THEN (value - pv) / (s - ps) END, 6) AS derivative, round(value - pv, 6) AS delta FROM (SELECT *, lag(s) OVER {_W} AS ps, lag(value) OVER {_W} AS pv FROM {_EVENTS})""")
def ts_rate(t: Tables):
    w, v, s = _series(), F.col("value"), F.col("s")
    return _events(t).select("event_id", F.round(ts.rate(v, s, w), 6).alias("rate"), F.round(ts.derivative(v, s, w), 6).alias("derivative"), F.round(ts.delta(v, w), 6).alias("delta"))


_R = "(PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("ts_moving", f"""SELECT event_id, CASE WHEN n >= 5 THEN round(a, 6) END AS sma, CASE WHEN n >= 5 THEN round(p, 6) END AS median, CASE WHEN n >= 5 THEN round(CASE WHEN d = 0 THEN 0 ELSE (value - a) / d END, 5) END AS z
    FROM (SELECT *, count(*) OVER {_R} AS n, avg(value) OVER {_R} AS a, quantile_cont(value, 0.5) OVER {_R} AS p, stddev_pop(value) OVER {_R} AS d FROM {_EVENTS})""")
def ts_moving(t: Tables):
    w, v = _series(), F.col("value")
    return _events(t).select("event_id", F.round(ts.moving_avg(v, 5, w), 6).alias("sma"), F.round(ts.moving_percentile(v, 5, 0.5, w), 6).alias("median"), F.round(ts.zscore(v, 5, w), 5).alias("z"))


@query("ts_bollinger", f"SELECT event_id, CASE WHEN n >= 5 THEN round(a + 2 * d, 5) END AS upper, CASE WHEN n >= 5 THEN round(a - 2 * d, 5) END AS lower FROM (SELECT *, count(*) OVER {_R} AS n, avg(value) OVER {_R} AS a, stddev_pop(value) OVER {_R} AS d FROM {_EVENTS})")
def ts_bollinger(t: Tables):
    b = ts.bollinger(F.col("value"), 5, 2.0, _series())
    return _events(t).select("event_id", F.round(b["upper"], 5).alias("upper"), F.round(b["lower"], 5).alias("lower"))


@query("ts_ema", """WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT event_id, user_id, n, value AS e FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.user_id, o.n, 0.3 * o.value + 0.7 * r.e FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
    SELECT event_id, round(e, 6) AS ema FROM r""")
def ts_ema(t: Tables):
    rows = t.events.select("event_id", "user_id", "value", F.struct("ts", "event_id").alias("o")).withColumn("o", F.row_number().over(_by_time()))
    return ts.ema(rows, ["user_id"], "o", "value", 0.3).select("event_id", F.round("ema", 6).alias("ema"))


def _by_time():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("o")


@query("ts_aggregates", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_pop(value), 6) AS sd, round(corr(value, user_id), 6) AS r FROM events GROUP BY 1")
def ts_aggregates(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(ts.percentile(F.col("value"), 0.95), 6).alias("p95"), F.round(ts.stddev(F.col("value")), 6).alias("sd"), F.round(ts.correlate(F.col("value"), F.col("user_id").cast("double")), 6).alias("r"))


_HOURS = "(SELECT floor(epoch_us(ts) / 3.6e9)::BIGINT AS bucket, avg(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1)"


def _hours(t: Tables):
    return t.events.where("event_type = 'purchase'").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).cast("long").alias("bucket")).agg(F.avg("value").alias("v"))


@query("gap_fill_locf", f"""WITH h AS {_HOURS}, x AS (SELECT min(bucket) AS a, max(bucket) AS b FROM h), g AS (SELECT unnest(range(a - 3, b + 4)) AS bucket FROM x)
    SELECT bucket, round(last_value(v IGNORE NULLS) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING), 6) AS v FROM g LEFT JOIN h USING (bucket)""")
def gap_fill_locf(t: Tables):
    h = _hours(t)
    lo, hi = h.agg(F.min("bucket"), F.max("bucket")).first()
    return ts.gap_fill(h, lo - 3, hi + 4, 1, ["v"], "prev").select("bucket", F.round("v", 6).alias("v"))


@query("gap_fill_linear", f"""WITH h AS {_HOURS}, x AS (SELECT min(bucket) AS a, max(bucket) AS b FROM h), g AS (SELECT unnest(range(a - 3, b + 4)) AS bucket FROM x),
    j AS (SELECT g.bucket, v, CASE WHEN v IS NOT NULL THEN g.bucket END AS k FROM g LEFT JOIN h USING (bucket)),
    w AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS va, last_value(k IGNORE NULLS) OVER p AS ka, first_value(v IGNORE NULLS) OVER n AS vb, first_value(k IGNORE NULLS) OVER n AS kb FROM j
      WINDOW p AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING), n AS (ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT bucket, round(coalesce(v, va + (vb - va) * (bucket - ka) / (kb - ka)), 6) AS v FROM w""")
def gap_fill_linear(t: Tables):
    h = _hours(t)
    lo, hi = h.agg(F.min("bucket"), F.max("bucket")).first()
    return ts.gap_fill(h, lo - 3, hi + 4, 1, ["v"], "linear").select("bucket", F.round("v", 6).alias("v"))


@query("asof_join_keyed", """SELECT a.event_id, max_by(b.event_id, (b.s, b.event_id)) AS before FROM (SELECT *, epoch_us(ts) // 1000 AS s FROM events WHERE event_type = 'purchase') a
    LEFT JOIN (SELECT *, epoch_us(ts) // 1000 AS s FROM events WHERE event_type <> 'purchase') b ON a.user_id = b.user_id AND b.s <= a.s AND a.s - b.s <= 3600000 GROUP BY 1""")
def asof_join_keyed(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", datetimes.epoch_ms(F.col("ts")).alias("ms"))
    found = joins.asof_join(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'").drop("event_type"), "ms", "ms", ["user_id"], 3_600_000, order=["event_id"])
    return found.select("event_id", F.col("right_event_id").alias("before"))


@query("asof_join_bucketed", """SELECT a.event_id, max_by(b.event_id, (b.s, b.event_id)) AS before FROM (SELECT *, epoch_us(ts) // 1000 AS s FROM events WHERE event_type = 'purchase') a
    LEFT JOIN (SELECT *, epoch_us(ts) // 1000 AS s FROM events WHERE event_type <> 'purchase') b ON b.s <= a.s AND a.s - b.s <= 60000 GROUP BY 1""")
def asof_join_bucketed(t: Tables):
    e = t.events.select("event_id", "event_type", datetimes.epoch_ms(F.col("ts")).alias("ms"))
    found = joins.asof_join_bucketed(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'").drop("event_type"), "ms", "ms", 60_000)
    return found.select("event_id", F.col("right_event_id").alias("before"))


@query("last_value_cache", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_value_cache(t: Tables):
    return ts.last_values(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("tag_values", "SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL")
def tag_values(t: Tables):
    return ts.tag_values(t.events, "event_type")


@query("retention", "SELECT event_id FROM events WHERE epoch_us(ts) // 1000 >= (SELECT max(epoch_us(ts) // 1000) FROM events) - 86400000 * 5")
def retention(t: Tables):
    ms = datetimes.epoch_ms(F.col("ts"))
    now = t.events.agg(F.max(ms)).first()[0]
    return ts.retain(t.events, ms, now, 86_400_000 * 5).select("event_id")


@query("date_functions", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS secs, year(o_orderdate)::INT AS y, epoch(date_trunc('month', o_orderdate))::BIGINT AS month, epoch(o_orderdate + INTERVAL 90 MINUTE)::BIGINT AS later FROM orders")
def date_functions(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", datetimes.unix_secs(d).alias("secs"), datetimes.extract("year", d).cast("int").alias("y"), datetimes.unix_secs(datetimes.date_trunc("month", d)).alias("month"), datetimes.unix_secs(datetimes.date_add(d, "1h30m")).alias("later"))


_STEPS = "(SELECT unnest(range((SELECT min(epoch_us(ts) // 1000) FROM events), (SELECT min(epoch_us(ts) // 1000) FROM events) + 86400001, 21600000)) AS t)"


@query("promql_sum_over_time", f"""SELECT t, event_type, round(sum(value), 5) AS value FROM {_STEPS} CROSS JOIN (SELECT *, epoch_us(ts) // 1000 AS ms FROM events) WHERE ms > t - 10800000 AND ms <= t GROUP BY 1, 2""")
def promql_sum_over_time(t: Tables):
    samples = t.events.select(F.create_map(F.lit("event_type"), F.col("event_type")).alias("labels"), datetimes.epoch_ms(F.col("ts")).alias("ts"), "value").withColumn("name", F.lit("events"))
    start = samples.agg(F.min("ts")).first()[0]
    out = promql.evaluate("sum by (event_type) (sum_over_time(events[3h]))", samples, start, start + 86_400_000, 21_600_000)
    return out.select(F.col("ts").alias("t"), promql.label(F.col("labels"), "event_type").alias("event_type"), F.round("value", 5).alias("value"))

"""Streaming operators, replayed over the given tables and compared with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkflow.registry.aging import drift
from rinkflow.registry.core import register
from rinkflow.registry.sql import using
from rinkflow.session import fresh_path
from rinkflow.sources import roles
from rinkflow.streaming import online


def _replayed(df, name, operator):
    """The rows that an operator writes for a stream of ``df``: its version in the shared folder is the stream's source."""
    spark = df.sparkSession
    source = fresh_path(spark, name)
    df.write.parquet(source)
    target = fresh_path(spark, f"{name}-out")
    online.run_available(operator(spark.readStream.schema(df.schema).parquet(source)), target, fresh_path(spark, f"{name}-state"))
    return spark.read.parquet(target)


@register("online_context", """
SELECT event_id, user_id, event_type, lag(event_type, 1) OVER g AS prev_type, lag(event_type, 2) OVER g AS prev2_type, lag(value, 1) OVER g AS prev_value,
  count(*) FILTER (WHERE event_type = 'purchase') OVER d AS purchases_day, count(*) OVER d AS events_day
FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)
WINDOW g AS (PARTITION BY user_id ORDER BY event_id), d AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING)""", "prev_value", 4)
def online_context(spark, path):
    events = roles.table(spark, path, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events = events.withColumn("t", F.unix_seconds("ts"))
    lags = {"prev_type": ("event_type", 1), "prev2_type": ("event_type", 2), "prev_value": ("value", 1)}
    counts = {"purchases_day": (F.col("event_type") == "purchase", "t", -86_400, -1), "events_day": (F.lit(True), "t", -86_400, -1)}
    found = _replayed(events, "events", lambda s: online.online_context(s, ["user_id"], "event_id", "ts", lags, counts, tie="event_id", late="0 seconds"))
    return found.select("event_id", "user_id", "event_type", *lags, *counts)


@register("online_filter", using("filtered") + "SELECT goalie_id, season, mean AS kalman_talent, var * 1e6 AS variance_e6 FROM filtered", "kalman_talent variance_e6")
def online_filter(spark, path):
    small = drift(spark, path).withColumn("yearly_drift", F.col("yearly_drift") / 100)
    series = roles.series(spark, path).withColumn("started", F.make_timestamp(F.col("season").cast("int"), *[F.lit(v) for v in (1, 1, 0, 0, 0)]))
    found = _replayed(series, "series", lambda s: online.online_filter(s, small, "started", late="0 seconds")).where("final")
    return found.select("goalie_id", "season", "kalman_talent", (F.col("variance") * 1e6).alias("variance_e6"))

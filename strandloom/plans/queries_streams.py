"""The streaming extension's aggregates over the table read as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import sessions as st
from .registry import register
from .tables import table


@register("window_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windows(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.window_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("user_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.sessions(e, "1 day").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")

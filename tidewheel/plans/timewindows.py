"""Time windows over the stored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.columns import money
from tidewheel.operators.timewindows import sessions, sliding, tumbling
from tidewheel.plans.registry import query
from tidewheel.sources.tables import table

def one() -> Column:
    return F.lit(1).cast("bigint")


@query("""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start,
       CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL 1 HOUR AS window_end,
       event_type, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM events GROUP BY 1, 2, event_type
""")
def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    return tumbling(
        table(spark, folder, "events"),
        "ts",
        "1 hour",
        ["event_type"],
        {"n_events": one(), "total": money("value")},
    )


@query("""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) - to_hours(back) AS window_start,
       CAST(date_trunc('hour', ts) AS TIMESTAMP) - to_hours(back) + INTERVAL 6 HOUR AS window_end,
       event_type, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM events CROSS JOIN (SELECT unnest(range(6)) AS back)
WHERE ts IS NOT NULL OR back = 0
GROUP BY 1, 2, event_type
""")
def six_hour_events_every_hour(spark: SparkSession, folder: str) -> DataFrame:
    found = sliding(
        table(spark, folder, "events"),
        "ts",
        "6 hours",
        "1 hour",
        ["event_type"],
        {"n_events": one(), "total": money("value")},
    )
    return found.withColumn("total", F.col("total").cast("decimal(28,2)"))


@query("""
WITH marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST) AS session FROM marked)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM numbered GROUP BY user_id, session
""")
def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    found = sessions(
        table(spark, folder, "events"),
        ["user_id"],
        "ts",
        "6 hours",
        {"n_events": one(), "total": money("value")},
    )
    return found.withColumn("total", F.col("total").cast("decimal(28,2)"))

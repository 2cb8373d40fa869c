"""The event streams, run over the stored events to their present end.

A window, session or hour that is still open when the stream stops is not in
its result; the SQL leaves the same ones out. The watermark is one hour behind
the latest event.

Files may come in any order of time. The events are cut into slices of whole
hours, of about ``spark.tidewheel.streamBatchRows`` rows (50,000,000 unless set), which
are streamed one after the other: that bounds a micro-batch and the state held at
once. A table of one slice is streamed as it is.

Where files follow in time up to the hour, the setting
``spark.tidewheel.streamBatchBytes`` bounds the bytes of one micro-batch instead (at
least one file is taken), and the events are not written a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.plans.registry import query
from tidewheel.sources.tables import stream, stream_of, table
from tidewheel.streaming import events as streams
from tidewheel.streaming.runs import run_slices, run_to_files, stream_session, time_slices

DELAY = "1 hour"
BATCH_CONF = "spark.tidewheel.streamBatchBytes"
ROWS_CONF = "spark.tidewheel.streamBatchRows"
BATCH_ROWS = 50_000_000


def _run(
    spark: SparkSession, folder: str, name: str, build: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    own = stream_session(spark)
    bound = spark.conf.get(BATCH_CONF, None)
    if not bound:
        depth = int(spark.conf.get(ROWS_CONF, str(BATCH_ROWS)))
        slices = time_slices(table(spark, folder, "events"), "ts", depth, name)
        if slices:
            return run_slices(slices, lambda path: stream_of(own, path, "events"), build, name, spark)
    events = stream(own, folder, "events", bytes_per_batch=int(bound) if bound else None)
    return run_to_files(build(events), name, spark)


@query("""
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       event_type, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
GROUP BY 1, 2, event_type
""")
def stream_daily_events(spark: SparkSession, folder: str) -> DataFrame:
    return _run(
        spark, folder, "daily_events", lambda events: streams.closed_windows(events, "1 day", DELAY)
    )


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_events_without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    # The same events delivered twice, as by a source that sends at least once.
    return _run(
        spark,
        folder,
        "events_without_repeats",
        lambda events: streams.without_repeats(events.union(events), DELAY),
    )


@query("""
SELECT p.event_id AS purchase_id, p.user_id, v.event_id AS view_id,
       p.ts AS purchase_ts, v.ts AS view_ts
FROM events p JOIN events v ON p.user_id = v.user_id
 AND v.ts BETWEEN p.ts - INTERVAL 2 HOUR AND p.ts
WHERE p.event_type = 'purchase' AND v.event_type = 'view'
""")
def stream_views_with_purchases(spark: SparkSession, folder: str) -> DataFrame:
    return _run(
        spark,
        folder,
        "views_with_purchases",
        lambda events: streams.views_with_purchases(events, "2 hours", DELAY),
    )


@query("""
WITH marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM numbered GROUP BY user_id, session
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _run(
        spark, folder, "user_sessions", lambda events: streams.closed_sessions(events, "6 hours", DELAY)
    )


@query("""
WITH hours AS (
  SELECT user_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end,
         sum(CAST(value * 100 AS DECIMAL(18,0))) AS cents
  FROM events WHERE event_type = 'purchase' GROUP BY 1, 2
  HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR
         <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type = 'purchase')),
spent AS (
  SELECT user_id, hour_end, sum(cents) OVER (PARTITION BY user_id ORDER BY hour_end) AS so_far FROM hours)
SELECT user_id, min(hour_end) AS reached_by, CAST(min(so_far) AS BIGINT) AS spent_cents
FROM spent WHERE so_far >= 5000 GROUP BY user_id
""")
def stream_spending_marks(spark: SparkSession, folder: str) -> DataFrame:
    return _run(
        spark, folder, "spending_marks", lambda events: streams.spending_marks(events, 5_000, DELAY)
    )

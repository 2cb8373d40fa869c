"""The event streams. Each takes and gives a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from tidewheel.functions.columns import money
from tidewheel.operators.joins import interval_join
from tidewheel.operators.timewindows import tumbling
from tidewheel.streaming.runs import event_time


def closed_windows(events: DataFrame, size: str, delay: str) -> DataFrame:
    """Counts and sums per event type and window, once no more rows can reach the window."""
    totals = {"n_events": F.lit(1).cast("bigint"), "total": money("value")}
    return tumbling(event_time(events, "ts", delay), "at", size, ["event_type"], totals)


def without_repeats(events: DataFrame, delay: str) -> DataFrame:
    """Each event once, however often it is delivered within ``delay``.

    An event delivered very often is first reduced by the tasks that read it,
    to one for each Arrow batch, which takes no state. So the task that settles the event
    gets few of its copies, and each event is held once.
    """
    place = events.columns.index("event_id")

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(place).dictionary_encode(null_encoding="encode").indices
            firsts = np.unique(ids.to_numpy(zero_copy_only=False), return_index=True)[1]
            yield batch.take(pa.array(np.sort(firsts)))

    fewer = events.mapInArrow(first_of_each, events.schema)
    return event_time(fewer, "ts", delay).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def views_with_purchases(events: DataFrame, length: str, delay: str) -> DataFrame:
    """Purchases with the user's views up to ``length`` before, as both arrive."""
    timed = event_time(events, "ts", delay)
    purchases = timed.where("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"), "user_id", F.col("at").alias("purchase_ts")
    )
    views = timed.where("event_type = 'view'").select(
        F.col("event_id").alias("view_id"), "user_id", F.col("at").alias("view_ts")
    )
    return interval_join(purchases, views, ["user_id"], "purchase_ts", "view_ts", length)


def closed_sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """A user's sessions, once no more rows can reach them.

    With the settings of ``stream_session`` each task merges its own rows into
    sessions before they are shuffled to their user.
    """
    window = F.session_window("at", gap).alias("session")
    found = (
        event_time(events, "ts", delay)
        .groupBy(window, "user_id")
        .agg(
            F.count("*").alias("n_events"), F.sum(money("value")).alias("total"), F.max("at").alias("end")
        )
    )
    return found.select(
        "user_id",
        F.col("session.start").alias("session_start"),
        F.col("end").alias("session_end"),
        "n_events",
        "total",
    )


def spending_mark(cents: int) -> StatefulProcessor:
    """Adds up a user's hours until the sum first reaches ``cents``.

    The class is made here so that it travels to the workers by value and they
    need not have this package.
    """

    class SpendingMark(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.spent = handle.getValueState("spent", "cents bigint")

        def handleInputRows(
            self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues
        ) -> Iterator[pd.DataFrame]:
            spent = self.spent.get()[0] if self.spent.exists() else 0
            if spent >= cents:
                return
            hours = pd.concat(rows).sort_values("reached_by")
            total = spent + hours["spent_cents"].fillna(0).cumsum().to_numpy()
            reached = (total >= cents).nonzero()[0]
            last = int(reached[0]) if len(reached) else len(total) - 1
            if len(reached):
                at = hours["reached_by"].iloc[last]
                yield pd.DataFrame(
                    {"user_id": [key[0]], "reached_by": [at], "spent_cents": [int(total[last])]}
                )
            self.spent.update((int(total[last]),))

        def close(self) -> None:
            pass

    return SpendingMark()


def spending_marks(events: DataFrame, cents: int, delay: str) -> DataFrame:
    """The hour in which a user's purchases first reach ``cents``, once per user.

    Purchases are summed per user and hour before they reach the keyed state,
    so a very active user brings at most one row an hour to it. Hours close in
    order, which makes the running sum right across batches.
    """
    purchases = event_time(events.where("event_type = 'purchase'"), "ts", delay)
    hours = tumbling(purchases, "at", "1 hour", ["user_id"], {"spent": money("value")})
    rows = hours.select(
        "user_id",
        F.col("window_end").alias("reached_by"),
        (F.col("spent") * 100).cast("bigint").alias("spent_cents"),
    )

    return rows.groupBy("user_id").transformWithStateInPandas(
        spending_mark(cents),
        outputStructType="user_id bigint, reached_by timestamp, spent_cents bigint",
        outputMode="append",
        timeMode="None",
    )

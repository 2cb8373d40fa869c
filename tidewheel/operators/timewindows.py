"""Windows over time, aggregated before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions.columns import length_in_seconds, slot, span


def tumbling(
    df: DataFrame, at: str, size: str, keys: list[str], totals: dict[str, Column]
) -> DataFrame:
    """Sums per key and window of ``size``; in a batch, rows without a time share a window without bounds."""
    sums = [F.sum(c).alias(new) for new, c in totals.items()]
    start, end = F.col("_window.start"), F.col("_window.end")
    if df.isStreaming:
        found = df.groupBy(F.window(at, size).alias("_window"), *keys).agg(*sums)
    else:
        # Spark leaves rows with a null time out of its windows.
        kind = df.schema[at].dataType.simpleString()
        some = F.coalesce(at, F.lit("1970-01-01 00:00:00").cast(kind))
        rows = df.withColumns({"_time": some, "_known": F.col(at).isNotNull()})
        found = rows.groupBy(F.window("_time", size).alias("_window"), "_known", *keys).agg(*sums)
        start, end = F.when(F.col("_known"), start), F.when(F.col("_known"), end)
    return found.select(
        start.alias("window_start"),
        end.alias("window_end"),
        *keys,
        *totals,
    )


def sliding(
    df: DataFrame, at: str, size: str, slide: str, keys: list[str], totals: dict[str, Column]
) -> DataFrame:
    """Sums per key and window of ``size`` that starts every ``slide``.

    Rows without a time count once, in a window without bounds. The rows are summed per slide first, and only those sums are repeated for
    the windows they belong to, instead of every row.
    """
    panes, rest = divmod(length_in_seconds(size), length_in_seconds(slide))
    if rest:
        raise ValueError("size must be a multiple of slide")
    sums = tumbling(df, at, slide, keys, totals)
    back = F.explode(F.sequence(F.lit(0), F.lit(panes - 1))).alias("_back")
    spread = sums.select("*", back).where("window_start is not null or _back = 0").withColumn(
        "window_start", F.col("window_start") - F.col("_back") * span(slide)
    )
    out = spread.groupBy("window_start", *keys).agg(*[F.sum(c).alias(c) for c in totals])
    return out.select(
        "window_start", (F.col("window_start") + span(size)).alias("window_end"), *keys, *totals
    )


def sessions(
    df: DataFrame, keys: list[str], at: str, gap: str, totals: dict[str, Column]
) -> DataFrame:
    """Sums per key and session: a run of rows no further apart than ``gap``.

    Rows in the same ``gap``-wide slot always share a session, so they are
    summed first, with map-side combining. What is ordered per key is one row
    per slot in use: at most the time covered divided by ``gap``, however many
    rows the key has.
    """
    slots = df.groupBy(*keys, slot(df, at, gap).alias("_slot")).agg(
        F.min(at).alias("session_start"),
        F.max(at).alias("session_end"),
        *[F.sum(c).alias(new) for new, c in totals.items()],
    )
    order = W.partitionBy(*keys).orderBy("_slot")
    quiet = F.col("session_start") - F.lag("session_end").over(order) > span(gap)
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    number = F.coalesce(F.sum("_quiet").over(so_far), F.lit(0))
    return (
        slots.withColumn("_quiet", quiet.cast("int"))
        .withColumn("_session", number)
        .groupBy(*keys, "_session")
        .agg(
            F.min("session_start").alias("session_start"),
            F.max("session_end").alias("session_end"),
            *[F.sum(c).alias(c) for c in totals],
        )
        .drop("_session")
    )

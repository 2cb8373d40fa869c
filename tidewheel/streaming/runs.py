"""Running a stream to its present end and reading back what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import SETTINGS, shared_folder

STREAM_SETTINGS = [
    "spark.sql.session.timeZone",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition",
    "spark.sql.streaming.stateStore.providerClass",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled",
]


def stream_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster with what streams need, leaving the caller's as it is."""
    own = spark.newSession()
    for name in STREAM_SETTINGS:
        own.conf.set(name, SETTINGS[name])
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """``at``: the zone-free ``column`` as the event time, with its watermark."""
    return df.withColumn("at", F.col(column).cast("timestamp")).withWatermark("at", delay)


def run_to_files(
    df: DataFrame, name: str, reader: SparkSession, folder: str | None = None
) -> DataFrame:
    """Run over all there is now, writing parquet, and read the files as a batch.

    With the ``folder`` of an earlier run of the same stream it goes on from
    there, with its state, and reads back what all runs wrote.

    The files and the checkpoint lie in the shared folder, so a run that loses
    executors goes on from its last commit, and no row passes the driver.
    Times come back zone-free, as they went in.
    """
    folder = folder or shared_folder(reader, name)
    zone_free = df.select(
        *[
            F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c)
            for c, t in df.dtypes
        ]
    )
    running = (
        zone_free.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return reader.read.schema(zone_free.schema).parquet(f"{folder}/rows")


def time_slices(rows: DataFrame, column: str, depth: int, name: str) -> list[str]:
    """Folders that hold ``rows`` in slices of whole hours, in the order of time; none if one slice holds all.

    A slice has at most ``depth`` rows besides those of its last hour. Rows
    without a time are in the first one. Counts are kept per hour, so what is
    ordered in one task is bounded by the time covered; the rows are shuffled and
    written once, whatever the order and times of the files they come from.
    """
    folder = shared_folder(rows.sparkSession, f"{name}-slices")
    hour = F.date_trunc("hour", column)
    per_hour = rows.groupBy(hour.alias("_hour")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(F.asc_nulls_first("_hour"))) - F.col("_n")
    hours = per_hour.select("_hour", F.floor(before / depth).cast("int").alias("_slice"))
    hours.write.parquet(f"{folder}/hours")
    hours = rows.sparkSession.read.schema(hours.schema).parquet(f"{folder}/hours")
    slices = sorted(r[0] for r in hours.select("_slice").distinct().collect())
    if len(slices) < 2:
        return []
    sliced = rows.join(hours, hour.eqNullSafe(F.col("_hour"))).drop("_hour")
    # The hash parts rows that tie in time, so a busy moment is no single task's.
    spread = sliced.repartitionByRange("_slice", column, F.xxhash64(*rows.columns))
    spread.write.partitionBy("_slice").parquet(f"{folder}/rows")
    return [f"{folder}/rows/_slice={n}" for n in slices]


def run_slices(
    folders: list[str],
    source: Callable[[str], DataFrame],
    build: Callable[[DataFrame], DataFrame],
    name: str,
    reader: SparkSession,
) -> DataFrame:
    """The stream that ``build`` makes, run over one folder after the other with one checkpoint.

    A folder is one micro-batch, and the watermark moves between folders only. So
    no row is late if the folders follow in time, and the state held at once is that of a
    folder and the delay.
    """
    to = shared_folder(reader, name)
    for folder in folders:
        rows = run_to_files(build(source(folder)), name, reader, to)
    return rows

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewheel.functions.columns import length_in_seconds, seconds, slot

TIMES = [
    dt.datetime(1970, 1, 1),
    dt.datetime(1969, 12, 31, 23, 59, 59, 999999),
    dt.datetime(1969, 12, 31, 22, 59, 59),
    dt.datetime(2024, 3, 10, 2, 30, 0, 1),  # skipped by the clocks of New York
    dt.datetime(2024, 1, 1, 0, 0, 7, 179575),
]
EPOCH = dt.datetime(1970, 1, 1)


def since(time):
    delta = time - EPOCH
    return Decimal(delta.days * 86400 + delta.seconds) + Decimal(delta.microseconds) / 1_000_000


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_seconds_and_slots_do_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in TIMES], "t timestamp_ntz")
        rows = df.select("t", seconds(df, "t").alias("s"), slot(df, "t", "1 hour").alias("h")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for row in rows:
        assert row["s"] == since(row["t"])
        assert row["h"] == int(since(row["t"]) // 3600 - (1 if since(row["t"]) % 3600 < 0 else 0)) * 3600


def test_seconds_of_a_zoned_time(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t timestamp_ntz")
    zoned = df.select(F.col("t").cast("timestamp").alias("t"))
    got = {r["s"] for r in zoned.select(seconds(zoned, "t").alias("s")).collect()}
    assert got == {since(t) for t in TIMES}


@pytest.mark.parametrize("text, want", [("1 second", 1), ("30 minutes", 1800), ("7 days", 604800)])
def test_lengths(text, want):
    assert length_in_seconds(text) == want

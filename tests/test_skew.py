"""Jobs on tables where one key holds a third of the rows."""

import tempfile

import pytest
from compare import compare
from conftest import SF
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel import plans
from tidewheel.functions.columns import seconds
from tidewheel.operators import ordered
from tidewheel.sources.tables import SCHEMAS, table

# Table, key that is made frequent, the key value that takes a third of the rows.
FREQUENT = {
    "lineitem": ("l_orderkey", 7),
    "orders": ("o_custkey", 5),
    "events": ("user_id", 3),
    "customer": ("c_nationkey", 2),
    "part": ("p_brand", "Brand#1"),
}


@pytest.fixture(scope="module")
def folder(spark):
    """The tables with every third row moved to the frequent key."""
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in SCHEMAS:
        df = table(spark, SF, name)
        if name in FREQUENT:
            key, value = FREQUENT[name]
            third = F.pmod(F.hash(*df.columns), F.lit(3)) == 0
            value = F.lit(value).cast(df.schema[key].dataType)
            df = df.withColumn(key, F.when(third, value).otherwise(F.col(key)))
        df.coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", plans.QUERIES)
def test_same_rows_with_a_frequent_key(spark, folder, name):
    sql = plans.ORACLES[name]
    rows, wrong = compare(plans.QUERIES[name](spark, folder), sql, folder, "/*.parquet")
    assert wrong is None
    assert rows > 0


def rows_per_task(df, column):
    """Rows in the fullest task that makes ``column``, and in an average one."""
    tasks = df.select(column, F.spark_partition_id().alias("task")).groupBy("task")
    counts = tasks.agg(F.count("*").alias("n"), F.max(F.xxhash64(column)).alias("used"))
    return counts.where("used is not null").agg(F.max("n"), F.avg("n")).first()


def test_a_frequent_key_does_not_fill_one_task(spark):
    events = table(spark, "/root/testdata/sf0.01", "events").withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(3)).otherwise(F.col("user_id"))
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        at, order = seconds(events, "ts"), ["ts", "event_id"]
        plain = events.withColumn("prev", F.lag("ts").over(W.partitionBy("user_id").orderBy(*order)))
        most, average = rows_per_task(plain, "prev")
        assert most > 2.5 * average
        made = {
            "prev_ts": ordered.neighbours(events, ["user_id"], order, at, ["ts"]),
            "n": ordered.trailing_totals(events, ["user_id"], "ts", "1 hour", {"n": F.lit(1)}),
            "row_number": ordered.ranks(events, [], "ts", ["event_id"], at, dense=False),
        }
        for column, df in made.items():
            most, average = rows_per_task(df, column)
            assert most < 2.5 * average, column
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def small_thresholds(spark):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.files.maxPartitionBytes": "20000",
        "spark.sql.files.openCostInBytes": "0",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_frequent_join_key_is_split(spark, folder, small_thresholds):
    # Several files, so that the frequent key's rows come from several tasks.
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in ("lineitem", "orders"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(8).write.parquet(
            f"{out}/{name}.parquet"
        )
    df = plans.QUERIES["lines_shipped_before_order"](spark, out)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan

"""Ranks, frames, neighbours and as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions.columns import money, seconds
from tidewheel.operators.ordered import (
    asof_join,
    last_seen,
    neighbours,
    ranks,
    running_totals,
    tile,
    trailing_rows,
    trailing_totals,
)
from tidewheel.plans.registry import query
from tidewheel.sources.tables import table


@query("""
SELECT o_orderkey, o_orderpriority, o_totalprice,
       CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey)
            AS BIGINT) AS row_number,
       CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS FIRST)
            AS BIGINT) AS dense_rank,
       CAST(ntile(10) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey)
            AS BIGINT) AS decile
FROM orders
""")
def orders_ranked_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    ranked = ranks(
        orders,
        ["o_orderpriority"],
        "o_totalprice",
        ["o_orderkey"],
        F.col("o_totalprice"),
        descending=True,
    )
    return ranked.withColumn("decile", tile(10)).drop("group_rows")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
       CAST(row_number() OVER (ORDER BY l_extendedprice NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey)
            AS BIGINT) AS position,
       CAST(ntile(100) OVER (ORDER BY l_extendedprice NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey)
            AS BIGINT) AS percentile
FROM lineitem
""")
def lines_ranked_overall(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"
    )
    ranked = ranks(
        lines,
        [],
        "l_extendedprice",
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        F.col("l_extendedprice"),
        dense=False,
    )
    return (
        ranked.withColumn("percentile", tile(100))
        .withColumnRenamed("row_number", "position")
        .drop("group_rows")
    )


@query("""
SELECT event_id, user_id, ts,
       lag(ts) OVER w AS prev_ts, lead(ts) OVER w AS next_ts,
       coalesce(lag(event_type) OVER w, 'none') AS prev_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)
""")
def events_with_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    found = neighbours(
        events, ["user_id"], ["ts", "event_id"], seconds(events, "ts"), ["ts", "event_type"]
    )
    return found.select(
        "event_id",
        "user_id",
        "ts",
        "prev_ts",
        "next_ts",
        F.coalesce("prev_event_type", F.lit("none")).alias("prev_type"),
    )


@query("""
SELECT o_orderkey, o_custkey, o_orderdate,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DECIMAL(28,2)) AS spent_so_far,
       CAST(count(*) OVER w AS BIGINT) AS orders_so_far
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def customer_running_totals(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        money("o_totalprice").alias("price"),
        F.lit(1).cast("bigint").alias("one"),
    )
    return (
        running_totals(
            orders,
            ["o_custkey"],
            ["o_orderdate", "o_orderkey"],
            seconds(orders, "o_orderdate"),
            {"spent_so_far": "price", "orders_so_far": "one"},
        )
        .withColumn("spent_so_far", F.col("spent_so_far").cast("decimal(28,2)"))
        .drop("price", "one")
    )


@query("""
SELECT o_orderkey, o_custkey, o_orderdate,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DECIMAL(28,2)) AS last_three_total,
       max(o_totalprice) OVER w AS last_three_largest
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey
             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def customer_last_three_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"
    )
    return trailing_rows(
        orders,
        ["o_custkey"],
        "o_orderdate",
        ["o_orderkey"],
        seconds(orders, "o_orderdate"),
        3,
        {
            "last_three_total": F.sum(money("o_totalprice")),
            "last_three_largest": F.max("o_totalprice"),
        },
    ).drop("o_totalprice")


@query("""
SELECT event_id, user_id, ts,
       CAST(count(*) OVER w AS BIGINT) AS week_events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DECIMAL(28,2)) AS week_value
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST
             RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)
""")
def trailing_week_by_user(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    found = trailing_totals(
        events,
        ["user_id"],
        "ts",
        "7 days",
        {"week_events": F.lit(1).cast("bigint"), "week_value": money("value")},
    )
    return found.withColumn("week_value", F.col("week_value").cast("decimal(28,2)")).drop("value")


@query("""
SELECT event_id, user_id, ts,
       (SELECT count(*) FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view'
          AND v.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts) AS views_in_hour
FROM events p WHERE event_type = 'purchase'
""")
def views_in_hour_before_purchase(spark: SparkSession, folder: str) -> DataFrame:
    events = (
        table(spark, folder, "events")
        .where(F.col("event_type").isin("view", "purchase"))
        .select("event_id", "user_id", "ts", "event_type")
    )
    counted = trailing_totals(
        events,
        ["user_id"],
        "ts",
        "1 hour",
        {"views_in_hour": F.lit(1).cast("bigint")},
        (F.col("event_type") == "view") & F.col("ts").isNotNull() & F.col("user_id").isNotNull(),
    )
    return counted.where("event_type = 'purchase'").drop("event_type")


@query("""
SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts, coalesce(v.event_id, -1) AS view_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
  ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def last_view_before_purchase(spark: SparkSession, folder: str) -> DataFrame:
    # Both kinds are rows of one table: one scan finds the last view seen.
    events = (
        table(spark, folder, "events")
        .where(F.col("event_type").isin("view", "purchase"))
        .select(
            "event_id",
            "user_id",
            "ts",
            "event_type",
            F.when(
                (F.col("event_type") == "view") & F.col("ts").isNotNull() & F.col("user_id").isNotNull(),
                F.struct("ts", "event_id"),
            ).alias("view"),
        )
    )
    seen = last_seen(
        events, ["user_id"], ["ts", "event_id"], seconds(events, "ts"), "view", "last_view"
    )
    return seen.where("event_type = 'purchase'").select(
        "event_id",
        "user_id",
        "ts",
        F.col("last_view.ts").alias("view_ts"),
        F.coalesce("last_view.event_id", F.lit(-1)).alias("view_id"),
    )


@query("""
SELECT p.event_id, p.user_id, p.ts,
       CASE WHEN e.ts >= p.ts - INTERVAL 12 HOUR THEN e.ts END AS error_ts,
       CASE WHEN e.ts >= p.ts - INTERVAL 12 HOUR THEN e.value ELSE 0 END AS error_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e
  ON p.user_id = e.user_id AND p.ts >= e.ts
""")
def recent_error_before_purchase(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = events.where("event_type = 'error'").select(
        F.col("event_id").alias("error_id"),
        "user_id",
        F.col("ts").alias("error_ts"),
        F.col("value").alias("error_value"),
    )
    found = asof_join(
        purchases,
        errors,
        ["user_id"],
        "ts",
        "error_ts",
        ["error_ts", "error_value"],
        "error_id",
        within="12 hours",
    )
    value = F.when(F.col("error_ts").isNotNull(), F.col("error_value")).otherwise(F.lit(0.0))
    return found.withColumn("error_value", value)


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
""")
def largest_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""
SELECT c_nationkey, c_custkey, c_acctbal, place FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey, c_acctbal,
         CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)
              AS BIGINT) AS place
  FROM customer)
WHERE place <= 3
""")
def richest_customers_per_nation(spark: SparkSession, folder: str) -> DataFrame:
    # Spark keeps three rows per nation and task before it shuffles
    # (WindowGroupLimit), so a large nation needs no splitting.
    place = F.row_number().over(
        W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    )
    return (
        table(spark, folder, "customer")
        .select("c_nationkey", "c_custkey", "c_acctbal", place.alias("place"))
        .where("place <= 3")
        .select(
            F.col("c_nationkey").cast("bigint").alias("c_nationkey"),
            "c_custkey",
            "c_acctbal",
            F.col("place").cast("bigint").alias("place"),
        )
    )

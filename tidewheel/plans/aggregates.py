"""Grouping.

Grouping sets repeat every input row once per set. The queries below group by
all dimensions first and build the sets from that, so the repeated rows are as
few as the distinct dimension values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.columns import json_int, money, net_price
from tidewheel.plans.registry import query
from tidewheel.sources.tables import table


@query("""
SELECT o_custkey, count(*) AS n_orders,
       count(DISTINCT o_orderpriority) AS n_priorities,
       count(DISTINCT o_orderstatus) AS n_statuses,
       min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
       min(o_totalprice) AS smallest, max(o_totalprice) AS largest
FROM orders GROUP BY o_custkey
""")
def customer_order_profile(spark: SparkSession, folder: str) -> DataFrame:
    # Two distinct counts side by side would send every row three times to the
    # aggregation; grouped finely first, a customer has a few short sets.
    fine = (
        table(spark, folder, "orders")
        .groupBy("o_custkey", "o_orderpriority", "o_orderstatus")
        .agg(
            F.count("*").alias("n"),
            F.min("o_orderdate").alias("first_order"),
            F.max("o_orderdate").alias("last_order"),
            F.min("o_totalprice").alias("smallest"),
            F.max("o_totalprice").alias("largest"),
        )
    )
    return fine.groupBy("o_custkey").agg(
        F.sum("n").alias("n_orders"),
        F.size(F.collect_set("o_orderpriority")).cast("bigint").alias("n_priorities"),
        F.size(F.collect_set("o_orderstatus")).cast("bigint").alias("n_statuses"),
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
        F.min("smallest").alias("smallest"),
        F.max("largest").alias("largest"),
    )


@query("""
SELECT o_custkey,
       CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O'), 0)
            AS DECIMAL(28,2)) AS open_total,
       count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_pressing,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM orders GROUP BY o_custkey
HAVING count(*) > 1
""")
def customer_open_totals(spark: SparkSession, folder: str) -> DataFrame:
    price = money("o_totalprice")
    return (
        table(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(
            F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "O", price)), F.lit(0))
            .cast("decimal(28,2)")
            .alias("open_total"),
            F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("n_pressing"),
            F.sum(price).alias("total"),
            F.count("*").alias("n"),
        )
        .where("n > 1")
        .drop("n")
    )


@query("""
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS returnflag,
       CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS linestatus,
       CAST(grouping(l_returnflag) AS BIGINT) AS all_flags,
       CAST(grouping(l_linestatus) AS BIGINT) AS all_statuses,
       count(*) AS n_lines,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity,
       CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS revenue
FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())
""")
def line_totals_by_flag_and_status(spark: SparkSession, folder: str) -> DataFrame:
    fine = (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"),
            F.sum(money("l_quantity")).alias("q"),
            F.sum(net_price()).alias("r"),
        )
    )
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        fine.groupingSets([[flag, status], [flag], [status], []], flag, status)
        .agg(
            F.grouping("l_returnflag").cast("bigint").alias("all_flags"),
            F.grouping("l_linestatus").cast("bigint").alias("all_statuses"),
            F.sum("n").alias("n_lines"),
            F.sum("q").cast("decimal(28,2)").alias("quantity"),
            F.sum("r").cast("decimal(28,4)").alias("revenue"),
        )
        .withColumn("returnflag", F.when(F.col("all_flags") == 1, "all").otherwise(flag))
        .withColumn("linestatus", F.when(F.col("all_statuses") == 1, "all").otherwise(status))
        .drop("l_returnflag", "l_linestatus")
    )


@query("""
SELECT CASE WHEN grouping(p_brand) = 1 THEN 'all' ELSE p_brand END AS brand,
       CASE WHEN grouping(p_type) = 1 THEN 'all' ELSE p_type END AS type,
       CAST(grouping(p_brand) AS BIGINT) AS all_brands, CAST(grouping(p_type) AS BIGINT) AS all_types,
       count(*) AS n_parts, CAST(max(p_size) AS BIGINT) AS largest_size,
       CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS price_total
FROM part GROUP BY CUBE (p_brand, p_type)
""")
def part_cube(spark: SparkSession, folder: str) -> DataFrame:
    fine = (
        table(spark, folder, "part")
        .groupBy("p_brand", "p_type")
        .agg(
            F.count("*").alias("n"),
            F.max("p_size").alias("size"),
            F.sum(money("p_retailprice")).alias("price"),
        )
    )
    return (
        fine.cube("p_brand", "p_type")
        .agg(
            F.grouping("p_brand").cast("bigint").alias("all_brands"),
            F.grouping("p_type").cast("bigint").alias("all_types"),
            F.sum("n").alias("n_parts"),
            F.max("size").cast("bigint").alias("largest_size"),
            F.sum("price").cast("decimal(28,2)").alias("price_total"),
        )
        .select(
            # A null value stays null; only a subtotal reads 'all'.
            F.when(F.col("all_brands") == 1, "all").otherwise(F.col("p_brand")).alias("brand"),
            F.when(F.col("all_types") == 1, "all").otherwise(F.col("p_type")).alias("type"),
            "all_brands",
            "all_types",
            "n_parts",
            "largest_size",
            "price_total",
        )
    )


@query("""
SELECT CASE WHEN grouping(day) = 1 THEN 'all' ELSE strftime(day, '%Y-%m-%d') END AS day,
       CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type,
       CAST(grouping(day) AS BIGINT) AS all_days, CAST(grouping(event_type) AS BIGINT) AS all_types,
       count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM (SELECT date_trunc('day', ts) AS day, event_type, value FROM events)
GROUP BY ROLLUP (day, event_type)
""")
def event_rollup_by_day(spark: SparkSession, folder: str) -> DataFrame:
    fine = (
        table(spark, folder, "events")
        .groupBy(F.to_date("ts").cast("string").alias("day"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(money("value")).alias("v"))
    )
    return (
        fine.rollup("day", "event_type")
        .agg(
            F.grouping("day").cast("bigint").alias("all_days"),
            F.grouping("event_type").cast("bigint").alias("all_types"),
            F.sum("n").alias("n_events"),
            F.sum("v").cast("decimal(28,2)").alias("total"),
        )
        .withColumn("day", F.when(F.col("all_days") == 1, "all").otherwise(F.col("day")))
        .withColumn("event_type", F.when(F.col("all_types") == 1, "all").otherwise(F.col("event_type")))
    )


@query("""
SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n_events,
       count(DISTINCT user_id) AS n_users,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM events GROUP BY 1
""")
def events_by_property(spark: SparkSession, folder: str) -> DataFrame:
    per_user = (
        table(spark, folder, "events")
        .groupBy(json_int("props", "$.k").alias("k"), "user_id")
        .agg(F.count("*").alias("n"), F.sum(money("value")).alias("v"))
    )
    return per_user.groupBy("k").agg(
        F.sum("n").alias("n_events"),
        F.count("user_id").alias("n_users"),
        F.sum("v").cast("decimal(28,2)").alias("total"),
    )


@query("""
SELECT word, count(*) AS n_uses, count(DISTINCT p_brand) AS n_brands
FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part)
GROUP BY word
""")
def part_name_words(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "part").select(
        "p_brand", F.explode(F.split("p_name", " ")).alias("word")
    )
    per_brand = words.groupBy("word", "p_brand").agg(F.count("*").alias("n"))
    return per_brand.groupBy("word").agg(
        F.sum("n").alias("n_uses"), F.count("p_brand").alias("n_brands")
    )

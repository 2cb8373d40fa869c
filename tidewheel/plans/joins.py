"""Joins.

The many-rows side is summed per join key before it is joined wherever the
query allows: the map-side combine then absorbs a frequent key, and the join
meets one row per key. Small tables are broadcast by Spark's own check of their
bytes, in the plan or at run time, never unchecked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.columns import money, net_price
from tidewheel.operators.joins import interval_join
from tidewheel.plans.registry import query
from tidewheel.sources.tables import table


@query("""
SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS o_year,
       count(DISTINCT o_orderkey) AS n_orders, count(*) AS n_lines,
       CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey
WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'
GROUP BY r_name, year(o_orderdate)
""")
def returned_revenue_by_region(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    orders = table(spark, folder, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01 00:00:00'")
    per_order = lines.groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"), F.sum(net_price()).alias("revenue")
    )
    # One row per order from here on, so counting orders needs no DISTINCT.
    per_customer = (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", F.year("o_orderdate").cast("bigint").alias("o_year"))
        .agg(
            F.count("*").alias("n_orders"),
            F.sum("n_lines").alias("n_lines"),
            F.sum("revenue").cast("decimal(28,4)").alias("revenue"),
        )
    )
    per_nation = (
        per_customer.join(
            table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        .groupBy("c_nationkey", "o_year")
        .agg(*[F.sum(c).alias(c) for c in ("n_orders", "n_lines", "revenue")])
    )
    return (
        per_nation.join(
            table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "o_year")
        .agg(
            F.sum("n_orders").alias("n_orders"),
            F.sum("n_lines").alias("n_lines"),
            F.sum("revenue").cast("decimal(28,4)").alias("revenue"),
        )
    )


@query("""
SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n_lines,
       CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DECIMAL(28,2)) AS line_total
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_orderkey, o_orderstatus
""")
def orders_with_line_totals(spark: SparkSession, folder: str) -> DataFrame:
    per_order = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").alias("n_lines"), F.sum(money("l_extendedprice")).alias("line_total"))
    )
    return (
        table(spark, folder, "orders")
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            "o_orderkey",
            "o_orderstatus",
            F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
            F.coalesce("line_total", F.lit(0)).cast("decimal(28,2)").alias("line_total"),
        )
    )


@query("""
WITH shipped AS (
  SELECT l_orderkey, min(l_shipdate) AS first_shipped, count(*) AS n_lines
  FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
  GROUP BY l_orderkey),
placed AS (
  SELECT o_orderkey, o_orderdate FROM orders
  WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00')
SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, o_orderdate, first_shipped,
       coalesce(n_lines, 0) AS n_lines,
       CASE WHEN l_orderkey IS NULL THEN 'order only'
            WHEN o_orderkey IS NULL THEN 'lines only' ELSE 'both' END AS found
FROM placed FULL JOIN shipped ON o_orderkey = l_orderkey AND first_shipped >= o_orderdate
""")
def orders_against_shipments(spark: SparkSession, folder: str) -> DataFrame:
    def in_1996(column: str) -> str:
        return (
            f"{column} >= timestamp_ntz'1996-01-01 00:00:00' "
            f"and {column} < timestamp_ntz'1997-01-01 00:00:00'"
        )

    shipped = (
        table(spark, folder, "lineitem")
        .where(in_1996("l_shipdate"))
        .groupBy("l_orderkey")
        .agg(F.min("l_shipdate").alias("first_shipped"), F.count("*").alias("n_lines"))
    )
    placed = (
        table(spark, folder, "orders")
        .where(in_1996("o_orderdate"))
        .select("o_orderkey", "o_orderdate")
    )
    same = (F.col("o_orderkey") == F.col("l_orderkey")) & (
        F.col("first_shipped") >= F.col("o_orderdate")
    )
    found = (
        F.when(F.col("l_orderkey").isNull(), "order only")
        .when(F.col("o_orderkey").isNull(), "lines only")
        .otherwise("both")
    )
    return placed.join(shipped, same, "full").select(
        F.coalesce("o_orderkey", "l_orderkey").alias("orderkey"),
        "o_orderdate",
        "first_shipped",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        found.alias("found"),
    )


@query("""
SELECT c_custkey, c_name, c_nationkey FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
              AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
""")
def customers_with_large_urgent_orders(spark: SparkSession, folder: str) -> DataFrame:
    buyers = (
        table(spark, folder, "orders")
        .where("o_orderpriority = '1-URGENT' and o_totalprice > 400000")
        .select("o_custkey")
        .distinct()
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    return customers.join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("""
SELECT o_orderkey, o_custkey, o_orderdate FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def orders_without_lines(spark: SparkSession, folder: str) -> DataFrame:
    used = table(spark, folder, "lineitem").select("l_orderkey").distinct()
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(used, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, o_orderdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate
""")
def lines_shipped_before_order(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    early = (F.col("l_orderkey") == F.col("o_orderkey")) & (
        F.col("l_shipdate") < F.col("o_orderdate")
    )
    return lines.join(orders, early).drop("o_orderkey")


@query("""
WITH brand AS (
  SELECT p_brand AS brand, count(*) AS n_parts, sum(CAST(p_retailprice AS DECIMAL(18,2))) AS total
  FROM part GROUP BY p_brand)
SELECT p_partkey, p_brand, p_retailprice, n_parts
FROM part JOIN brand ON p_brand = brand AND CAST(p_retailprice AS DECIMAL(18,2)) * n_parts > total
WHERE p_size >= 25
""")
def parts_dearer_than_brand(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    brand = parts.groupBy(F.col("p_brand").alias("brand")).agg(
        F.count("*").alias("n_parts"), F.sum(money("p_retailprice")).alias("total")
    )
    dear = (F.col("p_brand") == F.col("brand")) & (
        money("p_retailprice") * F.col("n_parts") > F.col("total")
    )
    return (
        parts.where("p_size >= 25")
        .join(brand, dear)
        .select("p_partkey", "p_brand", "p_retailprice", "n_parts")
    )


@query("""
SELECT p.event_id AS purchase_id, p.user_id, v.event_id AS view_id,
       p.ts AS purchase_ts, v.ts AS view_ts
FROM events p JOIN events v ON p.user_id = v.user_id
 AND v.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts
WHERE p.event_type = 'purchase' AND v.event_type = 'view'
""")
def views_near_purchases(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    purchases = events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("purchase_ts")
    )
    views = events.where("event_type = 'view'").select(
        F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts")
    )
    return interval_join(purchases, views, ["user_id"], "purchase_ts", "view_ts", "1 hour")

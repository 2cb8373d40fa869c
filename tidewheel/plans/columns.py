"""Scans, filters and computed columns: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.columns import money
from tidewheel.plans.registry import query
from tidewheel.sources.tables import table


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate
FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-04-01 00:00:00'
  AND l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 5 AND 45
""")
def lines_shipped_in_quarter(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .where(
            "l_shipdate >= timestamp_ntz'1997-01-01 00:00:00' "
            "and l_shipdate < timestamp_ntz'1997-04-01 00:00:00'"
        )
        .where(F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(5, 45))
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    )


@query("""
SELECT c_custkey, lower(c_name) AS name_lower,
       CAST(length(c_name) AS BIGINT) AS name_length,
       substr(c_name, 1, 8) AS name_head,
       replace(c_mktsegment, 'E', 'e') AS segment_replaced,
       concat(c_mktsegment, '/', CAST(c_nationkey AS VARCHAR)) AS segment_nation,
       trim(concat('  ', c_mktsegment, ' ')) AS segment_trimmed,
       lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS key_padded,
       CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS name_number,
       c_mktsegment LIKE '%U%' AS has_u
FROM customer
""")
def customer_text_columns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.lower("c_name").alias("name_lower"),
        F.length("c_name").cast("bigint").alias("name_length"),
        F.substring("c_name", 1, 8).alias("name_head"),
        F.replace("c_mktsegment", F.lit("E"), F.lit("e")).alias("segment_replaced"),
        F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")).alias(
            "segment_nation"
        ),
        F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("segment_trimmed"),
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("key_padded"),
        F.regexp_extract("c_name", "([0-9]+)", 1).cast("bigint").alias("name_number"),
        F.col("c_mktsegment").like("%U%").alias("has_u"),
    )


@query("""
SELECT o_orderkey,
       CAST(year(o_orderdate) AS BIGINT) AS o_year,
       CAST(quarter(o_orderdate) AS BIGINT) AS o_quarter,
       CAST(month(o_orderdate) AS BIGINT) AS o_month,
       CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS o_weekday,
       CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS o_month_start,
       o_orderdate + INTERVAL 30 DAY AS due,
       CAST(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01 00:00:00') AS BIGINT) AS age_days,
       strftime(o_orderdate, '%Y-%m') AS o_year_month
FROM orders
""")
def order_date_columns(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.year(day).cast("bigint").alias("o_year"),
        F.quarter(day).cast("bigint").alias("o_quarter"),
        F.month(day).cast("bigint").alias("o_month"),
        F.dayofweek(day).cast("bigint").alias("o_weekday"),
        F.trunc(day, "month").cast("timestamp_ntz").alias("o_month_start"),
        (day + F.expr("INTERVAL 30 DAYS")).alias("due"),
        F.date_diff(F.lit("2002-01-01").cast("date"), day).cast("bigint").alias("age_days"),
        F.date_format(day, "yyyy-MM").alias("o_year_month"),
    )


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
       CAST(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS net_price,
       CAST(abs(l_discount - 0.05) * 100 AS DECIMAL(18,2)) AS discount_distance,
       CAST(floor(l_quantity / 10) AS BIGINT) AS quantity_band,
       CAST(ceil(l_quantity / 10) AS BIGINT) AS quantity_band_up,
       CAST(l_orderkey % 7 AS BIGINT) AS order_rest,
       sqrt(l_quantity) AS quantity_root,
       greatest(l_discount, l_tax) AS larger_rate
FROM lineitem
""")
def line_number_columns(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_shipdate",
        price.cast("decimal(18,4)").alias("net_price"),
        (F.abs(F.col("l_discount") - 0.05) * 100).cast("decimal(18,2)").alias("discount_distance"),
        F.floor(F.col("l_quantity") / 10).alias("quantity_band"),
        F.ceil(F.col("l_quantity") / 10).alias("quantity_band_up"),
        (F.col("l_orderkey") % 7).alias("order_rest"),
        F.sqrt("l_quantity").alias("quantity_root"),
        F.greatest("l_discount", "l_tax").alias("larger_rate"),
    )


@query("""
SELECT p_partkey,
       CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
       coalesce(nullif(p_type, 'SMALL'), 'none') AS type_or_none,
       CASE WHEN p_brand = 'Brand#1' OR p_brand = 'Brand#2' THEN p_retailprice ELSE 0.0 END AS listed_price,
       CAST(p_retailprice AS DECIMAL(18,2)) AS price
FROM part
""")
def part_conditional_columns(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        "p_partkey",
        F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("size_class"),
        F.coalesce(F.nullif("p_type", F.lit("SMALL")), F.lit("none")).alias("type_or_none"),
        F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), F.col("p_retailprice"))
        .otherwise(0.0)
        .alias("listed_price"),
        money("p_retailprice").alias("price"),
    )

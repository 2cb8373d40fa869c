"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import multisets
from tidewheel.plans.registry import query
from tidewheel.sources.tables import table


def _nations(spark: SparkSession, folder: str, name: str) -> DataFrame:
    key = F.col(f"{name[0]}_nationkey").cast("bigint")
    return table(spark, folder, name).select(key.alias("nationkey"))


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, 'nation' AS kind FROM nation
UNION ALL
SELECT CAST(r_regionkey AS BIGINT), r_name, 'region' FROM region
UNION ALL
SELECT c_custkey, c_name, 'customer' FROM customer
UNION ALL
SELECT s_suppkey, s_name, 'supplier' FROM supplier
""")
def all_names(spark: SparkSession, folder: str) -> DataFrame:
    def named(name: str, key: str, label: str) -> DataFrame:
        return table(spark, folder, name).select(
            F.col(key).cast("bigint").alias("key"), F.col(label).alias("name"), F.lit(name).alias("kind")
        )

    return (
        named("nation", "n_nationkey", "n_name")
        .unionByName(named("region", "r_regionkey", "r_name"))
        .unionByName(named("customer", "c_custkey", "c_name"))
        .unionByName(named("supplier", "s_suppkey", "s_name"))
    )


@query("""
SELECT CAST(c_nationkey AS BIGINT) AS nationkey FROM customer
UNION
SELECT CAST(s_nationkey AS BIGINT) FROM supplier
""")
def nations_with_customers_or_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return _nations(spark, folder, "customer").union(_nations(spark, folder, "supplier")).distinct()


@query("""
SELECT CAST(c_nationkey AS BIGINT) AS nationkey FROM customer
INTERSECT
SELECT CAST(s_nationkey AS BIGINT) FROM supplier
""")
def nations_with_customers_and_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return multisets.intersect(
        _nations(spark, folder, "customer"), _nations(spark, folder, "supplier")
    )


@query("""
SELECT CAST(c_nationkey AS BIGINT) AS nationkey FROM customer
EXCEPT ALL
SELECT CAST(s_nationkey AS BIGINT) FROM supplier
""")
def customer_nations_beyond_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return multisets.except_all(
        _nations(spark, folder, "customer"), _nations(spark, folder, "supplier")
    )

"""The parquet tables, read as batches or as streams.

Schemas are declared so that no job runs to infer them and a stream can start
on an empty folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def stream(
    spark: SparkSession,
    folder: str,
    name: str,
    files_per_batch: int | None = None,
    bytes_per_batch: int | None = None,
) -> DataFrame:
    """The table as a file stream; ``files_per_batch`` or ``bytes_per_batch`` bounds one micro-batch.

    Bounded batches take the files by their age. A row older than the watermark
    that earlier files have set is late, so files must follow in time up to the delay.
    """
    # A pattern, since a plain path must be a folder and a table may be one file.
    return stream_of(spark, f"{folder}/{name}[.]parquet", name, files_per_batch, bytes_per_batch)


def stream_of(
    spark: SparkSession,
    path: str,
    name: str,
    files_per_batch: int | None = None,
    bytes_per_batch: int | None = None,
) -> DataFrame:
    """The files at ``path``, which have the columns of the table, as a stream."""
    reader = spark.readStream.schema(SCHEMAS[name])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)

"""Set operations whose cost does not depend on how often a value repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPIES_PER_ROW = 1_000_000


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """INTERSECT with both sides made distinct before they meet.

    Spark joins first and makes the result distinct, which would shuffle every
    copy of a frequent value to one task.
    """
    return left.distinct().intersect(right.distinct())


def except_all(left: DataFrame, right: DataFrame, per_row: int = COPIES_PER_ROW) -> DataFrame:
    """EXCEPT ALL by counting copies.

    The copies that remain of one value are written out in shares of at most
    ``per_row``, spread over the tasks, rather than all by the task that
    counted them.
    """
    columns = left.columns
    signed = left.withColumn("_n", F.lit(1)).union(right.withColumn("_n", F.lit(-1)))
    remaining = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n > 0")
    first = F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(per_row))).alias("_first")
    shares = remaining.select(*columns, "_n", first).repartition(*columns, "_first")
    share = F.least(F.col("_n") - F.col("_first"), F.lit(per_row))
    return shares.withColumn("_copy", F.explode(F.sequence(F.lit(1), share))).select(*columns)

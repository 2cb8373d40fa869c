"""Cuts by a depth in rows, whatever the partitions and however many rows are tied."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.operators import ordered, segments
from tidewheel.operators.segments import SEGMENT, cut, numbers


@pytest.fixture(scope="module")
def tied(spark):
    """8,000 rows of one key, half of them with one time."""
    at = F.when(F.col("id") % 2 == 0, 1000).otherwise(F.col("id") % 3000)
    return spark.range(8000).select("id", F.lit(1).alias("key"), at.cast("bigint").alias("at")).cache()


@pytest.mark.parametrize("partitions", [2, 200])
def test_no_segment_is_deeper_than_twice_the_depth(spark, tied, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        piece = cut(tied, ["key"], [F.col("at"), *numbers(tied, ["id"])], depth=100)
        sizes = [r["count"] for r in piece.rows.groupBy(SEGMENT).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes) == 8000
    assert max(sizes) <= 2 * 100
    assert len(sizes) < 4 * 8000 / 100


def test_ranks_and_totals_go_on_across_a_cut_tie(tied):
    ranked = ordered.ranks(tied, ["key"], "at", ["id"], F.col("at"))
    out = ordered.running_totals(ranked, ["key"], ["at", "id"], F.col("at"), {"total": "id"})
    w = W.partitionBy("key").orderBy("at", "id")
    want = tied.select(
        "id", F.row_number().over(w), F.dense_rank().over(W.partitionBy("key").orderBy("at")),
        F.sum("id").over(w.rowsBetween(W.unboundedPreceding, 0)),
    )
    got = out.select("id", "row_number", "dense_rank", "total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cuts_too_many_to_broadcast_are_joined_as_a_table(spark, tied, monkeypatch):
    monkeypatch.setattr(segments, "HELD", 3)
    piece = cut(tied, ["key"], [F.col("at"), *numbers(tied, ["id"])], depth=100)
    sizes = [r["count"] for r in piece.rows.groupBy(SEGMENT).count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 2 * 100
    out = ordered.ranks(tied, ["key"], "at", ["id"], F.col("at"))
    w = W.partitionBy("key").orderBy("at", "id")
    want = tied.select("id", F.row_number().over(w), F.dense_rank().over(W.partitionBy("key").orderBy("at")))
    assert sorted(map(tuple, out.select("id", "row_number", "dense_rank").collect())) == sorted(map(tuple, want.collect()))


def test_no_row_is_joined_with_more_cuts_than_one_step_searches(spark, tied, monkeypatch):
    widths, joined = [], segments._joined

    def seen(rows, small, on):
        for field in small.schema:
            if field.dataType.typeName() == "array":
                widths.append(small.agg(F.max(F.size(field.name))).first()[0])
        return joined(rows, small, on)

    monkeypatch.setattr(segments, "_joined", seen)
    piece = cut(tied, ["key"], [F.col("at"), *numbers(tied, ["id"])], depth=10)
    sizes = [r["count"] for r in piece.rows.groupBy(SEGMENT).count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 2 * 10 and len(sizes) > 400
    assert widths and max(widths) <= 45
    # Segments rise with the order.
    w = W.orderBy(SEGMENT)
    ends = piece.rows.groupBy(SEGMENT).agg(F.min(F.struct("at", "id")).alias("low"), F.max(F.struct("at", "id")).alias("high"))
    assert not ends.withColumn("before", F.lag("high").over(w)).where("before >= low").count()

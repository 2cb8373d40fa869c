"""Joins on time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.columns import length_in_seconds, slot, span


def interval_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, length: str
) -> DataFrame:
    """Pairs whose ``right_at`` lies in ``[left_at - length, left_at]``.

    Time is cut into slots of that length and the slot joins the keys, so a
    key's rows spread over its slots and only rows of the same slot meet. A
    left row looks into two slots and a right row lies in one, so no pair
    comes twice. Works on batches and, with watermarks set, on streams. The
    pairs are the result; where only their number or sum is wanted,
    ``trailing_totals`` gets it without making them.
    """
    own = slot(left, left_at, length)
    ours = left.withColumn("_slot", F.explode(F.array(own - length_in_seconds(length), own)))
    theirs = right.withColumn("_slot", slot(right, right_at, length))
    met = ours.join(theirs, [*keys, "_slot"])
    near = F.col(right_at).between(F.col(left_at) - span(length), F.col(left_at))
    return met.where(near).drop("_slot")

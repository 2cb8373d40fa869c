"""Column helpers shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def money(column: str, scale: int = 2) -> Column:
    """A double amount as a decimal, whose sums do not depend on row order."""
    return F.col(column).cast(f"decimal(18,{scale})")


def net_price() -> Column:
    """A line's price after discount."""
    return (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")


def seconds(df: DataFrame, column: str) -> Column:
    """Exact seconds since 1970 of a timestamp, with or without a time zone.

    For a zone-free timestamp the result does not depend on the session's zone.
    Eighteen digits keep the decimal in a long.
    """
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        since = F.col(column) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return since.cast("interval second").cast("decimal(18,6)")
    return (F.unix_micros(column) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")


def slot(df: DataFrame, column: str, length: str) -> Column:
    """The start, in seconds since 1970, of the ``length``-wide slot a time lies in."""
    whole = F.floor(seconds(df, column)).cast("bigint")
    return whole - F.pmod(whole, F.lit(length_in_seconds(length)))


def span(length: str) -> Column:
    """A day-time interval such as ``1 hour`` or ``7 days``."""
    return F.expr(f"INTERVAL {length}")


def length_in_seconds(length: str) -> int:
    """``1 hour`` or ``7 days`` as seconds."""
    number, unit = length.split()
    each = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(number) * each[unit.rstrip("s")]


def json_int(column: str, path: str) -> Column:
    return F.get_json_object(column, path).cast("bigint")

"""Ordered work per key that does not depend on how large a key is.

See :mod:`tidewheel.operators.segments` for how large keys are split. In every
operator ``axis`` is a number that never falls along the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.columns import length_in_seconds, seconds, span
from tidewheel.operators.segments import AHEAD, BEFORE, BEHIND, LARGE, SEGMENT, SO_FAR, Cut, cut, numbers


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    axis: Column,
    totals: dict[str, str],
    peers: bool = False,
    parts: int | None = None,
    basis: DataFrame | None = None,
) -> DataFrame:
    """Sums from a key's first row up to each row; ``totals`` maps new to summed column.

    With ``peers``, rows equal in ``order`` enter together, as in a RANGE frame.
    """
    # Peers enter together, so a cut may not part them.
    axes = [axis] if peers or basis is not None else [axis, *numbers(df, order[1:])]
    piece = cut(df, keys, axes, parts, basis=basis)
    frame = piece.window(*order)
    frame = frame.rangeBetween(*SO_FAR) if peers else frame.rowsBetween(*SO_FAR)
    sums = {new: F.sum(c).over(frame) for new, c in totals.items()}
    rows = piece.rows
    if piece.split:
        summed = sorted(set(totals.values()))
        per_segment = piece.summary(*[F.sum(c).alias(c) for c in summed])
        kind = {c: per_segment.schema[c].dataType for c in summed}
        ahead = piece.across().rowsBetween(*BEFORE)
        carry = per_segment.select(
            *piece.groups, *[F.sum(c).over(ahead).alias(f"_ahead_{c}") for c in summed]
        )
        rows = piece.stacked((AHEAD, carry))
        for new, c in totals.items():
            start = F.first(f"_ahead_{c}").over(frame)
            both = F.coalesce(sums[new] + start, sums[new], start)
            # Summing sums widens a decimal; the type must not depend on a split.
            sums[new] = both.cast(kind[c])
        return piece.own(rows.withColumns(sums)).drop(*[f"_ahead_{c}" for c in summed])
    return rows.withColumns(sums)


def ranks(
    df: DataFrame,
    keys: list[str],
    by: str,
    ties: list[str],
    axis: Column,
    descending: bool = False,
    dense: bool = True,
    parts: int | None = None,
) -> DataFrame:
    """Adds ``row_number``, ``group_rows`` and, if ``dense``, ``dense_rank`` over ``by``.

    ``ties`` completes the order for ``row_number``. Nulls come first, and
    ``axis`` rises with ``by`` whether or not the order is ``descending``.
    """
    return _ranks(cut(df, keys, [axis, *numbers(df, ties)], parts, descending), by, ties, descending, dense)


def _ranks(piece: Cut, by: str, ties: list[str], descending: bool, dense: bool) -> DataFrame:
    value = F.desc_nulls_first(by) if descending else F.asc_nulls_first(by)
    rows, group = piece.rows, piece.groups
    if piece.split:
        # One column that is never null, by which window, summary and join are all shuffled alike.
        rows, group = rows.withColumn("_segment_key", F.struct(*piece.groups)), ["_segment_key"]
    in_group = W.partitionBy(*group)
    added = {
        "row_number": F.row_number().over(in_group.orderBy(value, *ties)).cast("bigint"),
        "group_rows": F.count("*").over(in_group),
    }
    if dense:
        added["dense_rank"] = F.dense_rank().over(in_group.orderBy(value)).cast("bigint")
    ranked = rows.withColumns(added)
    if not piece.split:
        return ranked
    if dense:
        # Read from the ranked rows with the order's columns alone, which are shuffled a second time.
        held = F.struct(by)
        first, last = F.col("row_number") == 1, F.col("row_number") == F.col("group_rows")
        sizes = ranked.groupBy("_segment_key").agg(
            F.max("group_rows").alias("_rows"),
            F.max("dense_rank").alias("_values"),
            F.first(F.when(first, held), ignorenulls=True).alias("_first"),
            F.first(F.when(last, held), ignorenulls=True).alias("_last"),
            F.max(f"_segment_key.{SEGMENT}").alias("_at"),
        ).where("_at > 0")
        sizes = sizes.select("_segment_key", "_rows", "_values", "_first", "_last", "_segment_key.*")
        # A value that goes on from the segment before has been counted there.
        again = F.lag("_last").over(piece.across()) == F.col("_first")
        sizes = sizes.withColumn("_again", F.coalesce(again, F.lit(False)).cast("bigint"))
    else:
        sizes = piece.summary(F.count("*").alias("_rows")).withColumn("_segment_key", F.struct(*piece.groups))
    ahead = piece.across().rowsBetween(*BEFORE)
    offsets = {
        "_rows_ahead": F.coalesce(F.sum("_rows").over(ahead), F.lit(0)),
        "_key_rows": F.sum("_rows").over(W.partitionBy(*piece.keys)),
    }
    if dense:
        offsets["_values_ahead"] = F.coalesce(F.sum("_values").over(ahead), F.lit(0)) - F.sum("_again").over(
            piece.across().rowsBetween(*SO_FAR)
        )
    out = ranked.join(sizes.withColumns(offsets).select("_segment_key", *offsets), "_segment_key", "left")
    changed = {
        "row_number": F.col("row_number") + F.coalesce("_rows_ahead", F.lit(0)),
        "group_rows": F.coalesce("_key_rows", "group_rows"),
    }
    if dense:
        changed["dense_rank"] = F.col("dense_rank") + F.coalesce("_values_ahead", F.lit(0))
    return out.withColumns(changed).drop(SEGMENT, LARGE, "_segment_key", *offsets)


def tile(buckets: int) -> Column:
    """``ntile`` from the columns that :func:`ranks` adds."""

    def whole(number: Column, by: Column) -> Column:
        return ((number - number % by) / by).cast("bigint")

    rows, number = F.col("group_rows"), F.col("row_number")
    each, longer = whole(rows, F.lit(buckets)), rows % buckets
    in_longer = longer * (each + 1)
    early = whole(number - 1, each + 1) + 1
    late = longer + whole(number - in_longer - 1, F.greatest(each, F.lit(1))) + 1
    return F.when(number <= in_longer, early).otherwise(late)


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    axis: Column,
    columns: list[str],
    parts: int | None = None,
) -> DataFrame:
    """Adds ``prev_c`` and ``next_c`` for each column: lag and lead by one row."""
    piece = cut(df, keys, [axis, *numbers(df, order[1:])], parts)
    rows = piece.rows
    if piece.split:
        held, place = F.struct(*columns), F.struct(*order)
        ends = piece.summary(
            F.min_by(held, place).alias("_first"), F.max_by(held, place).alias("_last")
        )
        carried = ends.select(
            *piece.groups,
            F.lag("_last").over(piece.across()).alias("_last"),
            F.lead("_first").over(piece.across()).alias("_first"),
        )
        before = carried.where("_last is not null").select(*piece.groups, "_last.*")
        after = carried.where("_first is not null").select(*piece.groups, "_first.*")
        rows = piece.stacked((AHEAD, before), (BEHIND, after))
    w = piece.window(*order)
    added = {f"prev_{c}": F.lag(c).over(w) for c in columns}
    added |= {f"next_{c}": F.lead(c).over(w) for c in columns}
    return piece.own(rows.withColumns(added))


def last_seen(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    axis: Column,
    column: str,
    new: str,
    parts: int | None = None,
) -> DataFrame:
    """Adds the latest non-null ``column`` up to and including each row."""
    piece = cut(df, keys, [axis, *numbers(df, order[1:])], parts)
    rows = piece.rows
    if piece.split:
        place = F.when(F.col(column).isNotNull(), F.struct(*order))
        lasts = piece.summary(F.max_by(column, place).alias(column))
        ahead = piece.across().rowsBetween(*BEFORE)
        carry = lasts.select(
            *piece.groups, F.last(column, ignorenulls=True).over(ahead).alias(column)
        )
        rows = piece.stacked((AHEAD, carry.where(F.col(column).isNotNull())))
    so_far = piece.window(*order).rowsBetween(*SO_FAR)
    return piece.own(rows.withColumn(new, F.last(column, ignorenulls=True).over(so_far)))


def trailing_rows(
    df: DataFrame,
    keys: list[str],
    by: str,
    ties: list[str],
    axis: Column,
    rows: int,
    aggregates: dict[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """Aggregates over each row and the ``rows - 1`` before it (a ROWS frame).

    A large key is numbered first and then cut every so many rows; the last
    rows of each block are repeated ahead of the next one.
    """
    piece = cut(df, keys, [axis, *numbers(df, ties)], parts)
    frame = (1 - rows, W.currentRow)
    if not piece.split:
        w = W.partitionBy(*keys).orderBy(by, *ties).rowsBetween(*frame)
        return df.withColumns({new: a.over(w) for new, a in aggregates.items()})
    block = max(piece.per_segment, rows)
    numbered = _ranks(piece, by, ties, descending=False, dense=False)
    home = F.floor((F.col("row_number") - 1) / block)
    near_end = (F.col("row_number") - 1) % block > block - rows
    copies = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    spread = numbered.withColumn("_home", home).withColumn("_block", F.explode(copies))
    w = W.partitionBy(*keys, "_block").orderBy("row_number").rowsBetween(*frame)
    out = spread.withColumns({new: a.over(w) for new, a in aggregates.items()})
    return out.where("_block = _home").drop("_home", "_block", "row_number", "group_rows")


def trailing_totals(
    df: DataFrame,
    keys: list[str],
    at: str,
    length: str,
    totals: dict[str, Column],
    where: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """For each row, sums over the key's rows in ``[at - length, at]`` (a RANGE frame).

    As in SQL, a sum over no amounts but nulls is null; where an amount cannot be
    null, as a literal, the total is a count and starts at 0. Rows with a null key
    or time are each other's peers; leave them out with ``where`` to compare as a
    predicate does. Amounts must be exact numbers.

    ``where`` limits which rows are summed, so the rows of one kind can look
    back on those of another. Each summed row is added at its own time and
    taken off again once ``length`` has passed, which makes the moving sums
    running ones: the work grows with the rows, not with the pairs of rows
    that lie within ``length`` of each other.
    """
    kinds = df.select(*[c.alias(new) for new, c in totals.items()]).schema
    for field in kinds:
        # What is added is taken off again, which only exact numbers survive.
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            raise ValueError(f"{field.name} must be a whole number or a decimal, not {field.dataType.simpleString()}")
    where = F.lit(True) if where is None else where
    held = F.struct(*df.columns)
    now = seconds(df, at)
    later = now + F.lit(length_in_seconds(length)).cast("decimal(18,6)")
    amounts = {f"_{new}": F.coalesce(F.when(where, c), F.lit(0)) for new, c in totals.items()}
    # How many amounts are in a sum that may have none.
    sums = [new for new in totals if kinds[new].nullable]
    amounts |= {
        f"_n_{new}": F.when(where & totals[new].isNotNull(), 1).otherwise(0).cast("bigint")
        for new in sums
    }

    def mark(time: Column, gone: bool) -> Column:
        return F.struct(
            time.cast("decimal(18,6)").alias("_at"),
            F.lit(gone).alias("_gone"),
            *[(-amount if gone else amount).alias(name) for name, amount in amounts.items()],
        )

    # A row at exactly `at - length` still counts, so what leaves at an
    # instant leaves after what arrives then.
    marks = F.when(where, F.array(mark(now, False), mark(later, True))).otherwise(
        F.array(mark(now, False))
    )
    timeline = df.select(*keys, held.alias("_row"), F.explode(marks).alias("_mark")).select(
        *keys, F.when(~F.col("_mark._gone"), F.col("_row")).alias("_row"), "_mark.*"
    )
    summed = running_totals(
        timeline,
        keys,
        ["_at", "_gone"],
        F.col("_at"),
        {name: f"_{name}" for name in (*totals, *(f"n_{new}" for new in sums))},
        peers=True,
        parts=parts,
        basis=df.select(*keys, now.alias("_at")),
    )
    return summed.where(~F.col("_gone")).select(
        "_row.*",
        *[F.when(F.col(f"n_{new}") > 0, F.col(new)).alias(new) if new in sums else new for new in totals],
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_at: str,
    right_at: str,
    columns: list[str],
    tie: str,
    within: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Every left row with the right row that is the last at or before its time.

    ``columns`` are the right columns to add, null where there is none (or none
    ``within`` that length); ``tie`` orders right rows of the same time. As in
    any join, a null key or time has no match.
    """
    held = F.struct(*left.columns)
    found = F.struct(F.col(right_at).alias("_found_at"), *columns)
    ours = left.select(
        *keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), held.alias("_row")
    )
    theirs = right.dropna(subset=[*keys, right_at]).select(
        *keys,
        F.col(right_at).alias("_at"),
        F.lit(0).alias("_side"),
        F.col(tie).alias("_tie"),
        found.alias("_found"),
    )
    both = ours.unionByName(theirs, allowMissingColumns=True)
    seen = last_seen(
        both, keys, ["_at", "_side", "_tie"], seconds(both, "_at"), "_found", "_match", parts
    )
    match = F.col("_match")
    if within:
        match = F.when(F.col("_match._found_at") >= F.col("_at") - span(within), match)
    return seen.where("_side = 1").withColumn("_match", match).select(
        "_row.*", *[F.col(f"_match.{c}").alias(c) for c in columns]
    )

"""Cutting the rows of large keys into ordered segments.

A plain Spark window puts all rows of a key into one task. Here the rows per
key are counted first, in one job with map-side combining. A key is large if it
has more rows than the depth, which the session sets in
``spark.tidewheel.segmentRows`` (default: ``DEPTH``); it does not depend on the
number of shuffle partitions. Without a large key the plain window is used.
Otherwise the rows of the large keys, and only those, are cut into segments of
about the depth along the ordering. What a segment must know of the others (a total,
the last row) comes from a summary with one row per large key and segment, and
enters the segment as one extra row ahead of, or behind, its own rows. Results
do not depend on where the cuts fall.

The cuts are quantiles of each key's axis. A round makes up to ``FAN`` segments of
a key or segment; rounds go on while a segment has more than twice the depth, so
there is no highest number of segments. A value that alone exceeds the depth gets
a segment of its own, which the next axis cuts further, if there is one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.session import shared_folder

SEGMENT = "_segment"
#: Whether a row's key is large. Filters name this and not the segment: Spark moves a filter below the
#: steps that find the segment, and puts what they compute in its place.
LARGE = "_large"
ROLE = "_role"
AHEAD, OWN, BEHIND = -1, 0, 1

DEPTH_CONF = "spark.tidewheel.segmentRows"
DEPTH = 1_000_000
# Segments that one round makes of one.
FAN = 1000
# Numbers of a round's segments: one below, at and above each cut.
BASE = 2 * FAN + 1
# Cuts are searched in two steps, first among every so many; its square is no less than ``BASE``.
STEP = 45
# Keys, and cuts of all keys, that may pass the driver and be broadcast; more stay tables.
HELD = 100_000

BEFORE = (W.unboundedPreceding, -1)
SO_FAR = (W.unboundedPreceding, W.currentRow)


@dataclass(frozen=True)
class Cut:
    """Rows with their segment: above 0 for the rows of large keys, else 0."""

    rows: DataFrame
    keys: list[str]
    split: bool
    per_segment: int

    @property
    def groups(self) -> list[str]:
        return [*self.keys, SEGMENT] if self.split else self.keys

    def window(self, *order: Column | str) -> WindowSpec:
        return W.partitionBy(*self.groups).orderBy(*([ROLE] if self.split else []), *order)

    def summary(self, *aggregates: Column) -> DataFrame:
        """One row for each segment of each large key."""
        return self.rows.where(LARGE).groupBy(*self.groups).agg(*aggregates)

    def across(self) -> WindowSpec:
        """Over a summary: a large key's segments in order."""
        return W.partitionBy(*self.keys).orderBy(SEGMENT)

    def stacked(self, *carried: tuple[int, DataFrame]) -> DataFrame:
        """The rows and the carried ones, marked by their role."""
        out = self.rows.withColumn(ROLE, F.lit(OWN))
        for role, extra in carried:
            out = out.unionByName(extra.withColumn(ROLE, F.lit(role)), allowMissingColumns=True)
        return out

    def own(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(ROLE) == OWN).drop(SEGMENT, LARGE, ROLE) if self.split else df


def numbers(df: DataFrame, columns: list[str]) -> list[Column]:
    """The first of ``columns`` that are numbers: further axes for :func:`cut`."""
    out = []
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            break
        out.append(F.col(c))
    return out


def _doubles(df: DataFrame, axis: Column, descending: bool) -> tuple[list[Column], bool]:
    """The axis as doubles that order as it does, nulls first; and whether only equal values are equal in all.

    A double cannot hold every whole number or decimal, so those are taken in two parts. Nulls and
    NaN would meet the infinities, so doubles have a first axis that tells them apart.
    """
    kind = df.select(axis.alias("_a")).schema["_a"].dataType
    low, exact, first = F.lit(float("-inf")), True, []
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        nan, usual = (1.0, 2.0) if descending else (2.0, 1.0)
        first = [F.when(axis.isNull(), 0.0).when(F.isnan(axis), nan).otherwise(usual)]
        places = [F.nanvl(axis.cast("double"), F.lit(0.0))]
    elif isinstance(kind, T.LongType):
        places = [F.shiftright(axis, 32), axis.bitwiseAND(F.lit(0xFFFFFFFF))]
    elif isinstance(kind, T.DecimalType) and max(kind.precision - kind.scale, kind.scale) <= 15:
        places = [F.floor(axis), axis - F.floor(axis)] if kind.scale else [axis]
    else:
        places, exact = [axis], isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType))
    places = [p.cast("double") for p in places]
    return [*first, *[F.coalesce(-p if descending else p, low) for p in places]], exact


def _pinned(df: DataFrame, weight: str | None = None) -> tuple[DataFrame, int]:
    """``df``, computed once, ready to be joined; and its rows if they passed the driver, else -1.

    Up to ``HELD`` rows (or the sum of ``weight``) are broadcast; more are written to the shared folder.
    """
    held = df.limit(HELD + 1).toArrow() if weight is None else None
    if weight:
        total = df.agg(F.sum(weight)).first()[0] or 0
        held = df.toArrow() if total <= HELD else None
    if held is not None and held.num_rows <= HELD:
        return F.broadcast(df.sparkSession.createDataFrame(held, df.schema)), held.num_rows
    path = shared_folder(df.sparkSession, "cuts")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), -1


def _joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which nulls are equal, with the other columns of ``small``."""
    named = small.withColumnsRenamed({c: f"_key{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_key{c}")) for c in on]
    return rows.join(named, same, "left").drop(*[f"_key{c}" for c in on])


def _too_large(points: DataFrame, by: list[str], axes: list[str], above: float) -> DataFrame:
    """The groups with more rows than ``above`` that can be cut, and which axis cuts them: the first that varies."""
    found = points.groupBy(*by).agg(
        F.count("*").alias("_n"),
        *[F.min(a).alias(f"_low{a}") for a in axes],
        *[F.max(a).alias(f"_high{a}") for a in axes],
    )
    which = F.lit(None).cast("int")
    for i, a in reversed(list(enumerate(axes))):
        which = F.when(F.col(f"_low{a}") < F.col(f"_high{a}"), F.lit(i)).otherwise(which)
    return found.where(F.col("_n") > above).select(*by, "_n", which.alias("_which")).where("_which is not null")


def _value(axes: list[str]) -> Column:
    value = F.lit(None).cast("double")
    for i, a in enumerate(axes):
        value = F.when(F.col("_which") == i, F.col(a)).otherwise(value)
    return value


def _cuts(points: DataFrame, large: DataFrame, by: list[str], axes: list[str], depth: float) -> DataFrame:
    """Where the ``large`` groups are cut: numbers, and whether rows equal to one lie before the cut."""
    steps = F.array(*[F.lit(i / FAN) for i in range(1, FAN)])
    points = _joined(points, large, by).where("_which is not null")
    found = points.groupBy(*by, "_which", "_n").agg(F.percentile_approx(_value(axes), steps, 10 * FAN).alias("_places"))
    stride = F.greatest(F.floor(F.lit(FAN * depth) / F.col("_n")), F.lit(1))
    thin = F.expr("filter(_places, (x, i) -> (i + 1) % _stride = 0)")
    found = found.withColumn("_stride", stride).select(*by, "_which", thin.alias("_thin"))
    # A place met twice is one value of more than the depth: it is cut off on both sides.
    cuts = F.expr(
        "flatten(transform(array_distinct(_thin), x -> if(size(filter(_thin, y -> y = x)) > 1,"
        " array(struct(x as at, false as with), struct(x as at, true as with)), array(struct(x as at, true as with)))))"
    )
    return found.select(*by, "_which", cuts.alias("_cuts")).withColumn("_many", F.size("_cuts")).where("_many > 0")


def _passed(cuts: str) -> Column:
    """How many of up to ``STEP`` cuts lie before the row, found by halving; none if there are no cuts."""
    c = f"get({cuts}, k + s - 1)"
    strides = ", ".join(str(1 << i) for i in reversed(range(STEP.bit_length())))
    return F.expr(
        f"aggregate(array({strides}), 0, (k, s) -> if(k + s <= size({cuts})"
        f" and (_value > {c}.at or (_value = {c}.at and not {c}.with)), k + s, k))"
    )


def _cut_once(rows: DataFrame, cuts: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """The rows with the segment's number refined by one round of cuts.

    A row's place is the number of cuts before it: first among every ``STEP``-th, then among those that follow.
    Each row is joined with ``STEP`` cuts at a time, since Spark copies into it what it is searched in.
    """
    starts = f"sequence(0, _many - 1, {STEP})"
    heads = cuts.select(*by, "_which", F.expr(f"transform({starts}, i -> _cuts[i])").alias("_heads"))
    runs = F.expr(f"transform({starts}, i -> struct(cast(i / {STEP} as int) + 1 as step, i as ahead, slice(_cuts, i + 1, {STEP}) as run))")
    runs = cuts.select(*by, F.explode(runs).alias("_one")).select(
        *by, F.col("_one.step").alias("_step"), F.col("_one.ahead").alias("_ahead"), F.col("_one.run").alias("_run")
    )
    rows = _joined(rows, heads, by).withColumn("_value", _value(axes)).withColumn("_step", _passed("_heads"))
    rows = _joined(rows.drop("_which", "_heads"), runs, [*by, "_step"])
    number = F.col(SEGMENT) * BASE + F.coalesce("_ahead", F.lit(0)) + _passed("_run")
    return rows.withColumn(SEGMENT, number.cast("bigint")).drop("_value", "_step", "_ahead", "_run")


def cut(
    df: DataFrame,
    keys: list[str],
    axis: Column | list[Column],
    parts: int | None = None,
    descending: bool = False,
    basis: DataFrame | None = None,
    depth: float | None = None,
) -> Cut:
    """Split the large keys along ``axis``, a number that never falls along the order.

    For a ``descending`` order the first axis never rises. Nulls come first either way.
    Further axes order the rows that are equal in those before. ``parts`` asks for a
    depth of that share of all rows in place of the session's. ``basis``, with the same
    keys and axes, is measured in place of ``df`` where that is cheaper and gives much the
    same sizes. What is measured is computed again for each round, so give saved or cheap input.
    """
    spark = df.sparkSession
    basis = df if basis is None else basis
    depth = depth or float(spark.conf.get(DEPTH_CONF, str(DEPTH)))
    if parts or not keys:
        total = basis.count()
        depth = max(1.0, total / parts) if parts else depth
        if not keys and total <= depth:
            return Cut(df, keys, False, int(depth))
    known = None
    if keys:
        counts = basis.groupBy(*keys).agg(F.count("*").alias("_n"))
        known, n = _pinned(counts.where(F.col("_n") > depth).select(*keys, F.lit(True).alias(LARGE)))
        if not n:
            return Cut(df, keys, False, int(depth))

    axes: dict[str, Column] = {}
    for i, a in enumerate([axis] if isinstance(axis, Column) else axis):
        found, exact = _doubles(df, a, descending and not i)
        axes |= {f"_axis{len(axes) + j}": x for j, x in enumerate(found)}
        if not exact:
            break

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns(axes)
        if known is None:
            # Always 1, but no constant, by which a join would become a loop over pairs.
            return rows.withColumn(SEGMENT, F.pmod(F.xxhash64(next(iter(axes))), F.lit(1)) + 1).withColumn(LARGE, F.lit(True))
        rows = _joined(rows, known, keys).withColumn(LARGE, F.coalesce(LARGE, F.lit(False)))
        return rows.withColumn(SEGMENT, F.when(F.col(LARGE), 1).otherwise(0).cast("bigint"))

    by, names = [*keys, SEGMENT], list(axes)
    rows, points = placed(df), placed(basis).select(*by, LARGE, *names)
    above = depth
    while True:
        # Only groups still too large are measured along their axis.
        large, n = _pinned(_too_large(points.where(LARGE), by, names, above))
        if not n:
            break
        found, _ = _pinned(_cuts(points.where(LARGE), large, by, names, depth), "_many")
        rows, points = _cut_once(rows, found, by, names), _cut_once(points, found, by, names)
        above = 2 * depth
    return Cut(rows.drop(*names), keys, True, max(1, int(depth)))

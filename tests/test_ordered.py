"""The ordered operators against pandas, on keys that must be split."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.functions.columns import seconds
from tidewheel.operators import ordered
from tidewheel.operators.segments import SEGMENT, cut


@pytest.fixture(scope="module")
def skewed():
    """600 rows: key 1 has a third of them, key None a fifth; times repeat."""
    rng = np.random.default_rng(3)
    n = 600
    key = rng.integers(2, 60, n).astype(object)
    key[: n // 3] = 1
    key[n // 3 : n // 3 + n // 5] = None
    minutes = rng.integers(0, 400, n)
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "key": key,
            "ts": [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=int(m)) for m in minutes],
            "v": [Decimal(int(x)) for x in rng.integers(-50, 50, n)],
            "kind": rng.choice(["a", "b"], n),
        }
    ).sample(frac=1, random_state=1)


@pytest.fixture(scope="module")
def df(spark, skewed):
    rows = [
        (int(r.id), None if r.key is None else int(r.key), r.ts.to_pydatetime(), r.v, r.kind)
        for r in skewed.itertuples()
    ]
    schema = "id bigint, key bigint, ts timestamp_ntz, v decimal(18,2), kind string"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


def axis(df):
    return seconds(df, "ts")


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def groups(pdf):
    for _, group in pdf.assign(key=pdf.key.map(lambda k: -1 if k is None else k)).groupby("key"):
        yield group.sort_values(["ts", "id"])


PARTS = [2, 8, 40]


@pytest.mark.parametrize("parts", PARTS)
def test_large_keys_are_cut_and_the_others_are_not(df, parts):
    piece = cut(df, ["key"], axis(df), parts)
    assert piece.split == (parts > 2)
    if piece.split:
        sizes = piece.rows.groupBy("key", SEGMENT).count().collect()
        assert sum(r["count"] for r in sizes) == 600
        assert max(r["count"] for r in sizes) <= 2 * 600 / parts + 15
        total = {}
        for r in sizes:
            total[r["key"]] = total.get(r["key"], 0) + r["count"]
        for r in sizes:
            assert (r[SEGMENT] > 0) == (total[r["key"]] * parts > 600)


@pytest.mark.parametrize("parts", PARTS)
def test_running_totals(df, skewed, parts):
    got = by_id(
        ordered.running_totals(df, ["key"], ["ts", "id"], axis(df), {"t": "v"}, parts=parts), "t"
    )
    want = {}
    for g in groups(skewed):
        want |= dict(zip(g.id, ((t,) for t in g.v.cumsum())))
    assert got == want


@pytest.mark.parametrize("parts", PARTS)
def test_ranks_and_tiles(df, skewed, parts):
    out = ordered.ranks(df, ["key"], "ts", ["id"], axis(df), parts=parts)
    out = out.withColumn("tile", ordered.tile(7))
    got = by_id(out, "row_number", "dense_rank", "group_rows", "tile")
    want = {}
    for g in groups(skewed):
        dense = g.ts.rank(method="dense").astype(int)
        tiles = np.concatenate([[i + 1] * len(x) for i, x in enumerate(np.array_split(g.id, 7))])
        for i, (r, d, t) in enumerate(zip(g.id, dense, tiles)):
            want[r] = (i + 1, d, len(g), int(t))
    assert got == want


def test_ranks_descending_without_keys(df, skewed):
    out = ordered.ranks(df, [], "v", ["id"], F.col("v").cast("double"), True, parts=5)
    got = by_id(out, "row_number", "dense_rank", "group_rows")
    s = skewed.assign(n=-skewed.v.astype(int)).sort_values(["n", "id"])
    dense = s.n.rank(method="dense").astype(int)
    want = {r: (i + 1, d, 600) for i, (r, d) in enumerate(zip(s.id, dense))}
    assert got == want


@pytest.mark.parametrize("parts", PARTS)
def test_neighbours(df, skewed, parts):
    out = ordered.neighbours(df, ["key"], ["ts", "id"], axis(df), ["ts", "id"], parts=parts)
    got = by_id(out, "prev_id", "next_id", "prev_ts")
    want = {}
    for g in groups(skewed):
        ids, ts = list(g.id), [t.to_pydatetime() for t in g.ts]
        for i, r in enumerate(ids):
            want[r] = (
                ids[i - 1] if i else None,
                ids[i + 1] if i + 1 < len(ids) else None,
                ts[i - 1] if i else None,
            )
    assert got == want


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("rows", [1, 3, 20])
def test_trailing_rows(df, skewed, parts, rows):
    out = ordered.trailing_rows(
        df, ["key"], "ts", ["id"], axis(df), rows, {"low": F.min("v"), "n": F.count("*")}, parts
    )
    got = by_id(out, "low", "n")
    want = {}
    for g in groups(skewed):
        v = list(g.v)
        for i, r in enumerate(g.id):
            part = v[max(0, i - rows + 1) : i + 1]
            want[r] = (min(part), len(part))
    assert got == want


@pytest.mark.parametrize("parts", PARTS)
def test_trailing_totals(df, skewed, parts):
    out = ordered.trailing_totals(
        df, ["key"], "ts", "45 minutes", {"s": F.col("v"), "n": F.lit(1)}, parts=parts
    )
    got = by_id(out, "s", "n")
    want = {}
    for g in groups(skewed):
        for r in g.itertuples():
            part = g[(g.ts <= r.ts) & (g.ts >= r.ts - pd.Timedelta(minutes=45))]
            want[r.id] = (part.v.sum(), len(part))
    assert got == want


def test_trailing_totals_of_another_kind(df, skewed):
    out = ordered.trailing_totals(
        df, ["key"], "ts", "1 hour", {"n": F.lit(1)}, F.col("kind") == "a", 8
    ).where("kind = 'b'")
    got = by_id(out, "n")
    want = {}
    for g in groups(skewed):
        a = g[g.kind == "a"]
        for r in g[g.kind == "b"].itertuples():
            want[r.id] = (((a.ts <= r.ts) & (a.ts >= r.ts - pd.Timedelta(hours=1))).sum(),)
    assert got == want


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("within", [None, "10 minutes"])
def test_asof_join(df, skewed, parts, within):
    left = df.where("kind = 'b'").select("id", "key", "ts")
    right = df.where("kind = 'a'").select("key", F.col("id").alias("rid"), F.col("ts").alias("rts"))
    out = ordered.asof_join(left, right, ["key"], "ts", "rts", ["rid", "rts"], "rid", within, parts)
    got = by_id(out, "rid", "rts")
    want = {}
    for g in groups(skewed):
        a = g[g.kind == "a"]
        for r in g[g.kind == "b"].itertuples():
            seen = a[(a.ts <= r.ts) & (r.key != -1)]  # a null key has no match
            if within:
                seen = seen[seen.ts >= r.ts - dt.timedelta(minutes=10)]
            last = seen.iloc[-1] if len(seen) else None
            want[r.id] = (None, None) if last is None else (last.id, last.ts.to_pydatetime())
    assert got == want


def test_null_values_are_carried_like_spark_does(spark):
    draw = np.random.default_rng(8)
    rows = [(i, None if draw.random() < 0.7 else int(draw.integers(0, 9))) for i in range(80)]
    frame = spark.createDataFrame(rows, "id bigint, v bigint")
    frame.createOrReplaceTempView("sparse")
    want = spark.sql(
        "select id, sum(v) over (order by id) as s, last(v, true) over (order by id) as l,"
        " lag(v) over (order by id) as p, lead(v) over (order by id) as n from sparse"
    )
    place = F.col("id")
    s = ordered.running_totals(frame, [], ["id"], place, {"s": "v"}, parts=10)
    assert by_id(s, "s") == by_id(want, "s")
    last = ordered.last_seen(frame, [], ["id"], place, "v", "l", parts=10)
    assert by_id(last, "l") == by_id(want, "l")
    near = ordered.neighbours(frame, [], ["id"], place, ["v"], parts=10)
    assert by_id(near, "prev_v", "next_v") == by_id(want, "p", "n")


def test_types_do_not_depend_on_a_split(df):
    builds = [
        lambda parts: ordered.running_totals(df, ["key"], ["ts", "id"], axis(df), {"t": "v"}, parts=parts),
        lambda parts: ordered.ranks(df, ["key"], "ts", ["id"], axis(df), parts=parts),
        lambda parts: ordered.neighbours(df, ["key"], ["ts", "id"], axis(df), ["v"], parts),
        lambda parts: ordered.trailing_rows(
            df, ["key"], "ts", ["id"], axis(df), 3, {"s": F.sum("v")}, parts
        ),
        lambda parts: ordered.trailing_totals(df, ["key"], "ts", "1 hour", {"s": F.col("v")}, parts=parts),
    ]
    for build in builds:
        assert build(2).dtypes == build(40).dtypes


def test_empty_input(df):
    none = df.where("id < 0")
    assert ordered.running_totals(none, ["key"], ["ts"], axis(df), {"t": "v"}).count() == 0
    assert ordered.ranks(none, [], "ts", ["id"], axis(df)).count() == 0


def test_ranks_with_null_and_nan(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), 1.0, 1.0, 2.5, None, -3.0] * 3
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "id bigint, v double")
    frame.createOrReplaceTempView("odd")
    for descending, direction in ((False, "ASC"), (True, "DESC")):
        want = spark.sql(
            f"select id, row_number() over (order by v {direction} nulls first, id) as r,"
            f" dense_rank() over (order by v {direction} nulls first) as d from odd"
        )
        out = ordered.ranks(frame, [], "v", ["id"], F.col("v"), descending, parts=5)
        assert by_id(out, "row_number", "dense_rank") == by_id(want, "r", "d")

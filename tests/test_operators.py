"""Joins, time windows and multisets against brute force, with one frequent key."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import multisets
from tidewheel.operators.joins import interval_join
from tidewheel.operators.timewindows import sessions, sliding, tumbling

START = dt.datetime(2024, 3, 1)
MINUTE = dt.timedelta(minutes=1)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    return [
        (i, 1 if i % 3 == 0 else draw.randrange(2, 30), START + draw.randrange(3000) * MINUTE, draw.randrange(9))
        for i in range(500)
    ]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id bigint, key bigint, ts timestamp_ntz, v bigint").cache()


def test_interval_join(df, rows):
    left = df.where("id % 2 = 0").select("id", "key", "ts")
    right = df.where("id % 2 = 1").select(F.col("id").alias("rid"), "key", F.col("ts").alias("rts"))
    got = sorted((r["id"], r["rid"]) for r in interval_join(left, right, ["key"], "ts", "rts", "20 minutes").collect())
    want = sorted(
        (a[0], b[0])
        for a in rows
        for b in rows
        if a[0] % 2 == 0 and b[0] % 2 == 1 and a[1] == b[1] and a[2] - 20 * MINUTE <= b[2] <= a[2]
    )
    assert want and got == want


def test_tumbling(df, rows):
    got = {
        (r["window_start"], r["key"]): (r["n"], r["s"])
        for r in tumbling(df, "ts", "1 hour", ["key"], {"n": F.lit(1), "s": F.col("v")}).collect()
    }
    want = defaultdict(lambda: (0, 0))
    for _, key, ts, v in rows:
        hour = ts.replace(minute=0)
        n, s = want[hour, key]
        want[hour, key] = (n + 1, s + v)
    assert got == dict(want)


@pytest.mark.parametrize("panes", [1, 4])
def test_sliding(df, rows, panes):
    out = sliding(df, "ts", f"{panes * 30} minutes", "30 minutes", ["key"], {"n": F.lit(1), "s": F.col("v")})
    got = {(r["window_start"], r["window_end"], r["key"]): (r["n"], r["s"]) for r in out.collect()}
    want = defaultdict(lambda: (0, 0))
    for _, key, ts, v in rows:
        pane = ts - (ts - START) % (30 * MINUTE)
        for back in range(panes):
            start = pane - back * 30 * MINUTE
            n, s = want[start, start + panes * 30 * MINUTE, key]
            want[start, start + panes * 30 * MINUTE, key] = (n + 1, s + v)
    assert got == dict(want)


def test_sliding_needs_whole_panes(df):
    with pytest.raises(ValueError):
        sliding(df, "ts", "50 minutes", "30 minutes", [], {"n": F.lit(1)})


@pytest.mark.parametrize("gap", [1, 7, 60])
def test_sessions(df, rows, gap):
    out = sessions(df, ["key"], "ts", f"{gap} minutes", {"n": F.lit(1), "s": F.col("v")})
    got = sorted((r["key"], r["session_start"], r["session_end"], r["n"], r["s"]) for r in out.collect())
    want, last = [], {}
    for _, key, ts, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if key in last and ts - last[key][2] <= gap * MINUTE:
            s = last[key]
            s[2], s[3], s[4] = ts, s[3] + 1, s[4] + v
        else:
            last[key] = [key, ts, ts, 1, v]
            want.append(last[key])
    assert got == sorted(tuple(s) for s in want)


@pytest.mark.parametrize("per_row", [1, 3, 1_000_000])
def test_except_all(spark, per_row):
    left = [1] * 10 + [2] * 4 + [3] + [None] * 5
    right = [1] * 3 + [2] * 9 + [4] + [None]
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "k int")
    out = multisets.except_all(frame(left), frame(right), per_row)
    assert Counter(r["k"] for r in out.collect()) == Counter(left) - Counter(right)


def test_intersect(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k int, s string")
    right = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "d")], "k int, s string")
    assert sorted(tuple(r) for r in multisets.intersect(left, right).collect()) == [(1, "a"), (2, None)]

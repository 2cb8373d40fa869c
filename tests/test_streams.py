"""Streams in several batches, with late, repeated and reordered rows."""

import datetime as dt
import os
import tempfile
from collections import Counter
from decimal import Decimal

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewheel import plans
from tidewheel.plans.streams import BATCH_CONF, ROWS_CONF
from tidewheel.sources.tables import stream
from tidewheel.streaming import events as streams
from tidewheel.streaming.runs import run_to_files, stream_session, time_slices

SCHEMA = pa.schema(
    [
        ("event_id", pa.int64()),
        ("ts", pa.timestamp("us")),
        ("user_id", pa.int64()),
        ("event_type", pa.string()),
        ("value", pa.float64()),
        ("props", pa.string()),
    ]
)


def at(text):
    return dt.datetime.fromisoformat(f"2024-01-01 {text}")


def event(number, time, user=1, kind="view", value=1.0):
    return dict(event_id=number, ts=at(time), user_id=user, event_type=kind, value=value, props="{}")


def feed(folder, batches, first=0):
    """One file, and so one micro-batch, for each list of events."""
    os.makedirs(f"{folder}/events.parquet", exist_ok=True)
    for i, batch in enumerate(batches, first):
        path = f"{folder}/events.parquet/{i:03}.parquet"
        pq.write_table(pa.Table.from_pylist(batch, schema=SCHEMA), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


@pytest.fixture
def run(spark):
    """Feeds each list of events as one micro-batch."""

    def go(batches, build):
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        feed(folder, batches)
        source = stream(stream_session(spark), folder, "events", files_per_batch=1)
        return run_to_files(build(source), "test", spark).collect()

    return go


def test_windows_take_late_rows_until_the_watermark(run):
    rows = run(
        [
            [event(1, "00:10:00"), event(2, "00:50:00")],
            [event(3, "00:30:00"), event(4, "01:20:00")],  # 3 is late, its window still open
            [event(5, "03:30:00")],
            [event(6, "03:35:00")],  # this batch writes the first two windows
            [event(7, "00:40:00"), event(8, "03:40:00")],  # 7 comes after its window closed
        ],
        lambda events: streams.closed_windows(events, "1 hour", "1 hour"),
    )
    got = {(r.window_start, r.window_end): (r.n_events, r.total) for r in rows}
    assert got == {
        (at("00:00:00"), at("01:00:00")): (3, Decimal("3.00")),
        (at("01:00:00"), at("02:00:00")): (1, Decimal("1.00")),
    }


def test_repeats_are_dropped_across_batches(run):
    rows = run(
        [
            [event(1, "00:10:00"), event(1, "00:10:00"), event(2, "00:11:00")],
            [event(2, "00:11:00"), event(3, "00:12:00")],
            [event(1, "00:10:00"), event(4, "00:13:00")],
        ],
        lambda events: streams.without_repeats(events, "1 hour"),
    )
    assert sorted(r.event_id for r in rows) == [1, 2, 3, 4]


def test_an_event_delivered_very_often_comes_once(run):
    copies = [event(1, "00:10:00")] * 200
    rows = run(
        [copies + [event(i, "00:11:00") for i in range(2, 50)], copies, [event(50, "00:12:00")] + copies],
        lambda events: streams.without_repeats(events.repartition(4), "1 hour"),
    )
    assert sorted(r.event_id for r in rows) == list(range(1, 51))


def test_join_meets_rows_of_different_batches(run):
    rows = run(
        [
            [event(1, "00:10:00"), event(2, "00:20:00", user=2)],
            [event(3, "01:05:00", kind="purchase"), event(4, "00:59:00")],
            [event(5, "01:30:00", kind="purchase"), event(6, "00:15:00", user=1)],
            [event(7, "01:31:00", user=2, kind="purchase")],
        ],
        lambda events: streams.views_with_purchases(events, "1 hour", "2 hours"),
    )
    pairs = sorted((r.purchase_id, r.view_id) for r in rows)
    assert pairs == [(3, 1), (3, 4), (3, 6), (5, 4)]


def test_sessions_grow_across_batches(run):
    rows = run(
        [
            [event(1, "00:00:00"), event(2, "00:20:00"), event(3, "00:00:00", user=2)],
            [event(4, "01:10:00"), event(5, "00:45:00")],  # 5 is late and joins the two parts
            [event(6, "03:00:00")],
            [event(7, "09:00:00", user=3)],
        ],
        lambda events: streams.closed_sessions(events, "30 minutes", "1 hour"),
    )
    got = sorted((r.user_id, r.session_start, r.session_end, r.n_events) for r in rows)
    assert got == [
        (1, at("00:00:00"), at("01:10:00"), 4),
        (1, at("03:00:00"), at("03:00:00"), 1),
        (2, at("00:00:00"), at("00:00:00"), 1),
    ]


def test_spending_is_kept_across_batches(run):
    def buy(number, time, value, user=1):
        return event(number, time, user, "purchase", value)

    rows = run(
        [
            [buy(1, "00:10:00", 3.0), buy(2, "00:20:00", 2.5, user=2)],
            [buy(3, "02:10:00", 4.0), buy(4, "02:30:00", 9.0, user=2)],
            [buy(5, "04:10:00", 3.5), buy(6, "04:40:00", 2.0)],
            [buy(7, "08:00:00", 50.0)],
            [buy(8, "12:00:00", 1.0)],
        ],
        lambda events: streams.spending_marks(events, 1_000, "30 minutes"),
    )
    got = sorted((r.user_id, r.reached_by, r.spent_cents) for r in rows)
    assert got == [(1, at("05:00:00"), 1250), (2, at("03:00:00"), 1150)]


@pytest.mark.parametrize(
    "build, columns",
    [
        (lambda e: streams.closed_sessions(e, "30 minutes", "1 hour"), ["user_id", "session_start", "n_events"]),
        (lambda e: streams.spending_marks(e, 300, "30 minutes"), ["user_id", "reached_by", "spent_cents"]),
        (lambda e: streams.without_repeats(e, "1 hour"), ["event_id"]),
    ],
)
def test_a_stopped_stream_goes_on_where_it_was(spark, run, build, columns):
    batches = [
        [event(10 * b + i, f"{b:02}:{20 * i:02}:00", user=i % 2, kind="purchase") for i in range(3)]
        + [event(10 * b, f"{b:02}:00:00", user=0, kind="purchase")]
        for b in range(6)
    ]
    folder, out = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(2))
    for start, part in ((0, batches[:2]), (2, batches[2:3]), (3, batches[3:])):
        feed(folder, part, start)
        source = stream(stream_session(spark), folder, "events", files_per_batch=1)
        stopped = run_to_files(build(source), "test", spark, out).collect()
    at_once = run(batches, build)
    rows = lambda found: sorted(tuple(r[c] for c in columns) for r in found)
    assert rows(stopped) and rows(stopped) == rows(at_once)


STREAMS = [
    "stream_daily_events", "stream_events_without_repeats", "stream_views_with_purchases",
    "stream_user_sessions", "stream_spending_marks",
]


def batches_of(rows):
    """How many batches wrote ``rows``: each commit in the checkpoint beside them is one."""
    run = os.path.dirname(os.path.dirname(rows.inputFiles()[0].removeprefix("file://")))
    return sum(x.isdigit() for x in os.listdir(f"{run}/checkpoint/commits"))


@pytest.mark.parametrize("name", STREAMS)
@pytest.mark.parametrize("rows_per_batch", [None, 400])
def test_registered_streams_over_files_out_of_order_equal_their_sql(spark, name, rows_per_batch):
    table = pq.read_table("/root/testdata/sf0.001/events.parquet").sort_by([("ts", "ascending")])
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.makedirs(f"{folder}/events.parquet")
    part = -(-table.num_rows // 10)
    # Ten files, the latest rows in the first two, which share their times, and so on backwards.
    for i in range(10):
        rows = table.slice((9 - i) * part, part) if i > 1 else table.slice(8 * part).take(
            list(range(i, table.num_rows - 8 * part, 2))
        )
        pq.write_table(rows, f"{folder}/events.parquet/{i:03}.parquet")
        os.utime(f"{folder}/events.parquet/{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    assert con.execute("select count(*) from events").fetchone()[0] == table.num_rows
    found = con.execute(plans.ORACLES[name])
    names = [c[0] for c in found.description]
    if rows_per_batch:
        spark.conf.set(ROWS_CONF, str(rows_per_batch))
    try:
        rows = plans.QUERIES[name](spark, folder)
        got = rows.select(*names).collect()
    finally:
        spark.conf.unset(ROWS_CONF)
    if rows_per_batch:
        assert batches_of(rows) >= 3
    assert Counter(map(tuple, got)) == Counter(found.fetchall())


def test_slices_follow_in_time_and_rows_without_a_time_come_first(spark):
    rows = spark.sql(
        "SELECT id, CASE WHEN id % 50 = 0 THEN NULL ELSE timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id % 97 * 7) END AS ts"
        " FROM range(5000)"
    )
    folders = time_slices(rows, "ts", 700, "test")
    parts = [pq.read_table(f.removeprefix("file:")).to_pylist() for f in folders]
    assert len(parts) > 3 and Counter(r["id"] for p in parts for r in p) == Counter(range(5000))
    assert all(r["ts"] for p in parts[1:] for r in p)
    ends = [(min(t), max(t)) for t in ([r["ts"] for r in p if r["ts"]] for p in parts)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert time_slices(rows, "ts", 5000, "test") == [] == time_slices(rows.where("false"), "ts", 10, "test")


@pytest.mark.parametrize("name", STREAMS)
def test_registered_streams_in_bounded_batches_equal_their_sql(spark, name):
    table = pq.read_table("/root/testdata/sf0.001/events.parquet").sort_by([("ts", "ascending")])
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.makedirs(f"{folder}/events.parquet")
    part = -(-table.num_rows // 4)
    for i in range(4):
        path = f"{folder}/events.parquet/{i:03}.parquet"
        pq.write_table(table.slice(i * part, part), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    found = con.execute(plans.ORACLES[name])
    names = [c[0] for c in found.description]
    spark.conf.set(BATCH_CONF, "1")
    try:
        rows = plans.QUERIES[name](spark, folder)
        got = rows.select(*names).collect()
    finally:
        spark.conf.unset(BATCH_CONF)
    assert batches_of(rows) >= 4
    assert Counter(map(tuple, got)) == Counter(found.fetchall())

"""Queries on tables with nulls in keys, times and amounts, against their SQL."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare
from tidewheel import plans
from tidewheel.operators.ordered import trailing_totals
from tidewheel.sources.tables import SCHEMAS

SF = "/root/testdata/sf0.001"
#: Every so many rows the column is null.
NULLS = {
    "events": {"user_id": ("event_id", 7), "ts": ("event_id", 5), "value": ("event_id", 3)},
    "orders": {"o_totalprice": ("o_orderkey", 5), "o_custkey": ("o_orderkey", 7), "o_orderpriority": ("o_orderkey", 11),
               "o_orderstatus": ("o_orderkey", 13)},
    "lineitem": {"l_extendedprice": ("l_orderkey", 9), "l_returnflag": ("l_orderkey", 4)},
    "part": {"p_brand": ("p_partkey", 6), "p_type": ("p_partkey", 10)},
}
CASES = [
    "last_view_before_purchase", "recent_error_before_purchase", "views_in_hour_before_purchase", "views_near_purchases",
    "trailing_week_by_user", "events_with_neighbours", "hourly_events", "six_hour_events_every_hour",
    "orders_ranked_by_priority", "lines_ranked_overall", "customer_running_totals", "customer_order_profile",
    "customer_open_totals", "largest_orders", "orders_with_line_totals", "parts_dearer_than_brand",
    "part_cube", "event_rollup_by_day", "line_totals_by_flag_and_status",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    to = tmp_path_factory.mktemp("nulls")
    for name in SCHEMAS:
        changed = ", ".join(f"CASE WHEN {k} % {n} = 0 THEN NULL ELSE {c} END AS {c}" for c, (k, n) in NULLS.get(name, {}).items())
        star = f"* REPLACE ({changed})" if changed else "*"
        duckdb.execute(f"copy (select {star} from '{SF}/{name}.parquet') to '{to}/{name}.parquet' (format parquet)")
    return str(to)


@pytest.mark.parametrize("name", CASES)
def test_query_equals_its_sql(spark, folder, name):
    _, wrong = compare(plans.QUERIES[name](spark, folder), plans.ORACLES[name], folder)
    assert wrong is None, wrong


def test_a_null_brand_stays_apart_from_the_total(spark, folder):
    rows = plans.QUERIES["part_cube"](spark, folder).where("brand IS NULL OR brand = 'all'").collect()
    # Of each of the two and no type but the total, one row; they differ in their flag.
    ends = {r.brand: (r.all_brands, r.n_parts) for r in rows if r.all_types == 1}
    parts, without = duckdb.execute(
        f"select count(*), count(*) filter (where p_brand is null) from '{folder}/part.parquet'"
    ).fetchone()
    assert without > 0
    assert ends == {None: (0, without), "all": (1, parts)}


def test_trailing_totals_refuse_inexact_numbers(spark):
    rows = spark.createDataFrame([(1, 1.5)], "k int, v double").selectExpr("k", "v", "timestamp_ntz'2024-01-01' AS at")
    with pytest.raises(ValueError, match="whole number or a decimal"):
        trailing_totals(rows, ["k"], "at", "1 hour", {"t": rows["v"]})

"""What the physical plans must and must not hold."""

import re

import pytest
from conftest import SF

from tidewheel import plans

BATCH = [name for name in plans.QUERIES if not name.startswith("stream_")]


def physical(spark, name):
    return plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_row_pairs_and_no_python(spark, name):
    plan = physical(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert bad not in plan


@pytest.mark.parametrize(
    "name, pushed, columns",
    [
        ("lines_shipped_in_quarter", "In(l_returnflag, [A,R])", 7),
        ("returned_revenue_by_region", "EqualTo(l_returnflag,R)", 4),
        ("customers_with_large_urgent_orders", "GreaterThan(o_totalprice,400000.0)", 3),
        ("last_view_before_purchase", "In(event_type, [purchase,view])", 4),
    ],
)
def test_filters_and_columns_reach_the_scan(spark, name, pushed, columns):
    plan = physical(spark, name)
    scan = next(line for line in plan.splitlines() if "FileScan" in line and pushed in line)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
    assert len(schema.split(",")) == columns


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "TakeOrderedAndProject" in physical(spark, "largest_orders")
    plan = physical(spark, "richest_customers_per_nation")
    partial = plan.index("WindowGroupLimit", plan.index("Exchange"))
    assert partial > plan.index("Exchange")


def test_grouping_sets_expand_the_grouped_rows_only(spark):
    plan = physical(spark, "line_totals_by_flag_and_status")
    below = plan[plan.index("Expand") :]
    assert "HashAggregate" in below and "Exchange" in below


@pytest.mark.parametrize("name", ["orders_ranked_by_priority", "lines_ranked_overall"])
def test_ranks_order_segments_and_not_whole_keys(spark, name):
    plan = physical(spark, name)
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "_segment" in exchange
    if "SinglePartition" in plan:  # only the summary, one row per segment
        below = plan[plan.index("SinglePartition") :]
        assert below.index("HashAggregate") < below.index("FileScan")

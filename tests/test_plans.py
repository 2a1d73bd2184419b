"""Plan-shape checks: the scale properties the operators are designed for
(column pruning, partial aggregation before shuffles, single scans, partial
group limits, salted joins) stay true after changes."""

import re

import pytest

import __spark_entry__ as entry_mod
from conftest import SF_SMALL


def _plan(spark, name):
    df = entry_mod.queries()[name](spark, SF_SMALL)
    df.collect()                                          # the frame whose plan is read
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return plan.split("== Initial Plan ==")[0]


def _scans(plan, table):
    return [line for line in plan.split("\n")
            if "FileScan" in line and f"/{table}.parquet" in line]


def test_top_items_prunes_columns_and_aggregates_partially(spark):
    plan = _plan(spark, "top_items")
    scans = _scans(plan, "lineitem")
    assert len(scans) == 1
    schema = re.search(r"ReadSchema: struct<([^>]*)>", scans[0]).group(1)
    assert sorted(f.split(":")[0] for f in schema.split(",")) == ["l_partkey", "l_quantity"]
    assert "partial_sum" in plan and "TakeOrderedAndProject" in plan


def test_daily_anomalies_scan_orders_once(spark):
    plan = _plan(spark, "daily_anomalies_2sigma")
    assert len(_scans(plan, "orders")) == 1
    assert "partial_sum" in plan


def test_per_group_top_n_uses_partial_group_limit(spark):
    plan = _plan(spark, "recent_predictions")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_item_statistics_join_is_salted_or_broadcast(spark):
    plan = _plan(spark, "item_price_outliers_3sigma")
    join = [line for line in plan.split("\n") if "Join" in line and "event_type" in line]
    assert join and all("__salt" in line or "Broadcast" in line for line in join)


@pytest.mark.parametrize("name", ["churn_at_risk", "customer_spend_anomalies", "run_status_counts"])
def test_one_row_statistics_are_broadcast(spark, name):
    plan = _plan(spark, name)
    assert "SortMergeJoin" not in plan

"""Physical-plan shape: the scale properties the operators rely on."""

import re

import pytest

from tillroll.operators import churn, profile, rfm, sales
from tillroll.operators.clean import clean_transactions
from tillroll.operators.ranking import global_rank
from tillroll.sources.retail import load_retail, tpch_retail_view


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark, sf_small):
    return load_retail(spark, sf_small)


def test_filters_and_columns_reach_the_scan(lines):
    p = plan(sales.geographic_analysis(lines))
    assert "PushedFilters: [IsNotNull(quantity), IsNotNull(customer_id), GreaterThan(quantity,0)]" in p
    assert "ReadSchema: struct<invoice:string,quantity:int,price:decimal(12,3)," \
           "customer_id:bigint,country:string>" in p


def test_distinct_counts_shuffle_on_key_and_value_first(lines):
    """A hot customer is spread over its invoices before the per-customer merge."""
    p = plan(rfm.rfm_sql(lines))
    parts = re.findall(r"hashpartitioning\(([^)]*)\)", p)
    assert any("customer_id" in x and "invoice" in x for x in parts)


def test_global_rank_is_range_partitioned_and_single_partition_only_on_counts(lines):
    from tillroll.operators.ranking import _range, _sort_cols
    r = rfm.rfm_sql(lines)
    assert "rangepartitioning(frequency" in plan(_range(r, _sort_cols(["frequency",
                                                                       "customer_id"]), None))
    p = plan(global_rank(r, ["frequency", "customer_id"]))
    # the data side is the checkpoint (no shuffle); the only SinglePartition
    # exchange sits on the one-row-per-partition counts inside the broadcast
    data_side, _, broadcast_side = p.partition("BroadcastExchange")
    assert "Exchange" not in data_side.replace("AdaptiveSparkPlan", "")
    single = broadcast_side.split("Exchange SinglePartition")[1]
    assert "HashAggregate(keys=[_pid" in single


def test_no_expand_over_lines(lines):
    """Lines are grouped once; distinct counts read what is left."""
    from tillroll.operators import timeseries as ts
    c = clean_transactions(lines)
    orders, daily = plan(churn.customer_orders(c)), plan(ts.daily_exact(c, "country", with_total=True))
    assert "Expand" not in orders and "SortAggregate" not in orders
    assert "Expand" not in daily
    for report in (sales.weekly_sales_sql, sales.product_performance, sales.geographic_analysis, profile.overview):
        assert "Expand" not in plan(report(lines)), report.__name__


def test_running_sums_move_the_table_once(spark):
    from tillroll.operators.metrics import roc_curve
    df = spark.range(1000).selectExpr("id", "id % 2 AS label", "id / 1000 AS score")
    p = plan(roc_curve(df))
    data = p.partition("BroadcastExchange")[0]
    assert "hashpartitioning(_pid" not in data and "Window" not in data


def test_top_products_is_take_ordered(lines):
    assert "TakeOrderedAndProject" in plan(sales.product_performance(lines))


def test_lines_move_for_two_keys_only(spark, sf_small):
    """The customer's country joins the orders, not the lines."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(tpch_retail_view(spark, sf_small)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in shown]
    moved = [i for i, x in enumerate(shown) if "hashpartitioning(o_custkey" in x]
    assert moved
    for i in moved:
        below = next((k for k in range(i + 1, len(shown)) if depth[k] <= depth[i]), len(shown))
        assert not any("l_orderkey" in x for x in shown[i:below])

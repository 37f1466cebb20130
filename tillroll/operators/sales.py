"""Sales reports of the SQL script (queries 3–6) as DataFrame plans.

Distinct counts are exact.  Lines are grouped once, to baskets (group, invoice,
customer) with exact sums; sums and both counts come from that smaller table, each
through one more grouping.  No line is expanded, and a hot group (one country
holding most rows) is spread over its invoices and customers.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.expressions import (
    calendar_days, churn_flag, line_amount, safe_ratio, week_starting_monday,
)
from tillroll.operators.clean import (
    known_customers, sql_geo_filter, sql_product_filter, sql_sales_filter,
)

# Type of a sum of line amounts.
MONEY = "decimal(33,3)"


def distinct_count(col: str, exact: bool = True, rsd: float = 0.01) -> Column:
    """AGG18: exact ``COUNT(DISTINCT)`` (default), or a HyperLogLog++ sketch
    (``approx_count_distinct``, relative error ``rsd``) — one small sketch
    per group and no Expand/extra shuffle, for dashboards over huge tables."""
    return F.countDistinct(col) if exact else F.approx_count_distinct(col, rsd)


def by_baskets(lines: DataFrame, keys: dict[str, Column], sums: dict[str, tuple[Column, str]],
               counts: dict[str, str]) -> DataFrame:
    """Per ``keys``: ``sums`` (name: summand and type) and exact distinct ``counts`` (name:
    column) by way of baskets."""
    base = lines.groupBy(*[c.alias(k) for k, c in keys.items()], *counts.values()).agg(
        *[F.sum(c).cast(t).alias(n) for n, (c, t) in sums.items()])
    parts = []
    for i, (name, column) in enumerate(counts.items()):
        # The sums go with the first count only.
        each = base.groupBy(*keys, column).agg(*[(F.sum(n) if i == 0 else F.lit(0)).cast(t).alias(n)
                                                 for n, (_, t) in sums.items()])
        parts.append(each.select(*keys, *sums, *[
            (F.col(column).isNotNull().cast("bigint") if other == name else F.lit(0).cast("bigint")).alias(other)
            for other in counts]))
    return reduce(DataFrame.unionAll, parts).groupBy(*keys).agg(
        *[F.sum(n).cast(t).alias(n) for n, (_, t) in sums.items()], *[F.sum(n).alias(n) for n in counts])


def as_of_date(as_of: str | _dt.date | Column | None) -> Column:
    """FN13: the report date; ``None`` means CURRENT_DATE."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def churn_indicators_sql(df: DataFrame, as_of=None, threshold: int = 90) -> DataFrame:
    """AGG4 (SQL query 3): per-customer indicators over *uncleaned* rows of
    known customers — returns net off, cancellations count as orders."""
    ref = as_of_date(as_of)
    agg = (known_customers(df).groupBy("customer_id").agg(
        F.max("invoice_date").alias("last_purchase"),
        F.countDistinct("invoice").alias("total_orders"),
        F.sum(line_amount()).alias("_ltv")))
    days = calendar_days("last_purchase", ref)
    return agg.select(
        "customer_id", "last_purchase",
        days.cast("bigint").alias("days_since_purchase"),
        churn_flag(days, threshold).alias("is_churned"),
        "total_orders",
        F.col("_ltv").cast("double").alias("lifetime_value"))


def weekly_sales_sql(df: DataFrame, exact: bool = True) -> DataFrame:
    """AGG7 (SQL query 4): Monday-start weeks, true weekly distinct counts,
    mean line amount."""
    lines, week = sql_sales_filter(df), week_starting_monday("invoice_date")
    if exact:
        agg = by_baskets(lines, {"week_start": week},
                         {"_rev": (line_amount(), MONEY), "_lines": (F.lit(1), "bigint")},
                         {"transactions": "invoice", "unique_customers": "customer_id"})
    else:
        agg = lines.groupBy(week.alias("week_start")).agg(
            F.sum(line_amount()).cast(MONEY).alias("_rev"), distinct_count("invoice", False).alias("transactions"),
            distinct_count("customer_id", False).alias("unique_customers"), F.count(F.lit(1)).alias("_lines"))
    return agg.select(
        "week_start", F.col("_rev").cast("double").alias("revenue"), "transactions",
        "unique_customers", safe_ratio("_rev", "_lines").alias("avg_order_value"),
    ).orderBy("week_start")


def product_performance(df: DataFrame, top: int = 20, exact: bool = True) -> DataFrame:
    """AGG8 + SRT3 (SQL query 5): top products by revenue.

    ORDER BY … LIMIT plans as TakeOrderedAndProject (per-partition top-k then
    merge); stock code and description break revenue ties deterministically.
    """
    lines = sql_product_filter(df)
    if exact:
        agg = by_baskets(lines, {c: F.col(c) for c in ("stock_code", "description")},
                         {"units_sold": (F.col("quantity"), "bigint"), "_rev": (line_amount(), MONEY)},
                         {"order_count": "invoice", "unique_buyers": "customer_id"})
    else:
        agg = lines.groupBy("stock_code", "description").agg(
            distinct_count("invoice", False).alias("order_count"), F.sum("quantity").cast("bigint").alias("units_sold"),
            F.sum(line_amount()).cast(MONEY).alias("_rev"), distinct_count("customer_id", False).alias("unique_buyers"))
    agg = agg.select("stock_code", "description", "order_count", "units_sold", F.col("_rev").cast("double").alias("revenue"),
                     "unique_buyers")
    return agg.orderBy(F.desc("revenue"), F.asc_nulls_first("stock_code"),
                       F.asc_nulls_first("description")).limit(top)


def geographic_analysis(df: DataFrame, exact: bool = True) -> DataFrame:
    """AGG9 (SQL query 6): per-country customers, orders, revenue and
    revenue per customer (NULL instead of a division-by-zero error)."""
    lines = sql_geo_filter(df)
    if exact:
        agg = by_baskets(lines, {"country": F.col("country")}, {"_rev": (line_amount(), MONEY)},
                         {"customers": "customer_id", "orders": "invoice"})
    else:
        agg = lines.groupBy("country").agg(
            distinct_count("customer_id", False).alias("customers"), distinct_count("invoice", False).alias("orders"),
            F.sum(line_amount()).cast(MONEY).alias("_rev"))
    return agg.select(
        "country", "customers", "orders", F.col("_rev").cast("double").alias("revenue"),
        safe_ratio("_rev", "customers").alias("avg_customer_value"),
    ).orderBy(F.desc("revenue"))

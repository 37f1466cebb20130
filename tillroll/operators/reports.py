"""Segment summaries over the customer table (AGG10–AGG15).

All of them are aggregates of the (already aggregated) customer table; the
only joins are to the fixed four-row tier domain.  Revenue sums re-enter
exact decimal arithmetic (customer monetary values carry at most three
decimals) so shares do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.expressions import TIER_ORDER

EXACT = "decimal(38,3)"


def tier_domain(spark) -> DataFrame:
    """The four tiers with their report order (fixed domain, T24-style zero fill)."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(TIER_ORDER)],
                                 "CustomerTier string, tier_order int")


def _exact(c: str) -> Column:
    return F.col(c).cast(EXACT)


def distribution(df: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """AGG10: count and percentage share per category, zero-filled over a fixed
    domain (``domain`` has ``column`` plus an order column)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("customers"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return (domain.join(counts, column, "left")
            .select(*domain.columns,
                    F.coalesce(F.col("customers"), F.lit(0)).alias("customers"),
                    (F.coalesce(F.col("customers"), F.lit(0)) * 100.0 / total).alias("pct")))


def tier_distribution(seg: DataFrame) -> DataFrame:
    """AGG10 for tiers."""
    return distribution(seg, "CustomerTier", tier_domain(seg.sparkSession))


def tier_revenue(seg: DataFrame) -> DataFrame:
    """AGG11: revenue per tier in tier order (NULL for an empty tier, as reindex)."""
    rev = seg.groupBy("CustomerTier").agg(F.sum(_exact("Monetary")).alias("_rev"))
    return (tier_domain(seg.sparkSession).join(rev, "CustomerTier", "left")
            .select("CustomerTier", "tier_order", F.col("_rev").cast("double").alias("revenue")))


def clv_summary(seg: DataFrame) -> DataFrame:
    """AGG12: mean / total CLV (exact sums, unrounded), mean annual CLV (2 dp),
    count per tier."""
    agg = seg.groupBy("CustomerTier").agg(
        F.sum(_exact("CLV")).alias("_sum"), F.count(F.lit(1)).alias("customer_count"),
        F.avg("AnnualCLV").alias("_annual"))
    return (tier_domain(seg.sparkSession).join(agg, "CustomerTier", "left").select(
        "CustomerTier", "tier_order",
        (F.col("_sum").cast("double") / F.col("customer_count")).alias("avg_clv"),
        F.col("_sum").cast("double").alias("total_clv"),
        F.round("_annual", 2).alias("avg_annual_clv"),
        F.coalesce(F.col("customer_count"), F.lit(0)).alias("customer_count")))


def concentration(seg: DataFrame) -> DataFrame:
    """AGG13: share of customers and of revenue for VVIC, VIC and both (one row)."""
    money = _exact("Monetary")
    is_vvic = F.col("CustomerTier") == "VVIC"
    is_vic = F.col("CustomerTier") == "VIC"
    agg = seg.agg(
        F.count(F.lit(1)).alias("n"), F.sum(money).alias("rev"),
        F.count(F.when(is_vvic, 1)).alias("n_vvic"), F.count(F.when(is_vic, 1)).alias("n_vic"),
        F.sum(F.when(is_vvic, money)).alias("rev_vvic"),
        F.sum(F.when(is_vic, money)).alias("rev_vic"))

    def pct(a: Column, b: str) -> Column:
        return F.try_divide(a.cast("double") * 100.0, F.col(b).cast("double"))

    zero = F.lit(0).cast(EXACT)
    return agg.select(
        pct(F.col("n_vvic"), "n").alias("vvic_pct_customers"),
        pct(F.coalesce("rev_vvic", zero), "rev").alias("vvic_pct_revenue"),
        pct(F.col("n_vic"), "n").alias("vic_pct_customers"),
        pct(F.coalesce("rev_vic", zero), "rev").alias("vic_pct_revenue"),
        pct(F.col("n_vvic") + F.col("n_vic"), "n").alias("top2_pct_customers"),
        pct(F.coalesce("rev_vvic", zero) + F.coalesce("rev_vic", zero), "rev")
        .alias("top2_pct_revenue"))


def at_risk(seg: DataFrame, threshold: int = 90) -> DataFrame:
    """AGG14 / FLT5: customers with Recency > threshold, count and share."""
    agg = seg.agg(F.count(F.lit(1)).alias("n"),
                  F.count(F.when(F.col("Recency") > threshold, 1)).alias("at_risk_customers"))
    return agg.select("at_risk_customers", (F.col("at_risk_customers") * 100.0
                                            / F.col("n")).alias("at_risk_pct"))


def kpi_summary(seg: DataFrame) -> DataFrame:
    """AGG15: the five dashboard KPIs as a long (Metric, Value) table; values
    stay numeric (currency formatting is presentation)."""
    wide = seg.agg(
        F.count(F.lit(1)).cast("double").alias("total_customers"),
        F.sum(_exact("Monetary")).cast("double").alias("total_revenue"),
        F.round(F.avg("AvgOrderValue"), 2).alias("avg_order_value"),
        F.count(F.when(F.col("CustomerTier") == "VVIC", 1)).cast("double").alias("vvic"),
        F.count(F.when(F.col("CustomerTier") == "VIC", 1)).cast("double").alias("vic"))
    return wide.select(F.expr(
        "stack(5, 'Total Customers', total_customers, 'Total Revenue', total_revenue, "
        "'Avg Order Value', avg_order_value, 'VVIC Count', vvic, 'VIC Count', vic) "
        "AS (Metric, Value)"))

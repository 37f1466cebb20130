"""Whole-pipeline properties on the smoke data: tiers partition the
customers, shares sum to 100 %, the confusion matrix counts every test row,
the decomposition adds up and its seasonal part averages to zero per series."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillroll.operators import metrics, reports


@pytest.fixture(scope="module")
def seg(spark, sf_small):
    return entry.queries()["seg1_customer_segmentation"](spark, sf_small)


def test_tiers_partition_customers(seg):
    dist = reports.tier_distribution(seg).toPandas()
    assert dist["customers"].sum() == seg.count()
    assert dist["pct"].sum() == pytest.approx(100.0)
    assert set(seg.select("CustomerTier").distinct().toPandas()["CustomerTier"]) <= set(
        dist["CustomerTier"])


def test_scores_are_in_range_and_concatenated(seg):
    bad = seg.filter(~F.col("R_Score").between(1, 5) | ~F.col("F_Score").between(1, 5)
                     | ~F.col("M_Score").between(1, 5)
                     | (F.col("RFM_Score") != F.concat_ws("", "R_Score", "F_Score", "M_Score")))
    assert bad.count() == 0


def test_confusion_matrix_counts_every_test_row(spark, sf_small):
    from tillroll.plans.q_churn import fixed_test
    test = fixed_test(spark, sf_small)
    cm = metrics.confusion_matrix(test).toPandas()
    assert int(cm[["predicted_0", "predicted_1"]].values.sum()) == test.count()


def test_decomposition_adds_up(spark, sf_small):
    d = entry.queries()["ts3_seasonal_decomposition"](spark, sf_small).toPandas().dropna()
    assert ((d["observed"] - d["trend"] - d["seasonal"] - d["residual"]).abs()
            < 1e-6 * d["observed"].abs().max()).all()
    per_phase = d.assign(phase=d["t"] % 4).groupby(["series_key", "phase"])["seasonal"].first()
    assert per_phase.groupby(level=0).mean().abs().max() < 1e-6


def test_weekly_rollup_keeps_revenue(spark, sf_small):
    q = entry.queries()
    daily = q["agg5_daily_sales"](spark, sf_small).groupBy("series_key").agg(
        F.sum("Revenue").alias("d"))
    weekly = q["agg6_weekly_sales"](spark, sf_small).groupBy("series_key").agg(
        F.sum("Revenue").alias("w"))
    j = daily.join(weekly, "series_key").toPandas()
    assert ((j["d"] - j["w"]).abs() <= 1e-6 * j["d"].abs()).all()

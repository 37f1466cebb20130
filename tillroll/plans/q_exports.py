"""Registered queries: the reference's exports written and read back
(SNK1, SNK3, SNK4, SRC2).  Each writes to the shared scratch folder with the
declared schema and returns what a downstream job would read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import forecast, rfm, timeseries as ts
from tillroll.operators.clean import clean_transactions
from tillroll.plans.catalog import date_text, register
from tillroll.plans.q_forecast import FORECAST_SQL
from tillroll.plans.q_segmentation import seg_oracle
from tillroll.plans.q_timeseries import series_oracle
from tillroll.session import scratch_path
from tillroll.sources.retail import load_retail, read_segmentation
from tillroll.sources.sinks import write_table


@register("snk1_src2_segmentation_csv_roundtrip", seg_oracle("""
SELECT CustomerID, Recency, Frequency, Monetary, R_Score, F_Score, M_Score, RFM_Score,
       CustomerTier, CLV, AvgOrderValue
FROM seg_full"""))
def q_snk1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1 → SRC2: the 11-column segmentation export as CSV with a header,
    read back with the declared schema (the churn job's hand-off)."""
    seg = rfm.segment_customers(load_retail(spark, sf_dir)).select(*rfm.SEGMENTATION_COLUMNS)
    path = write_table(seg, scratch_path(spark, "exports", uuid.uuid4().hex,
                                         "customer_segmentation"), "csv")
    return read_segmentation(spark, path, "csv")


@register("snk4_weekly_sales_export", series_oracle("""
SELECT strftime(Date, '%Y-%m-%d') AS Date, Revenue, Transactions, UniqueCustomers
FROM weekly WHERE series_key = 'ALL'"""))
def q_snk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: the total weekly series (Date, Revenue, Transactions,
    UniqueCustomers) written as Parquet and read back."""
    weekly = ts.weekly_sales(clean_transactions(load_retail(spark, sf_dir)))
    out = weekly.select("Date", "Revenue", "Transactions", "UniqueCustomers")
    path = write_table(out, scratch_path(spark, "exports", uuid.uuid4().hex, "weekly_sales"))
    return spark.read.parquet(path).select(date_text("Date"), "Revenue", "Transactions",
                                           "UniqueCustomers")


@register("snk3_revenue_forecast_export", series_oracle(f"""{FORECAST_SQL}
SELECT w AS Week, strftime(last + 7 * w, '%Y-%m-%d') AS Date, round(f, 2) AS Forecast,
       round(f - half, 2) AS Lower_CI, round(f + half, 2) AS Upper_CI
FROM fc JOIN (SELECT series_key, MAX(Date) AS last FROM weekly GROUP BY series_key) USING (series_key)
WHERE series_key = 'ALL'"""))
def q_snk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: the 12-week forecast of the total series (Week, Date, Forecast,
    Lower_CI, Upper_CI) written and read back."""
    weekly = ts.weekly_sales(clean_transactions(load_retail(spark, sf_dir)))
    table = forecast.forecast_table(weekly).select("Week", "Date", "Forecast", "Lower_CI",
                                                    "Upper_CI")
    path = write_table(table, scratch_path(spark, "exports", uuid.uuid4().hex,
                                           "revenue_forecast"))
    return spark.read.parquet(path).select("Week", date_text("Date"), *[
        F.round(c, 2).alias(c) for c in ("Forecast", "Lower_CI", "Upper_CI")])

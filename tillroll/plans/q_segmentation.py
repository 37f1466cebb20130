"""Registered queries: notebook segmentation (AGG1, WIN2–WIN4, FN2, FN3, CLV*,
SEG1) and its summaries (AGG10–AGG15, FLT4, FLT5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import reports, rfm
from tillroll.operators.clean import clean_transactions, rows_in
from tillroll.plans.catalog import register
from tillroll.plans.oracles import CLEAN_CTE, RETAIL_CTE, with_ctes
from tillroll.sources.retail import load_retail
from tillroll.sources.tables import materialized

# DuckDB rendition of the notebook segmentation (pandas qcut semantics).
RFM_CTE = """
per_cust AS (
  SELECT customer_id, MAX(invoice_date) AS last_ts, COUNT(DISTINCT invoice) AS frequency,
         SUM(amount) AS money
  FROM clean GROUP BY customer_id
),
ref AS (SELECT MAX(last_ts) + INTERVAL 1 DAY AS ref_ts FROM per_cust),
rfm AS (
  SELECT customer_id AS CustomerID, date_sub('day', last_ts, ref_ts) AS Recency,
         frequency AS Frequency, CAST(money AS DOUBLE) AS Monetary
  FROM per_cust, ref
)"""

SEG_CTE = """
edges AS (
  SELECT round(quantile_cont(Recency, 0.2), 9) AS r1, round(quantile_cont(Recency, 0.4), 9) AS r2,
         round(quantile_cont(Recency, 0.6), 9) AS r3, round(quantile_cont(Recency, 0.8), 9) AS r4,
         round(quantile_cont(Monetary, 0.2), 9) AS m1, round(quantile_cont(Monetary, 0.4), 9) AS m2,
         round(quantile_cont(Monetary, 0.6), 9) AS m3, round(quantile_cont(Monetary, 0.8), 9) AS m4,
         COUNT(*) AS n, MAX(Recency) AS max_recency
  FROM rfm
),
scored AS (
  SELECT r.CustomerID, r.Recency, r.Frequency, r.Monetary,
    CAST(5 - (CAST(r.Recency > r1 AS INTEGER) + CAST(r.Recency > r2 AS INTEGER)
              + CAST(r.Recency > r3 AS INTEGER) + CAST(r.Recency > r4 AS INTEGER)) AS INTEGER)
      AS R_Score,
    CAST(CASE WHEN n <= 1 THEN 1
         ELSE greatest(1, ((row_number() OVER (ORDER BY r.Frequency, r.CustomerID) - 1) * 5
                           + n - 2) // (n - 1)) END AS INTEGER) AS F_Score,
    CAST(1 + CAST(r.Monetary > m1 AS INTEGER) + CAST(r.Monetary > m2 AS INTEGER)
           + CAST(r.Monetary > m3 AS INTEGER) + CAST(r.Monetary > m4 AS INTEGER) AS INTEGER)
      AS M_Score,
    max_recency
  FROM rfm r, edges
),
seg AS (
  SELECT CustomerID, Recency, Frequency, Monetary, R_Score, F_Score, M_Score,
    CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR) AS RFM_Score,
    CASE
      WHEN R_Score >= 4 AND F_Score >= 4 AND M_Score >= 4 THEN 'VVIC'
      WHEN R_Score >= 3 AND F_Score >= 3 AND M_Score >= 3 THEN 'VIC'
      WHEN (R_Score >= 2 AND F_Score >= 2) OR M_Score >= 3 THEN 'Prestige'
      ELSE 'One-time'
    END AS CustomerTier,
    Monetary / CAST(Frequency AS DOUBLE) AS AvgOrderValue,
    max_recency - Recency AS ActiveDays,
    greatest(CAST(max_recency - Recency AS DOUBLE) / CAST(365 AS DOUBLE), CAST(0.1 AS DOUBLE))
      AS EstimatedLifespan,
    Monetary AS CLV
  FROM scored
),
seg_full AS (
  SELECT *, AvgOrderValue * (CAST(Frequency AS DOUBLE)
                             / greatest(EstimatedLifespan, CAST(0.5 AS DOUBLE))) AS AnnualCLV
  FROM seg
),
tiers(CustomerTier, tier_order) AS (
  VALUES ('VVIC', 0), ('VIC', 1), ('Prestige', 2), ('One-time', 3)
)"""


def seg_oracle(body: str) -> str:
    return with_ctes(RETAIL_CTE, CLEAN_CTE, RFM_CTE, SEG_CTE, body=body)


def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer segmentation table (SEG1 output), built once per session;
    the summaries below read it like the reference's reports read the export."""
    return materialized(spark, "customer_segmentation", sf_dir,
                        lambda: rfm.segment_customers(load_retail(spark, sf_dir)))


@register("agg1_rfm_metrics", with_ctes(RETAIL_CTE, CLEAN_CTE, RFM_CTE, body="""
SELECT CustomerID, Recency, Frequency, Monetary FROM rfm"""))
def q_agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm.rfm_notebook(clean_transactions(load_retail(spark, sf_dir)))


@register("flt_clean_transactions", with_ctes(RETAIL_CTE, CLEAN_CTE, body="""
SELECT invoice, stock_code, customer_id, CAST(quantity AS BIGINT) AS quantity,
       strftime(invoice_date, '%Y-%m-%d %H:%M:%S') AS invoice_date,
       CAST(amount AS DOUBLE) AS amount
FROM clean"""))
def q_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clean_transactions(load_retail(spark, sf_dir))
    return c.select("invoice", "stock_code", "customer_id",
                    F.col("quantity").cast("bigint").alias("quantity"),
                    F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss").alias("invoice_date"),
                    F.col("amount").cast("double").alias("amount"))


@register("seg1_customer_segmentation", seg_oracle("""
SELECT CustomerID, Recency, Frequency, Monetary, R_Score, F_Score, M_Score, RFM_Score,
       CustomerTier, CLV, AvgOrderValue, ActiveDays, EstimatedLifespan, AnnualCLV
FROM seg_full"""))
def q_seg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation(spark, sf_dir).select(
        *rfm.SEGMENTATION_COLUMNS, "ActiveDays", "EstimatedLifespan", "AnnualCLV")


@register("win234_quintile_scores", seg_oracle("""
SELECT CustomerID, R_Score, F_Score, M_Score, RFM_Score FROM seg_full"""))
def q_win234(spark: SparkSession, sf_dir: str) -> DataFrame:
    rfm_df = rfm.rfm_notebook(clean_transactions(load_retail(spark, sf_dir)))
    return rfm.score_notebook(rfm_df).select("CustomerID", "R_Score", "F_Score", "M_Score",
                                             "RFM_Score")


@register("agg10_tier_distribution", seg_oracle("""
SELECT t.CustomerTier, t.tier_order, COALESCE(c.customers, 0) AS customers,
       COALESCE(c.customers, 0) * 100.0 / (SELECT COUNT(*) FROM seg_full) AS pct
FROM tiers t LEFT JOIN (SELECT CustomerTier, COUNT(*) AS customers FROM seg_full
                        GROUP BY CustomerTier) c USING (CustomerTier)"""))
def q_agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tier_distribution(segmentation(spark, sf_dir))


@register("agg11_tier_revenue", seg_oracle("""
SELECT t.CustomerTier, t.tier_order, CAST(r.rev AS DOUBLE) AS revenue
FROM tiers t LEFT JOIN (SELECT CustomerTier, SUM(CAST(Monetary AS DECIMAL(38,3))) AS rev
                        FROM seg_full GROUP BY CustomerTier) r USING (CustomerTier)"""))
def q_agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tier_revenue(segmentation(spark, sf_dir))


@register("agg12_clv_summary", seg_oracle("""
SELECT t.CustomerTier, t.tier_order,
       CAST(s.total AS DOUBLE) / s.customer_count AS avg_clv,
       CAST(s.total AS DOUBLE) AS total_clv,
       round(s.annual, 2) AS avg_annual_clv,
       COALESCE(s.customer_count, 0) AS customer_count
FROM tiers t LEFT JOIN (
  SELECT CustomerTier, SUM(CAST(CLV AS DECIMAL(38,3))) AS total, COUNT(*) AS customer_count,
         AVG(AnnualCLV) AS annual
  FROM seg_full GROUP BY CustomerTier) s USING (CustomerTier)"""))
def q_agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.clv_summary(segmentation(spark, sf_dir))


@register("agg13_concentration", seg_oracle("""
SELECT
  n_vvic * 100.0 / n AS vvic_pct_customers,
  CAST(COALESCE(rev_vvic, 0) AS DOUBLE) * 100.0 / CAST(rev AS DOUBLE) AS vvic_pct_revenue,
  n_vic * 100.0 / n AS vic_pct_customers,
  CAST(COALESCE(rev_vic, 0) AS DOUBLE) * 100.0 / CAST(rev AS DOUBLE) AS vic_pct_revenue,
  (n_vvic + n_vic) * 100.0 / n AS top2_pct_customers,
  CAST(COALESCE(rev_vvic, 0) + COALESCE(rev_vic, 0) AS DOUBLE) * 100.0 / CAST(rev AS DOUBLE)
    AS top2_pct_revenue
FROM (
  SELECT COUNT(*) AS n, SUM(CAST(Monetary AS DECIMAL(38,3))) AS rev,
         COUNT(*) FILTER (WHERE CustomerTier = 'VVIC') AS n_vvic,
         COUNT(*) FILTER (WHERE CustomerTier = 'VIC') AS n_vic,
         SUM(CAST(Monetary AS DECIMAL(38,3))) FILTER (WHERE CustomerTier = 'VVIC') AS rev_vvic,
         SUM(CAST(Monetary AS DECIMAL(38,3))) FILTER (WHERE CustomerTier = 'VIC') AS rev_vic
  FROM seg_full)"""))
def q_agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.concentration(segmentation(spark, sf_dir))


@register("agg14_at_risk", seg_oracle("""
SELECT COUNT(*) FILTER (WHERE Recency > 90) AS at_risk_customers,
       COUNT(*) FILTER (WHERE Recency > 90) * 100.0 / COUNT(*) AS at_risk_pct
FROM seg_full"""))
def q_agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.at_risk(segmentation(spark, sf_dir))


@register("agg15_kpi_summary", seg_oracle("""
SELECT Metric, Value FROM (
  SELECT 'Total Customers' AS Metric, CAST(COUNT(*) AS DOUBLE) AS Value FROM seg_full
  UNION ALL SELECT 'Total Revenue', CAST(SUM(CAST(Monetary AS DECIMAL(38,3))) AS DOUBLE)
    FROM seg_full
  UNION ALL SELECT 'Avg Order Value', round(AVG(AvgOrderValue), 2) FROM seg_full
  UNION ALL SELECT 'VVIC Count', CAST(COUNT(*) FILTER (WHERE CustomerTier = 'VVIC') AS DOUBLE)
    FROM seg_full
  UNION ALL SELECT 'VIC Count', CAST(COUNT(*) FILTER (WHERE CustomerTier = 'VIC') AS DOUBLE)
    FROM seg_full)"""))
def q_agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kpi_summary(segmentation(spark, sf_dir))


@register("flt4_top_tier_customers", seg_oracle("""
SELECT CustomerID, CustomerTier, CLV FROM seg_full WHERE CustomerTier IN ('VVIC', 'VIC')"""))
def q_flt4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_in(segmentation(spark, sf_dir), "CustomerTier", ["VVIC", "VIC"]).select(
        "CustomerID", "CustomerTier", "CLV")


@register("flt5_recent_lapsed_customers", seg_oracle("""
SELECT CustomerID, Recency, CustomerTier FROM seg_full WHERE Recency > 90"""))
def q_flt5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation(spark, sf_dir).filter(F.col("Recency") > 90).select(
        "CustomerID", "Recency", "CustomerTier")

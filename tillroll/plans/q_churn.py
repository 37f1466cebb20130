"""Registered queries: churn features, split and the metric / retention
operators on a fixed score (AGG3, ML1–ML4, ML10, ML13–ML15, ML18, ML19, FN5,
JON1, AGG16, SNK2 columns).  Fitted models are in ``q_models``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import churn, metrics
from tillroll.operators.clean import clean_transactions
from tillroll.plans.catalog import TEST_HOME, register, ts_text
from tillroll.plans.oracles import CLEAN_CTE, RETAIL_CTE, with_ctes
from tillroll.plans.q_segmentation import RFM_CTE, SEG_CTE, segmentation
from tillroll.session import scratch_path
from tillroll.sources.retail import load_retail
from tillroll.sources.sinks import write_table
from tillroll.sources.tables import materialized

CHURN_CTE = f"""
cf_base AS (
  SELECT customer_id AS CustomerID, MIN(invoice_date) AS FirstPurchase,
         MAX(invoice_date) AS LastPurchase, COUNT(DISTINCT invoice) AS Frequency,
         SUM(amount) AS spend, COUNT(amount) AS lines,
         CAST(SUM(CAST(amount * 1000 AS HUGEINT)) AS HUGEINT) AS x,
         CAST(SUM(CAST(amount * 1000 AS HUGEINT) * CAST(amount * 1000 AS HUGEINT)) AS HUGEINT) AS xx,
         CAST(SUM(quantity) AS BIGINT) AS TotalQuantity,
         COUNT(DISTINCT stock_code) AS UniqueProducts,
         first(country ORDER BY invoice_date, country) AS Country
  FROM clean GROUP BY customer_id
),
cref AS (SELECT MAX(LastPurchase) + INTERVAL 1 DAY AS ref_ts FROM cf_base),
cf AS (
  SELECT CustomerID, FirstPurchase, LastPurchase,
         date_sub('day', LastPurchase, ref_ts) AS Recency, Frequency,
         CAST(spend AS DOUBLE) AS TotalSpend, CAST(spend AS DOUBLE) / lines AS AvgOrderValue,
         CASE WHEN lines > 1 THEN sqrt((CAST((lines * xx - x * x) // 4294967296 AS DOUBLE) * 4294967296.0::DOUBLE
           + CAST((lines * xx - x * x) % 4294967296 AS DOUBLE)) / CAST(lines * (lines - 1) AS DOUBLE)) / 1000.0
           ELSE 0.0 END AS StdOrderValue, TotalQuantity,
         CAST(TotalQuantity AS DOUBLE) / lines AS AvgQuantity, UniqueProducts, Country,
         date_sub('day', FirstPurchase, LastPurchase) AS CustomerAge,
         CAST(date_sub('day', FirstPurchase, LastPurchase) AS DOUBLE)
           / CAST(greatest(Frequency, 1) AS DOUBLE) AS AvgDaysBetweenPurchases,
         CAST(Country = '{TEST_HOME}' AS INTEGER) AS IsUK,
         CAST(date_sub('day', LastPurchase, ref_ts) > 90 AS INTEGER) AS Churned
  FROM cf_base, cref
),
split AS (
  SELECT *, CAST(w <= (nc + 4) // 5 AS INTEGER) AS is_test, CAST((w - 1) % 5 AS INTEGER) AS fold
  FROM (SELECT *, row_number() OVER (PARTITION BY Churned
                     ORDER BY md5(CAST(CustomerID AS VARCHAR) || ':42'), CustomerID) AS w,
               COUNT(*) OVER (PARTITION BY Churned) AS nc FROM cf)
),
cscored AS (
  SELECT *, COALESCE(CAST(Recency AS DOUBLE) / NULLIF(CAST(Recency + 30 * Frequency AS DOUBLE), 0),
                     0.0) AS ChurnProbability
  FROM split
),
risk AS (
  SELECT *, CASE WHEN ChurnProbability > 0 AND ChurnProbability <= 0.3 THEN 'Low'
                 WHEN ChurnProbability > 0.3 AND ChurnProbability <= 0.6 THEN 'Medium'
                 WHEN ChurnProbability > 0.6 AND ChurnProbability <= 1.0 THEN 'High' END AS ChurnRisk
  FROM cscored
),
test AS (
  SELECT Churned AS label, ChurnProbability AS score, CustomerID AS id,
         CAST(ChurnProbability > 0.5 AS INTEGER) AS prediction
  FROM cscored WHERE is_test = 1
)"""


def churn_oracle(body: str, extra: str | None = None, with_seg: bool = False) -> str:
    ctes = [RETAIL_CTE, CLEAN_CTE, CHURN_CTE]
    if with_seg:
        ctes += [RFM_CTE, SEG_CTE]
    if extra:
        ctes.append(extra)
    return with_ctes(*ctes, body=body)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn feature table, built once per session."""
    return materialized(spark, "churn_features", sf_dir, lambda: churn.churn_features(
        clean_transactions(load_retail(spark, sf_dir)), home=TEST_HOME))


def split_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn features with the exact split columns (is_test, fold), built once."""
    return materialized(spark, "churn_features_split", sf_dir,
                        lambda: churn.stratified_split(features(spark, sf_dir)))


def fixed_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features + exact split + fixed score + risk band."""
    return churn.with_risk(churn.fixed_score(split_features(spark, sf_dir)))


def fixed_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixed_scored(spark, sf_dir).filter(F.col("is_test") == 1)
    return s.select(F.col("Churned").alias("label"), F.col("ChurnProbability").alias("score"),
                    F.col("CustomerID").alias("id"),
                    (F.col("ChurnProbability") > 0.5).cast("int").alias("prediction"))


@register("agg3_churn_features", churn_oracle("""
SELECT CustomerID, strftime(FirstPurchase, '%Y-%m-%d %H:%M:%S') AS FirstPurchase,
       strftime(LastPurchase, '%Y-%m-%d %H:%M:%S') AS LastPurchase, Recency, Frequency,
       TotalSpend, AvgOrderValue, StdOrderValue, TotalQuantity,
       AvgQuantity, UniqueProducts, Country, CustomerAge, AvgDaysBetweenPurchases, IsUK, Churned
FROM cf"""))
def q_agg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return f.select("CustomerID", ts_text("FirstPurchase"), ts_text("LastPurchase"), "Recency",
                    "Frequency", "TotalSpend", "AvgOrderValue",
                    "StdOrderValue", "TotalQuantity",
                    "AvgQuantity", "UniqueProducts", "Country", "CustomerAge",
                    "AvgDaysBetweenPurchases", "IsUK", "Churned")


@register("agg10_churn_label_distribution", churn_oracle(extra="""
classes(Churned, class_name) AS (VALUES (0, 'Active'), (1, 'Churned'))""", body="""
SELECT c.Churned, c.class_name, COALESCE(n.customers, 0) AS customers,
       COALESCE(n.customers, 0) * 100.0 / (SELECT COUNT(*) FROM cf) AS pct
FROM classes c LEFT JOIN (SELECT Churned, COUNT(*) AS customers FROM cf GROUP BY Churned) n
  USING (Churned)"""))
def q_agg10_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.label_distribution(features(spark, sf_dir))


@register("ml4_stratified_split", churn_oracle("""
SELECT CustomerID, Churned, is_test, fold FROM split"""))
def q_ml4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.stratified_split(features(spark, sf_dir)).select(
        "CustomerID", "Churned", "is_test", "fold")


@register("ml10_auc_fixed_score", churn_oracle(extra="""
rk AS (SELECT label, score, row_number() OVER (ORDER BY score, id) AS rn FROM test),
ties AS (SELECT score, MIN(rn) + MAX(rn) AS tm, SUM(label) AS pos, COUNT(*) AS cnt
         FROM rk GROUP BY score)""", body="""
SELECT CAST(SUM(pos * tm) - SUM(pos) * (SUM(pos) + 1) AS DOUBLE)
         / CAST(2 * SUM(pos) * (SUM(cnt) - SUM(pos)) AS DOUBLE) AS auc,
       CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(cnt) - SUM(pos) AS BIGINT) AS n_neg
FROM ties"""))
def q_ml10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(fixed_test(spark, sf_dir), "label", "score", "id")


ROC_SQL = """
hist AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM test GROUP BY score),
cum AS (SELECT score, SUM(pos) OVER (ORDER BY score DESC) AS tps,
               SUM(neg) OVER (ORDER BY score DESC) AS fps FROM hist),
tot AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM hist)"""
ROC_BODY = """
SELECT CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS fps, CAST(0 AS BIGINT) AS tps,
       CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr
UNION ALL
SELECT score, CAST(fps AS BIGINT), CAST(tps AS BIGINT), CAST(fps AS DOUBLE) / CAST(N AS DOUBLE),
       CAST(tps AS DOUBLE) / CAST(P AS DOUBLE)
FROM cum, tot"""


@register("ml15_roc_curve_fixed_score", churn_oracle(extra=ROC_SQL, body=ROC_BODY))
def q_ml15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_curve(fixed_test(spark, sf_dir), "label", "score")


@register("ml14_confusion_matrix_fixed_score", churn_oracle("""
SELECT d.actual, COALESCE(c.p0, 0) AS predicted_0, COALESCE(c.p1, 0) AS predicted_1
FROM (SELECT CAST(range AS INTEGER) AS actual FROM range(2)) d
LEFT JOIN (SELECT label AS actual, COUNT(*) FILTER (WHERE prediction = 0) AS p0,
                  COUNT(*) FILTER (WHERE prediction = 1) AS p1
           FROM test GROUP BY label) c USING (actual)"""))
def q_ml14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(fixed_test(spark, sf_dir), "label", "prediction")


def _d0(a: str, b: str) -> str:
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


REPORT_SQL = f"""
c AS (
  SELECT COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS c00,
         COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS c01,
         COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS c10,
         COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS c11
  FROM test
),
w AS (
  SELECT {_d0('c00', 'c00 + c10')} AS p0, {_d0('c00', 'c00 + c01')} AS r0, c00 + c01 AS s0,
         {_d0('c11', 'c11 + c01')} AS p1, {_d0('c11', 'c11 + c10')} AS r1, c10 + c11 AS s1,
         {_d0('c00 + c11', 'c00 + c01 + c10 + c11')} AS acc
  FROM c
),
w2 AS (
  SELECT *, COALESCE(2 * p0 * r0 / NULLIF(p0 + r0, 0), 0.0) AS f0,
            COALESCE(2 * p1 * r1 / NULLIF(p1 + r1, 0), 0.0) AS f1
  FROM w
)"""


REPORT_BODY = """
SELECT 0 AS row_order, 'Active' AS class_name, p0 AS precision, r0 AS recall, f0 AS f1_score,
       CAST(s0 AS BIGINT) AS support FROM w2
UNION ALL SELECT 1, 'Churned', p1, r1, f1, CAST(s1 AS BIGINT) FROM w2
UNION ALL SELECT 2, 'accuracy', NULL, NULL, acc, CAST(s0 + s1 AS BIGINT) FROM w2
UNION ALL SELECT 3, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2,
                 CAST(s0 + s1 AS BIGINT) FROM w2
UNION ALL SELECT 4, 'weighted avg',
    COALESCE((p0 * s0 + p1 * s1) / NULLIF(CAST(s0 + s1 AS DOUBLE), 0), 0.0),
    COALESCE((r0 * s0 + r1 * s1) / NULLIF(CAST(s0 + s1 AS DOUBLE), 0), 0.0),
    COALESCE((f0 * s0 + f1 * s1) / NULLIF(CAST(s0 + s1 AS DOUBLE), 0), 0.0),
    CAST(s0 + s1 AS BIGINT) FROM w2"""


@register("ml13_classification_report_fixed_score", churn_oracle(extra=REPORT_SQL, body=REPORT_BODY))
def q_ml13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_report(fixed_test(spark, sf_dir), "label", "prediction")


@register("snk2_fn5_churn_export_fixed_score", churn_oracle("""
SELECT CustomerID, Recency, Frequency, TotalSpend, ChurnProbability, ChurnRisk, Churned
FROM risk"""))
def q_snk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2: the churn export written as CSV with a header and read back."""
    out = fixed_scored(spark, sf_dir).select(*churn.CHURN_EXPORT_COLUMNS)
    path = write_table(out, scratch_path(spark, "exports", uuid.uuid4().hex, "churn_predictions"), "csv")
    return spark.read.schema(out.schema).option("header", True).csv(path)


@register("ml18_risk_distribution_fixed_score", churn_oracle(extra="""
bands(ChurnRisk, band_order) AS (VALUES ('High', 0), ('Medium', 1), ('Low', 2))""", body="""
SELECT b.ChurnRisk, b.band_order, COALESCE(c.customers, 0) AS customers,
       COALESCE(c.customers, 0) * 100.0 / (SELECT COUNT(*) FROM risk) AS pct
FROM bands b LEFT JOIN (SELECT ChurnRisk, COUNT(*) AS customers FROM risk GROUP BY ChurnRisk) c
  USING (ChurnRisk)"""))
def q_ml18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.risk_distribution(fixed_scored(spark, sf_dir))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.join_segments(fixed_scored(spark, sf_dir), segmentation(spark, sf_dir))


_MERGED = """
merged AS (
  SELECT r.*, s.CustomerTier, s.CLV FROM risk r LEFT JOIN seg_full s USING (CustomerID)
),
retention AS (
  SELECT * FROM merged WHERE ChurnRisk = 'High' AND CustomerTier IN ('VVIC', 'VIC')
)"""


@register("jon1_churn_segment_join_fixed_score", churn_oracle(extra=_MERGED, body="""
SELECT CustomerID, ChurnRisk, CustomerTier, CLV FROM merged""", with_seg=True))
def q_jon1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("CustomerID", "ChurnRisk", "CustomerTier", "CLV")


@register("ml19_priority_retention_fixed_score", churn_oracle(extra=_MERGED, body="""
SELECT CustomerID, ChurnProbability, CustomerTier, CLV FROM retention""", with_seg=True))
def q_ml19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.priority_retention(_merged(spark, sf_dir)).select(
        "CustomerID", "ChurnProbability", "CustomerTier", "CLV")


@register("agg16_clv_at_risk_fixed_score", churn_oracle(extra=_MERGED, body="""
SELECT COUNT(*) AS customers_at_risk,
       CAST(COALESCE(SUM(CAST(CLV AS DECIMAL(38,3))), 0) AS DOUBLE) AS clv_at_risk
FROM retention""", with_seg=True))
def q_agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.clv_at_risk(churn.priority_retention(_merged(spark, sf_dir)))

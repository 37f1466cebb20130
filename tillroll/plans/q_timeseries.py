"""Registered queries: profiling (PRF1–PRF4) and the exact time-series
operators (AGG5, AGG6, TS1–TS5, TS8, TS9, WIN5, WIN6).  Series are per
country plus the ``'ALL'`` total, so the work grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import profile, timeseries as ts
from tillroll.operators.clean import clean_transactions
from tillroll.operators.rfm import rfm_notebook
from tillroll.plans.catalog import date_text, register, ts_text
from tillroll.plans.oracles import CLEAN_CTE, RETAIL_CTE, with_ctes
from tillroll.plans.q_segmentation import RFM_CTE
from tillroll.sources.retail import load_retail
from tillroll.sources.tables import materialized


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_transactions(load_retail(spark, sf_dir))


def weekly_exact_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly series per country plus the total, revenue as exact decimal;
    built once per session (the series operators all read it)."""
    return materialized(spark, "weekly_by_country", sf_dir, lambda: ts.weekly_revenue_exact(
        _clean(spark, sf_dir), by="country", with_total=True))


def weekly_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series with revenue as double (AGG6 output types)."""
    return weekly_exact_by_country(spark, sf_dir).withColumn(
        "Revenue", F.col("Revenue").cast("double"))


# --- profiling ----------------------------------------------------------------

@register("prf1_overview", with_ctes(RETAIL_CTE, body="""
SELECT COUNT(*) AS total_transactions, COUNT(DISTINCT customer_id) AS unique_customers,
       COUNT(DISTINCT stock_code) AS unique_products, COUNT(DISTINCT country) AS countries,
       strftime(MIN(invoice_date), '%Y-%m-%d %H:%M:%S') AS first_date,
       strftime(MAX(invoice_date), '%Y-%m-%d %H:%M:%S') AS last_date
FROM online_retail"""))
def q_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = profile.overview(load_retail(spark, sf_dir))
    return o.select("total_transactions", "unique_customers", "unique_products", "countries",
                    ts_text("first_date"), ts_text("last_date"))


_COLS = ["invoice", "stock_code", "description", "quantity", "invoice_date", "price",
         "customer_id", "country"]


@register("prf2_missing_values", with_ctes(RETAIL_CTE, body="""
SELECT column_name, missing, missing * 100.0 / n AS missing_pct FROM (
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing, "
    f"COUNT(*) AS n FROM online_retail" for c in _COLS) + ")"))
def q_prf2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_values(load_retail(spark, sf_dir))


@register("prf3_cleaning_funnel", with_ctes(RETAIL_CTE, """
c AS (
  SELECT COUNT(*) AS s0,
         COUNT(*) FILTER (WHERE customer_id IS NOT NULL) AS s1,
         COUNT(*) FILTER (WHERE customer_id IS NOT NULL
                          AND NOT starts_with(coalesce(invoice, ''), 'C')) AS s2,
         COUNT(*) FILTER (WHERE customer_id IS NOT NULL
                          AND NOT starts_with(coalesce(invoice, ''), 'C')
                          AND quantity > 0 AND price > 0) AS s3
  FROM online_retail)""", body="""
SELECT 0 AS step, 'loaded' AS step_name, 0::BIGINT AS rows_removed, s0 AS rows_left FROM c
UNION ALL SELECT 1, 'known customer', s0 - s1, s1 FROM c
UNION ALL SELECT 2, 'not cancelled', s1 - s2, s2 FROM c
UNION ALL SELECT 3, 'positive quantity and price', s2 - s3, s3 FROM c"""))
def q_prf3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.cleaning_funnel(load_retail(spark, sf_dir))


def _describe_sql(col: str) -> str:
    return f"""
SELECT stat_order, statistic, round(value, 2) AS {col} FROM (
  SELECT 0 AS stat_order, 'count' AS statistic, CAST(COUNT({col}) AS DOUBLE) AS value FROM rfm
  UNION ALL SELECT 1, 'mean', AVG(CAST({col} AS DOUBLE)) FROM rfm
  UNION ALL SELECT 2, 'std', STDDEV_SAMP(CAST({col} AS DOUBLE)) FROM rfm
  UNION ALL SELECT 3, 'min', CAST(MIN({col}) AS DOUBLE) FROM rfm
  UNION ALL SELECT 4, '25%', quantile_cont(CAST({col} AS DOUBLE), 0.25) FROM rfm
  UNION ALL SELECT 5, '50%', quantile_cont(CAST({col} AS DOUBLE), 0.5) FROM rfm
  UNION ALL SELECT 6, '75%', quantile_cont(CAST({col} AS DOUBLE), 0.75) FROM rfm
  UNION ALL SELECT 7, 'max', CAST(MAX({col}) AS DOUBLE) FROM rfm)"""


@register("prf4_rfm_describe", with_ctes(RETAIL_CTE, CLEAN_CTE, RFM_CTE, body=f"""
SELECT stat_order, statistic, r.Recency, f.Frequency, m.Monetary
FROM ({_describe_sql('Recency')}) r
JOIN ({_describe_sql('Frequency')}) f USING (stat_order, statistic)
JOIN ({_describe_sql('Monetary')}) m USING (stat_order, statistic)"""))
def q_prf4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rfm = rfm_notebook(_clean(spark, sf_dir))
    return profile.describe(rfm, ["Recency", "Frequency", "Monetary"], "CustomerID",
                            bounded=("Recency",))


# --- series ---------------------------------------------------------------------

DAILY_CTE = """
daily AS (
  SELECT country AS series_key, CAST(invoice_date AS DATE) AS Date, SUM(amount) AS rev,
         COUNT(DISTINCT invoice) AS Transactions, COUNT(DISTINCT customer_id) AS UniqueCustomers
  FROM clean GROUP BY country, CAST(invoice_date AS DATE)
  UNION ALL
  SELECT 'ALL', CAST(invoice_date AS DATE), SUM(amount), COUNT(DISTINCT invoice),
         COUNT(DISTINCT customer_id)
  FROM clean GROUP BY CAST(invoice_date AS DATE)
),
weekly AS (
  SELECT series_key, CAST(date_trunc('week', Date) AS DATE) + 6 AS Date,
         CAST(SUM(rev) AS DOUBLE) AS Revenue,
         CAST(SUM(rev) AS DECIMAL(24,3)) AS rev,
         CAST(SUM(Transactions) AS BIGINT) AS Transactions,
         CAST(SUM(UniqueCustomers) AS BIGINT) AS UniqueCustomers
  FROM daily GROUP BY series_key, CAST(date_trunc('week', Date) AS DATE) + 6
  HAVING SUM(rev) > 0
),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY Date) - 1 AS t,
         COUNT(*) OVER (PARTITION BY series_key) AS n
  FROM weekly
)"""


def series_oracle(body: str) -> str:
    return with_ctes(RETAIL_CTE, CLEAN_CTE, DAILY_CTE, body=body)


@register("agg5_daily_sales", series_oracle("""
SELECT series_key, strftime(Date, '%Y-%m-%d') AS Date, CAST(rev AS DOUBLE) AS Revenue,
       Transactions, UniqueCustomers FROM daily"""))
def q_agg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ts.daily_sales(_clean(spark, sf_dir), by="country", with_total=True)
    return d.select("series_key", date_text("Date"), "Revenue", "Transactions",
                    "UniqueCustomers")


@register("ts1_daily_gap_fill", series_oracle("""
SELECT s.series_key, strftime(s.Date, '%Y-%m-%d') AS Date,
       COALESCE(CAST(d.rev AS DOUBLE), 0) AS Revenue,
       COALESCE(d.Transactions, 0) AS Transactions,
       COALESCE(d.UniqueCustomers, 0) AS UniqueCustomers
FROM (SELECT series_key, CAST(unnest(generate_series(MIN(Date), MAX(Date), INTERVAL 1 DAY))
                                 AS DATE) AS Date
      FROM daily GROUP BY series_key) s
LEFT JOIN daily d USING (series_key, Date)"""))
def q_ts1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ts.fill_daily(ts.daily_sales(_clean(spark, sf_dir), by="country", with_total=True))
    return d.select("series_key", date_text("Date"), "Revenue", "Transactions",
                    "UniqueCustomers")


@register("agg6_weekly_sales", series_oracle("""
SELECT series_key, strftime(Date, '%Y-%m-%d') AS Date, Revenue, Transactions, UniqueCustomers
FROM weekly"""))
def q_agg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weekly_by_country(spark, sf_dir)
    return w.select("series_key", date_text("Date"), "Revenue", "Transactions",
                    "UniqueCustomers")


@register("ts2_series_range", series_oracle("""
SELECT series_key, strftime(MIN(Date), '%Y-%m-%d') AS first_date,
       strftime(MAX(Date), '%Y-%m-%d') AS last_date, COUNT(*) AS points
FROM weekly GROUP BY series_key"""))
def q_ts2(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ts.series_range(weekly_by_country(spark, sf_dir))
    return r.select("series_key", date_text("first_date"), date_text("last_date"), "points")


@register("ts4_holdout_split", series_oracle("""
SELECT series_key, strftime(Date, '%Y-%m-%d') AS Date, CAST(t AS INTEGER) AS t, n,
       CAST(t >= n - 8 AS INTEGER) AS is_test
FROM pos"""))
def q_ts4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ts.with_positions(weekly_by_country(spark, sf_dir), 8)
    return p.select("series_key", date_text("Date"), F.col("t").cast("int").alias("t"), "n",
                    "is_test")


@register("ts3_seasonal_decomposition", series_oracle("""
, tr AS (
  SELECT *, t % 4 AS phase,
         0.125 * lag(rev, 2) OVER w + 0.25 * lag(rev, 1) OVER w + 0.25 * rev
         + 0.25 * lead(rev, 1) OVER w + 0.125 * lead(rev, 2) OVER w AS trend
  FROM pos WINDOW w AS (PARTITION BY series_key ORDER BY t)
), ph AS (
  SELECT series_key, phase,
         CAST(SUM(rev - trend) AS DOUBLE) / CAST(COUNT(rev - trend) AS DOUBLE) AS pm
  FROM tr GROUP BY series_key, phase
), mm AS (
  SELECT series_key,
         (COALESCE(MAX(pm) FILTER (WHERE phase = 0), 0.0)
          + COALESCE(MAX(pm) FILTER (WHERE phase = 1), 0.0)
          + COALESCE(MAX(pm) FILTER (WHERE phase = 2), 0.0)
          + COALESCE(MAX(pm) FILTER (WHERE phase = 3), 0.0)) / CAST(COUNT(pm) AS DOUBLE) AS mpm
  FROM ph GROUP BY series_key
)
SELECT tr.series_key, strftime(tr.Date, '%Y-%m-%d') AS Date, CAST(tr.t AS INTEGER) AS t,
       CAST(tr.rev AS DOUBLE) AS observed, CAST(tr.trend AS DOUBLE) AS trend,
       ph.pm - mm.mpm AS seasonal,
       CAST(tr.rev AS DOUBLE) - CAST(tr.trend AS DOUBLE) - (ph.pm - mm.mpm) AS residual
FROM tr JOIN ph USING (series_key, phase) JOIN mm USING (series_key)"""))
def q_ts3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ts.decompose(weekly_exact_by_country(spark, sf_dir))
    return d.select("series_key", date_text("Date"), F.col("t").cast("int").alias("t"),
                    "observed", "trend", "seasonal", "residual")


@register("ts5_differencing", series_oracle("""
, dd AS (
  SELECT *, Revenue - lag(Revenue, 1) OVER w AS d1 FROM pos
  WINDOW w AS (PARTITION BY series_key ORDER BY t)
), dd2 AS (
  SELECT *, d1 - lag(d1, 4) OVER (PARTITION BY series_key ORDER BY t) AS d2 FROM dd
)
SELECT series_key, strftime(Date, '%Y-%m-%d') AS Date, CAST(t AS INTEGER) AS t, d1, d2
FROM dd2 WHERE d2 IS NOT NULL""").replace(")\n, dd AS", "),\ndd AS"))
def q_ts5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ts.difference(weekly_by_country(spark, sf_dir))
    return d.select("series_key", date_text("Date"), F.col("t").cast("int").alias("t"), "d1",
                    "d2")


@register("ts8_accuracy_seasonal_naive", series_oracle("""
, p AS (
  SELECT series_key, rev AS actual,
         lag(rev, 4) OVER (PARTITION BY series_key ORDER BY t) AS predicted,
         t >= n - 8 AS is_test
  FROM pos
)
SELECT series_key,
       CAST(SUM(abs(actual - predicted)) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS mae,
       sqrt(CAST(SUM((actual - predicted) * (actual - predicted)) AS DOUBLE)
            / CAST(COUNT(*) AS DOUBLE)) AS rmse,
       round(AVG(abs(CAST(actual - predicted AS DOUBLE) / NULLIF(CAST(actual AS DOUBLE), 0)))
             * 100.0, 6) AS mape,
       COUNT(*) AS points
FROM p WHERE is_test AND predicted IS NOT NULL GROUP BY series_key"""))
def q_ts8(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = ts.accuracy(ts.seasonal_naive_holdout(weekly_exact_by_country(spark, sf_dir)))
    return acc.select("series_key", "mae", "rmse", F.round("mape", 6).alias("mape"), "points")


@register("ts9_future_weeks", series_oracle("""
SELECT series_key, CAST(w AS INTEGER) AS Week,
       strftime(CAST(last_date + INTERVAL (7 * w) DAY AS DATE), '%Y-%m-%d') AS Date
FROM (SELECT series_key, MAX(Date) AS last_date FROM weekly GROUP BY series_key),
     range(1, 13) r(w)"""))
def q_ts9(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ts.future_weeks(weekly_by_country(spark, sf_dir), 12)
    return f.select("series_key", "Week", date_text("Date"))

"""Registered queries: sources and the six SQL-script reports (SRC*, AGG2,
AGG4, AGG7–AGG9, WIN1, SEG2, SRT1, SRT3)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import rfm, sales
from tillroll.plans.catalog import AS_OF, date_text, register, ts_text
from tillroll.plans.oracles import RETAIL_CTE, with_ctes
from tillroll.session import scratch_path
from tillroll.sources.retail import load_retail, preview, read_transactions, register_retail
from tillroll.sources.schema import RAW_COLUMN_NAMES
from tillroll.sources.sinks import write_table


def _retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_retail(spark, sf_dir)


@register("src1_read_transactions", with_ctes(RETAIL_CTE, body="""
SELECT invoice, stock_code, description, CAST(quantity AS BIGINT) AS quantity,
       strftime(invoice_date, '%Y-%m-%d %H:%M:%S') AS invoice_date,
       CAST(price AS DOUBLE) AS price, CAST(customer_id AS VARCHAR) AS customer_id, country
FROM online_retail"""))
def q_src1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: the lines written under the workbook's column names, as text with a
    header, and read by the production reader."""
    named = {lib: raw for raw, lib in RAW_COLUMN_NAMES.items()}
    lines = _retail(spark, sf_dir).withColumnsRenamed(named)
    path = write_table(lines.withColumn("InvoiceDate", F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss")),
                       scratch_path(spark, "workbook", uuid.uuid4().hex), "csv")
    df = read_transactions(spark, path, "csv")
    return df.select("invoice", "stock_code", "description",
                     F.col("quantity").cast("bigint").alias("quantity"), ts_text("invoice_date"),
                     F.col("price").cast("double").alias("price"),
                     F.col("customer_id").cast("string").alias("customer_id"), "country")


@register("src3_table_scan_sql", with_ctes(RETAIL_CTE, body="""
SELECT country, COUNT(*) AS line_count FROM online_retail GROUP BY country"""))
def q_src3(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_retail(spark, sf_dir, "online_retail")
    return spark.sql("SELECT country, COUNT(*) AS line_count FROM online_retail GROUP BY country")


@register("src4_preview", with_ctes(RETAIL_CTE, body="""
SELECT invoice, stock_code, description, CAST(quantity AS BIGINT) AS quantity,
       strftime(invoice_date, '%Y-%m-%d %H:%M:%S') AS invoice_date,
       CAST(price AS DOUBLE) AS price, CAST(customer_id AS VARCHAR) AS customer_id, country
FROM online_retail
ORDER BY invoice_date, invoice, stock_code, quantity, price, description
LIMIT 10"""))
def q_src4(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _retail(spark, sf_dir)
    top = preview(df, 10, ["invoice_date", "invoice", "stock_code", "quantity", "price",
                           F.asc_nulls_last("description")])
    return top.select("invoice", "stock_code", "description",
                      F.col("quantity").cast("bigint").alias("quantity"), ts_text("invoice_date"),
                      F.col("price").cast("double").alias("price"),
                     F.col("customer_id").cast("string").alias("customer_id"), "country")


# --- SQL variants ------------------------------------------------------------
# Oracles work from our own grains: lines that count as sold, and baskets (one row
# for each customer, invoice and whatever a report groups by).

SOLD = """
sold AS (
  SELECT *, quantity * price AS amount, CAST(invoice_date AS DATE) AS day
  FROM online_retail WHERE quantity > 0 AND price > 0
)"""

BUYERS = f"""
baskets AS (
  SELECT customer_id, invoice, max(day) AS day, sum(amount) AS amount FROM sold
  WHERE customer_id IS NOT NULL AND left(invoice, 1) <> 'C' GROUP BY ALL
),
buyers AS (
  SELECT customer_id, DATE '{AS_OF}' - max(day) AS recency, count(*) AS frequency,
         CAST(sum(amount) AS DOUBLE) AS monetary
  FROM baskets GROUP BY customer_id
)"""


def _tile(place: str) -> str:
    """Fifth of ``n`` rows that a place from 0 falls into; the first n % 5 fifths
    hold one row more."""
    return (f"CAST(1 + CASE WHEN {place} < (n % 5) * (n // 5 + 1) THEN {place} // (n // 5 + 1) "
            f"ELSE ({place} - n % 5) // (n // 5) END AS INTEGER)")


TILES = f"""
places AS (
  SELECT *, count(*) OVER () AS n,
         row_number() OVER (ORDER BY recency DESC, customer_id) - 1 AS by_recency,
         row_number() OVER (ORDER BY frequency, customer_id) - 1 AS by_frequency,
         row_number() OVER (ORDER BY monetary, customer_id) - 1 AS by_money
  FROM buyers
),
tiles AS (
  SELECT customer_id, recency, frequency, monetary, {_tile("by_recency")} AS r_score,
         {_tile("by_frequency")} AS f_score, {_tile("by_money")} AS m_score
  FROM places
)"""


@register("agg2_rfm_metrics_sql", with_ctes(RETAIL_CTE, SOLD, BUYERS, body="FROM buyers"))
def q_agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm.rfm_sql(_retail(spark, sf_dir), AS_OF)


@register("win1_ntile_rfm_scores", with_ctes(RETAIL_CTE, SOLD, BUYERS, TILES, body="FROM tiles"))
def q_win1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm.customer_rfm_scored(_retail(spark, sf_dir), AS_OF)


@register("seg2_customer_tiers_sql", with_ctes(RETAIL_CTE, SOLD, BUYERS, TILES, body="""
SELECT customer_id, recency, frequency, monetary,
       CASE WHEN lowest >= 4 THEN 'VVIC' WHEN lowest = 3 THEN 'VIC'
            WHEN m_score >= 3 OR least(r_score, f_score) > 1 THEN 'Prestige' ELSE 'One-time'
       END AS customer_tier
FROM (SELECT *, least(r_score, f_score, m_score) AS lowest FROM tiles)"""))
def q_seg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    # T21: tiers read the scored customers of the query before.
    return rfm.tiers_sql(rfm.customer_rfm_scored(_retail(spark, sf_dir), AS_OF))


@register("agg4_churn_indicators_sql", with_ctes(RETAIL_CTE, f"""
visits AS (
  SELECT customer_id, invoice, max(invoice_date) AS latest, sum(quantity * price) AS amount
  FROM online_retail WHERE customer_id IS NOT NULL GROUP BY ALL
),
customers AS (
  SELECT customer_id, max(latest) AS latest, DATE '{AS_OF}' - CAST(max(latest) AS DATE) AS away,
         count(invoice) AS orders, CAST(sum(amount) AS DOUBLE) AS amount
  FROM visits GROUP BY customer_id
)""", body="""
SELECT customer_id, strftime(latest, '%Y-%m-%d %H:%M:%S') AS last_purchase,
       away AS days_since_purchase, CAST(away > 90 AS INTEGER) AS is_churned,
       orders AS total_orders, amount AS lifetime_value
FROM customers"""))
def q_agg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sales.churn_indicators_sql(_retail(spark, sf_dir), AS_OF)
    return out.select("customer_id", ts_text("last_purchase"), "days_since_purchase",
                      "is_churned", "total_orders", "lifetime_value")


@register("agg7_weekly_sales_sql", with_ctes(RETAIL_CTE, SOLD, """
week_baskets AS (
  SELECT day - CAST(isodow(day) - 1 AS INTEGER) AS monday, invoice, customer_id,
         sum(amount) AS amount, count(*) AS lines
  FROM sold WHERE customer_id IS NOT NULL GROUP BY ALL
),
weeks AS (
  SELECT monday, CAST(sum(amount) AS DOUBLE) AS revenue, count(DISTINCT invoice) AS invoices,
         count(DISTINCT customer_id) AS customers, CAST(sum(lines) AS DOUBLE) AS lines
  FROM week_baskets GROUP BY monday
)""", body="""
SELECT strftime(monday, '%Y-%m-%d') AS week_start, revenue, invoices AS transactions,
       customers AS unique_customers, revenue / lines AS avg_order_value
FROM weeks"""))
def q_agg7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sales.weekly_sales_sql(_retail(spark, sf_dir))
    return out.select(date_text("week_start"), "revenue", "transactions", "unique_customers",
                      "avg_order_value")


@register("agg8_top_products", with_ctes(RETAIL_CTE, SOLD, """
product_baskets AS (
  SELECT stock_code, description, invoice, customer_id, sum(quantity) AS units, sum(amount) AS amount
  FROM sold GROUP BY ALL
),
products AS (
  SELECT stock_code, description, count(DISTINCT invoice) AS order_count,
         CAST(sum(units) AS BIGINT) AS units_sold, CAST(sum(amount) AS DOUBLE) AS revenue,
         count(DISTINCT customer_id) AS unique_buyers
  FROM product_baskets GROUP BY stock_code, description
)""", body="""
FROM products QUALIFY row_number() OVER (
  ORDER BY revenue DESC, stock_code NULLS FIRST, description NULLS FIRST) <= 20"""))
def q_agg8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.product_performance(_retail(spark, sf_dir), 20)


GEO_ORACLE = with_ctes(RETAIL_CTE, """
country_baskets AS (
  SELECT country, customer_id, invoice, sum(quantity * price) AS amount FROM online_retail
  WHERE quantity > 0 AND customer_id IS NOT NULL GROUP BY ALL
),
countries AS (
  SELECT country, count(DISTINCT customer_id) AS customers, count(DISTINCT invoice) AS orders,
         CAST(sum(amount) AS DOUBLE) AS revenue
  FROM country_baskets GROUP BY country
)""", body="SELECT *, revenue / customers AS avg_customer_value FROM countries")


@register("agg9_geographic_analysis", GEO_ORACLE)
def q_agg9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.geographic_analysis(_retail(spark, sf_dir))


@register("sql6_geographic_analysis_spark_sql", GEO_ORACLE)
def q_sql6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report by a SQL user on the registered view (SRC3): baskets first,
    then one pass over them."""
    register_retail(spark, sf_dir, "online_retail")
    spark.sql("""
        SELECT country, customer_id, invoice, sum(quantity * price) AS amount
        FROM online_retail WHERE quantity > 0 AND customer_id IS NOT NULL
        GROUP BY ALL""").createOrReplaceTempView("country_baskets")
    return spark.sql("""
        FROM country_baskets
        |> AGGREGATE count(DISTINCT customer_id) AS customers, count(DISTINCT invoice) AS orders,
                     CAST(sum(amount) AS DOUBLE) AS revenue GROUP BY country
        |> EXTEND try_divide(revenue, customers) AS avg_customer_value""")

"""Cleaning (FLT1–FLT3, PRJ1) and the per-report filter sets of the SQL script.

All filters are plain ``Filter`` nodes over the Parquet scan, so Catalyst
pushes the null / range predicates into the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.expressions import is_cancellation, line_amount


def clean_transactions(df: DataFrame) -> DataFrame:
    """Notebook cleaning: known customer, not a cancellation, qty>0, price>0,
    plus ``amount`` = quantity × price (exact decimal)."""
    return (df.filter(F.col("customer_id").isNotNull())
            .filter(~is_cancellation("invoice", null_as_text=True))
            .filter((F.col("quantity") > 0) & (F.col("price") > 0))
            .withColumn("amount", line_amount()))


def known_customers(df: DataFrame) -> DataFrame:
    """FLT1 alone (SQL query 3 keeps returns and cancellations)."""
    return df.filter(F.col("customer_id").isNotNull())


def sql_rfm_filter(df: DataFrame) -> DataFrame:
    """SQL query 1: all four conditions, SQL null semantics for the invoice."""
    return df.filter(F.col("customer_id").isNotNull() & (F.col("quantity") > 0)
                     & (F.col("price") > 0) & ~is_cancellation("invoice", null_as_text=False))


def sql_sales_filter(df: DataFrame) -> DataFrame:
    """SQL query 4: known customer, positive quantity and price (no cancel test)."""
    return df.filter(F.col("customer_id").isNotNull() & (F.col("quantity") > 0)
                     & (F.col("price") > 0))


def sql_product_filter(df: DataFrame) -> DataFrame:
    """SQL query 5: positive quantity and price; anonymous customers kept."""
    return df.filter((F.col("quantity") > 0) & (F.col("price") > 0))


def sql_geo_filter(df: DataFrame) -> DataFrame:
    """SQL query 6: known customer and positive quantity (no price / cancel test)."""
    return df.filter(F.col("customer_id").isNotNull() & (F.col("quantity") > 0))


def rows_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """FLT4: in-list predicate."""
    return df.filter(F.col(column).isin(values))

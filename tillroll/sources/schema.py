"""Declared schemas.  The fact table is never schema-inferred."""

from pyspark.sql import types as T

# Invoice-line fact table (snake_case names used throughout the library).
RETAIL_SCHEMA = T.StructType([
    T.StructField("invoice", T.StringType(), True),
    T.StructField("stock_code", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("quantity", T.IntegerType(), True),
    T.StructField("invoice_date", T.TimestampNTZType(), True),
    T.StructField("price", T.DecimalType(12, 3), True),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("country", T.StringType(), True),
])

# --- fixed values that must equal the reference's ---------------------------
# Column names of the raw workbook -> library names.
RAW_COLUMN_NAMES = {
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "price",
    "Customer ID": "customer_id",
    "Country": "country",
}
# -----------------------------------------------------------------------------

# Segmentation export (hand-off between the segmentation and churn jobs).
SEGMENTATION_SCHEMA = T.StructType([
    T.StructField("CustomerID", T.LongType(), False),
    T.StructField("Recency", T.LongType(), True),
    T.StructField("Frequency", T.LongType(), True),
    T.StructField("Monetary", T.DoubleType(), True),
    T.StructField("R_Score", T.IntegerType(), True),
    T.StructField("F_Score", T.IntegerType(), True),
    T.StructField("M_Score", T.IntegerType(), True),
    T.StructField("RFM_Score", T.StringType(), True),
    T.StructField("CustomerTier", T.StringType(), True),
    T.StructField("CLV", T.DoubleType(), True),
    T.StructField("AvgOrderValue", T.DoubleType(), True),
])

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("props", T.StringType(), True),
])

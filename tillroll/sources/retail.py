"""Readers for the invoice-line fact table.

* ``read_transactions`` — the production path: Parquet or CSV with the
  declared schema (raw workbook column names are renamed on the way in).
* ``tpch_retail_view`` — the adapter that derives the same fact table from
  the driver's TPC-H-style tables (lineitem, orders, part, customer, nation).
* ``load_retail`` — curated table: the adapter written once per session to
  the shared scratch folder, then scanned with pushdown by every report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.sources.schema import RAW_COLUMN_NAMES, RETAIL_SCHEMA, SEGMENTATION_SCHEMA
from tillroll.sources.tables import materialized

def _conform(df: DataFrame, text: bool = False) -> DataFrame:
    """Rename workbook columns and cast to the declared schema.  From text,
    integral columns go through an exact decimal first: the workbook stores
    customer ids as floats (blank cells), so exports carry '14527.0'."""
    renamed = df
    for raw, name in RAW_COLUMN_NAMES.items():
        if raw in renamed.columns:
            renamed = renamed.withColumnRenamed(raw, name)
    cols = []
    for f in RETAIL_SCHEMA.fields:
        c = F.col(f.name)
        if text and isinstance(f.dataType, (T.IntegerType, T.LongType)):
            c = c.cast("decimal(38,6)")
        cols.append(c.cast(f.dataType).alias(f.name))
    return renamed.select(cols)


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC1: read invoice lines with the declared schema."""
    if fmt == "csv":
        raw = (spark.read.option("header", True).option("inferSchema", False)
               .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
        return _conform(raw, text=True)
    return _conform(spark.read.parquet(path))


def read_segmentation(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC2: read the segmentation hand-off with its declared schema."""
    if fmt == "csv":
        return spark.read.schema(SEGMENTATION_SCHEMA).option("header", True).csv(path)
    return spark.read.schema(SEGMENTATION_SCHEMA).parquet(path)


def _table(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def tpch_retail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact table derived from the TPC-H-style tables (see FIXTURES.md §4).

    orders ⨝ customer on the customer key, ⨝ nation (25 rows by the TPC-H spec, so
    broadcast), before the lines join: these move for two keys only.  lineitem ⨝ part on
    the part key (shuffle join; part grows with the data), ⨝ the orders on the order key
    (shuffle join, both sides large), which leaves an invoice's lines together.  All joins
    are lossless inner joins.
    """
    li = _table(spark, sf_dir, "lineitem",
                ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"])
    od = _table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    pt = _table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    cu = _table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    na = _table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])

    returned = F.col("l_returnflag") == "R"
    placed = (od.join(cu, od.o_custkey == cu.c_custkey)
              .join(F.broadcast(na), cu.c_nationkey == na.n_nationkey)
              .select("o_orderkey", "o_custkey", "o_orderdate", "n_name"))
    joined = (li.join(pt, li.l_partkey == pt.p_partkey)
              .join(placed, li.l_orderkey == placed.o_orderkey))
    return joined.select(
        F.concat(F.when(returned, F.lit("C")).otherwise(F.lit("")),
                 F.col("l_orderkey").cast("string")).alias("invoice"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.when(F.col("l_partkey") % 50 == 0, F.lit(None)).otherwise(F.col("p_name"))
        .cast("string").alias("description"),
        F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
        .cast("int").alias("quantity"),
        F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"),
                       F.col("o_orderdate").cast("timestamp_ntz")).alias("invoice_date"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice"))
        .cast("decimal(12,2)").cast(RETAIL_SCHEMA["price"].dataType).alias("price"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(F.col("o_custkey"))
        .cast("bigint").alias("customer_id"),
        F.col("n_name").alias("country"),
    )


def load_retail(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The curated fact table for ``sf_dir``.

    The adapter join runs once per session and is written as Parquet to the
    shared scratch folder; afterwards every report is a Parquet scan with
    pushed filters and a pruned read schema.
    """
    if not materialize:
        return tpch_retail_view(spark, sf_dir)
    table = materialized(spark, "online_retail", sf_dir,
                         lambda: tpch_retail_view(spark, sf_dir))
    return table.select([F.col(f.name).cast(f.dataType) for f in RETAIL_SCHEMA.fields])


def register_retail(spark: SparkSession, sf_dir: str, name: str = "online_retail") -> DataFrame:
    """SRC3: expose the fact table to SQL as a temp view."""
    df = load_retail(spark, sf_dir)
    df.createOrReplaceTempView(name)
    return spark.table(name)


def preview(df: DataFrame, n: int = 5, order: list[str | Column] | None = None) -> DataFrame:
    """SRC4: deterministic head(n) — top-n by an explicit key (TakeOrderedAndProject)."""
    keys = order or df.columns
    return df.orderBy(*keys).limit(n)

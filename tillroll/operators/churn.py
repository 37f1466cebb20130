"""Churn features, label, feature matrix, exact stratified split, the join
with the segmentation and the retention list (AGG3, ML1–ML4, JON1, ML19,
AGG16)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.expressions import (
    CHURN_THRESHOLD_DAYS, HOME_COUNTRY, churn_flag, floor_days, home_flag, risk_band,
)
from tillroll.operators.metrics import CLASS_NAMES
from tillroll.operators.ranking import RANK, TOTAL, global_rank
from tillroll.operators.reports import distribution
from tillroll.operators.rfm import reference_date
from tillroll.session import durable_checkpoint

# --- fixed values that must equal the reference's ---------------------------
# Model feature columns, in the reference's order.
FEATURE_COLUMNS = ["Frequency", "TotalSpend", "AvgOrderValue", "StdOrderValue", "TotalQuantity",
                   "AvgQuantity", "UniqueProducts", "CustomerAge", "AvgDaysBetweenPurchases",
                   "IsUK"]
CHURN_EXPORT_COLUMNS = ["CustomerID", "Recency", "Frequency", "TotalSpend", "ChurnProbability",
                        "ChurnRisk", "Churned"]
# -----------------------------------------------------------------------------


def _sample_std(n: str, total: str, squares: str) -> Column:
    """Sample deviation of amounts from exact sums of thousandths and of their
    squares: one division and one root at the end.  NULL for fewer than two."""
    spread = F.col(n) * F.col(squares) - F.col(total) * F.col(total)
    pairs = (F.col(n) * (F.col(n) - 1)).cast("double")
    # As high and low parts, which every engine turns into the same double.
    low = spread % (1 << 32)
    high = ((spread - low) / (1 << 32)).cast("decimal(38,0)").cast("double")
    return F.when(F.col(n) > 1, F.sqrt((high * float(1 << 32) + low.cast("double")) / pairs) / 1000.0)


def customer_orders(clean: DataFrame) -> DataFrame:
    """Lines reduced to (customer, invoice, country): count, exact sums, times."""
    milli = (F.col("amount") * 1000).cast("decimal(19,0)")
    return clean.groupBy("customer_id", "invoice", "country").agg(
        F.min("invoice_date").alias("_first"), F.max("invoice_date").alias("_last"),
        F.sum("amount").alias("_spend"), F.count("amount").alias("_lines"),
        F.sum(milli).cast("decimal(38,0)").alias("_x"),
        F.sum((milli * milli).cast("decimal(38,0)")).alias("_xx"),
        F.sum("quantity").cast("bigint").alias("_quantity"))


def churn_features(clean: DataFrame, home: str = HOME_COUNTRY,
                   threshold: int = CHURN_THRESHOLD_DAYS) -> DataFrame:
    """AGG3 + ML1 + ML2: one row per customer with the reference's features.

    The lines are aggregated twice, to orders and to (customer, product); all
    else reads these smaller tables.  The country is that of the customer's
    earliest line, ties broken by name (a deterministic stand-in for pandas
    'first').  The customer table is checkpointed and gives the reference date."""
    customers = customer_orders(clean).groupBy("customer_id").agg(
        F.min("_first").alias("FirstPurchase"), F.max("_last").alias("LastPurchase"),
        F.countDistinct("invoice").alias("Frequency"), F.sum("_spend").alias("_spend"),
        F.sum("_lines").alias("_lines"), F.sum("_x").cast("decimal(38,0)").alias("_x"),
        F.sum("_xx").cast("decimal(38,0)").alias("_xx"),
        F.sum("_quantity").alias("TotalQuantity"),
        F.min(F.struct("_first", "country"))["country"].alias("Country"))
    products = (clean.groupBy("customer_id", "stock_code").agg(F.lit(1).alias("_one"))
                .groupBy("customer_id").agg(F.count("stock_code").alias("UniqueProducts")))
    per = durable_checkpoint(customers.withColumn("_std", _sample_std("_lines", "_x", "_xx"))
                             .join(products, "customer_id"))
    ref = reference_date(per, "LastPurchase")
    out = per.select(
        F.col("customer_id").alias("CustomerID"), "FirstPurchase", "LastPurchase",
        floor_days("LastPurchase", ref).cast("bigint").alias("Recency"),
        "Frequency",
        F.col("_spend").cast("double").alias("TotalSpend"),
        (F.col("_spend").cast("double") / F.col("_lines")).alias("AvgOrderValue"),
        F.coalesce(F.col("_std"), F.lit(0.0)).alias("StdOrderValue"),
        "TotalQuantity",
        (F.col("TotalQuantity").cast("double") / F.col("_lines")).alias("AvgQuantity"),
        "UniqueProducts", "Country")
    age = floor_days("FirstPurchase", "LastPurchase").cast("bigint")
    return (out.withColumn("CustomerAge", age)
            .withColumn("AvgDaysBetweenPurchases",
                        F.col("CustomerAge") / F.greatest(F.col("Frequency"), F.lit(1)))
            .withColumn("IsUK", home_flag("Country", home))
            .withColumn("Churned", churn_flag("Recency", threshold)))


def feature_matrix(features: DataFrame, columns: list[str] = FEATURE_COLUMNS,
                   label: str = "Churned") -> DataFrame:
    """ML3: nulls → 0, ``features`` vector and double ``label``."""
    filled = features.na.fill(0, subset=columns)
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")
    return assembler.transform(filled).withColumn("label", F.col(label).cast("double"))


def split_hash(key: str, seed: int) -> F.Column:
    """Deterministic per-row order for splits (same text in DuckDB: md5)."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_split(df: DataFrame, label: str = "Churned", key: str = "CustomerID",
                     test_size: float = 0.2, seed: int = 42, folds: int = 5) -> DataFrame:
    """ML4: exact stratified split — within each class, rows ordered by a
    seeded hash; the first ``ceil(test_size · n_class)`` are test rows.  Also
    adds a stratified ``fold`` (0..folds−1) for cross-validation.

    Ranks within a class come from one global ranking (range-partitioned, no
    single-task window); class offsets are a table with one row per class."""
    frac = Fraction(test_size).limit_denominator(1000)
    ordered = df.withColumn("_h", split_hash(key, seed))
    ranked = global_rank(ordered, [label, "_h", key])
    offsets = ranked.groupBy(label).agg((F.min(RANK) - 1).alias("_off"),
                                        F.count(F.lit(1)).alias("_nc"))
    within = F.col(RANK) - F.col("_off")
    n_test = F.floor((F.col("_nc") * frac.numerator + frac.denominator - 1)
                     / frac.denominator)
    return (ranked.join(offsets, label)
            .withColumn("is_test", (within <= n_test).cast("int"))
            .withColumn("fold", ((within - 1) % folds).cast("int"))
            .drop(RANK, TOTAL, "_off", "_nc", "_h"))


def fixed_score(features: DataFrame) -> DataFrame:
    """A deterministic stand-in probability for checking the metric operators
    exactly without a fitted model: recency / (recency + 30·frequency)."""
    score = F.try_divide(F.col("Recency").cast("double"),
                         (F.col("Recency") + 30 * F.col("Frequency")).cast("double"))
    return features.withColumn("ChurnProbability", F.coalesce(score, F.lit(0.0)))


def with_risk(scored: DataFrame, prob: str = "ChurnProbability") -> DataFrame:
    """ML17 tail: the risk band of each probability."""
    return scored.withColumn("ChurnRisk", risk_band(prob))


def join_segments(scored: DataFrame, segments: DataFrame) -> DataFrame:
    """JON1: left join on CustomerID (1:1).  Both sides are customer-grain;
    AQE chooses broadcast when the segmentation side is small, otherwise a
    sort-merge join on the customer key."""
    return scored.join(segments.select("CustomerID", "CustomerTier", "CLV"), "CustomerID", "left")


def priority_retention(merged: DataFrame) -> DataFrame:
    """ML19: high churn risk among VVIC / VIC customers."""
    return merged.filter((F.col("ChurnRisk") == "High")
                         & F.col("CustomerTier").isin(["VVIC", "VIC"]))


def clv_at_risk(retention: DataFrame) -> DataFrame:
    """AGG16: size of the retention list and its CLV (exact sum)."""
    return retention.agg(F.count(F.lit(1)).alias("customers_at_risk"),
                         F.coalesce(F.sum(F.col("CLV").cast("decimal(38,3)")), F.lit(0))
                         .cast("double").alias("clv_at_risk"))


def label_distribution(features: DataFrame, label: str = "Churned") -> DataFrame:
    """AGG10 for the churn label: customers and share per class, both classes
    present even when one is empty (T24)."""
    domain = features.sparkSession.createDataFrame(
        list(enumerate(CLASS_NAMES)), f"{label} int, class_name string")
    return distribution(features.withColumn(label, F.col(label).cast("int")), label, domain)

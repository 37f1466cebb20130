"""RFM metrics, quintile scores, tiers and customer value (AGG1, AGG2, WIN1–WIN4,
FN2, FN3, CLV1–CLV4, SEG1, SEG2).

Scalars the notebook pulls to the driver (reference date, maximum recency)
stay inside the plan as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.expressions import (
    calendar_days, clip_lower, floor_days, line_amount, tier,
)
from tillroll.operators.clean import clean_transactions, sql_rfm_filter
from tillroll.operators.ranking import (
    RANK, TOTAL, global_rank, ntile_from_rank, qcut_rank_first, value_quintile,
)
from tillroll.operators.sales import as_of_date
from tillroll.session import durable_checkpoint


def reference_date(customers: DataFrame, last_col: str = "_last") -> Column:
    """T1: latest purchase + 1 day, as a scalar subquery (evaluated once,
    inlined as a value — no join, nothing collected)."""
    return customers.agg((F.max(last_col) + F.expr("INTERVAL 1 DAY")).alias("ref_ts")).scalar()


def rfm_notebook(clean: DataFrame) -> DataFrame:
    """AGG1: CustomerID, Recency (whole 24 h days to max date + 1 day),
    Frequency (distinct invoices), Monetary (exact sum, then double).

    The invoice lines are aggregated once; the customer table is checkpointed
    and the reference date (a one-row broadcast) is taken from it, so the
    line-level aggregation is never repeated."""
    per_cust = durable_checkpoint(clean.groupBy("customer_id").agg(
        F.max("invoice_date").alias("_last"),
        F.countDistinct("invoice").alias("Frequency"),
        F.sum("amount").alias("_money")))
    ref = reference_date(per_cust)
    return per_cust.select(
        F.col("customer_id").alias("CustomerID"),
        floor_days("_last", ref).cast("bigint").alias("Recency"),
        F.col("Frequency"),
        F.col("_money").cast("double").alias("Monetary"))


def score_notebook(rfm: DataFrame, q: int = 5) -> DataFrame:
    """WIN2–WIN4 + FN2: R = reversed value quintile of Recency, F = quintile of
    the first-occurrence rank of Frequency (ties by CustomerID), M = value
    quintile of Monetary; RFM_Score = concatenation."""
    scored = value_quintile(rfm, "Recency", "CustomerID", "R_Score", q, reverse=True,
                            bounded_domain=True)
    scored = value_quintile(scored, "Monetary", "CustomerID", "M_Score", q)
    ranked = global_rank(scored, ["Frequency", "CustomerID"])
    scored = (ranked.withColumn("F_Score", qcut_rank_first(RANK, TOTAL, q))
              .drop(RANK, TOTAL))
    return scored.withColumn(
        "RFM_Score", F.concat(F.col("R_Score").cast("string"), F.col("F_Score").cast("string"),
                              F.col("M_Score").cast("string")))


def assign_tiers(scored: DataFrame, r: str = "R_Score", f: str = "F_Score",
                 m: str = "M_Score", out: str = "CustomerTier") -> DataFrame:
    """FN3 / UDF1: CASE rule on the three scores (no Python UDF)."""
    return scored.withColumn(out, tier(r, f, m))


def customer_value(rfm: DataFrame) -> DataFrame:
    """CLV1–CLV4: AvgOrderValue, ActiveDays (max recency − recency, the max as
    a scalar subquery), EstimatedLifespan (years, ≥0.1), CLV (=Monetary),
    AnnualCLV = AOV × Frequency / max(lifespan, 0.5)."""
    max_rec = rfm.agg(F.max("Recency")).scalar()
    with_max = rfm.withColumn("_max_recency", max_rec)
    aov = F.col("Monetary") / F.col("Frequency").cast("double")
    active = F.col("_max_recency") - F.col("Recency")
    lifespan = clip_lower(active / F.lit(365.0), 0.1)
    return (with_max
            .withColumn("AvgOrderValue", aov)
            .withColumn("ActiveDays", active.cast("bigint"))
            .withColumn("EstimatedLifespan", lifespan)
            .withColumn("CLV", F.col("Monetary"))
            .withColumn("AnnualCLV", F.col("AvgOrderValue") * (
                F.col("Frequency").cast("double") / clip_lower("EstimatedLifespan", 0.5)))
            .drop("_max_recency"))


# --- fixed values that must equal the reference's ---------------------------
# Columns of the segmentation export, in the reference's order.
SEGMENTATION_COLUMNS = ["CustomerID", "Recency", "Frequency", "Monetary", "R_Score", "F_Score",
                        "M_Score", "RFM_Score", "CustomerTier", "CLV", "AvgOrderValue"]
# -----------------------------------------------------------------------------


def segment_customers(transactions: DataFrame, q: int = 5) -> DataFrame:
    """SEG1: clean → RFM → scores → tier → customer value (all columns).
    The scoring passes and the CLV step re-read the checkpointed customer
    table, never the invoice lines."""
    rfm = rfm_notebook(clean_transactions(transactions))
    return customer_value(assign_tiers(score_notebook(rfm, q)))


# --- SQL variant (queries 1 and 2) ------------------------------------------

def rfm_sql(transactions: DataFrame, as_of=None) -> DataFrame:
    """AGG2: SQL query 1's CTE — calendar-day recency to ``as_of``
    (CURRENT_DATE by default)."""
    ref = as_of_date(as_of)
    agg = sql_rfm_filter(transactions).groupBy("customer_id").agg(
        F.max("invoice_date").alias("_last"),
        F.countDistinct("invoice").alias("frequency"),
        F.sum(line_amount()).alias("_money"))
    return agg.select("customer_id",
                      calendar_days("_last", ref).cast("bigint").alias("recency"),
                      "frequency", F.col("_money").cast("double").alias("monetary"))


def ntile_scores(rfm: DataFrame, tiles: int = 5) -> DataFrame:
    """WIN1: NTILE(tiles) for recency DESC, frequency ASC, monetary ASC with
    customer_id as the deterministic tie-break, via exact global ranks."""
    out = durable_checkpoint(rfm)
    for name, order in (("r_score", [F.col("recency").desc(), F.col("customer_id").asc()]),
                        ("f_score", [F.col("frequency").asc(), F.col("customer_id").asc()]),
                        ("m_score", [F.col("monetary").asc(), F.col("customer_id").asc()])):
        out = (global_rank(out, order)
               .withColumn(name, ntile_from_rank(RANK, TOTAL, tiles))
               .drop(RANK, TOTAL))
    return out


def customer_rfm_scored(transactions: DataFrame, as_of=None) -> DataFrame:
    """SQL query 1 result (registered as ``customer_rfm_scored`` for query 2)."""
    return ntile_scores(rfm_sql(transactions, as_of)).select(
        "customer_id", "recency", "frequency", "monetary", "r_score", "f_score", "m_score")


def tiers_sql(scored: DataFrame) -> DataFrame:
    """SEG2 (SQL query 2): tier from the NTILE scores."""
    return scored.select("customer_id", "recency", "frequency", "monetary",
                         tier("r_score", "f_score", "m_score").alias("customer_tier"))

"""The SQL-variant reports: exact tiles against pandas, options, hot customers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import rfm, sales
from tillroll.sources.retail import register_retail

AS_OF = "2001-08-02"


@pytest.fixture(scope="module")
def retail(spark, sf_small):
    return register_retail(spark, sf_small, "online_retail")


def _tiles(pdf, by, ascending):
    """NTILE(5): five runs of the sorted rows, the first ones longer by one."""
    order = pdf.sort_values([by, "customer_id"], ascending=[ascending, True]).index
    out = np.empty(len(pdf), dtype=int)
    for k, part in enumerate(np.array_split(order.to_numpy(), 5), start=1):
        out[part] = k
    return out


def _check_scores(lines):
    got = rfm.customer_rfm_scored(lines, AS_OF).toPandas().sort_values("customer_id").reset_index(drop=True)
    assert len(got)
    for score, by, ascending in (("r_score", "recency", False), ("f_score", "frequency", True),
                                 ("m_score", "monetary", True)):
        assert got[score].tolist() == _tiles(got, by, ascending).tolist()


def test_scores_are_exact_tiles(retail):
    _check_scores(retail)


def test_tiers_follow_the_scores(retail):
    scored = rfm.customer_rfm_scored(retail, AS_OF)
    tiers = rfm.tiers_sql(scored).select("customer_id", "customer_tier")
    for r in scored.join(tiers, "customer_id").collect():
        low = min(r.r_score, r.f_score, r.m_score)
        want = ("VVIC" if low >= 4 else "VIC" if low == 3 else
                "Prestige" if r.m_score >= 3 or min(r.r_score, r.f_score) >= 2 else "One-time")
        assert r.customer_tier == want


def test_current_date_default(retail):
    assert sales.churn_indicators_sql(retail).agg(F.min("days_since_purchase")).first()[0] > 0


def test_approximate_distinct_option_is_close(retail):
    exact = sales.geographic_analysis(retail).toPandas().set_index("country")
    approx = sales.geographic_analysis(retail, exact=False).toPandas().set_index("country")
    rel = (approx["orders"] - exact["orders"]).abs() / exact["orders"]
    assert (rel <= 0.05).all()
    assert "Expand" not in sales.geographic_analysis(retail, exact=False)._jdf.queryExecution() \
        .executedPlan().toString()


def test_scores_under_a_hot_customer(retail):
    """A third of all lines moved to one customer."""
    _check_scores(retail.withColumn(
        "customer_id", F.when(F.abs(F.hash("invoice", "stock_code")) % 3 == 0, F.lit(1))
        .otherwise(F.col("customer_id"))))


def test_notebook_scores_under_a_hot_customer_match_pandas(spark, retail):
    import pandas as pd
    from tillroll.operators.clean import clean_transactions
    skewed = retail.withColumn(
        "customer_id", F.when(F.abs(F.hash("invoice", "stock_code")) % 3 == 0, F.lit(1))
        .otherwise(F.col("customer_id")))
    r = rfm.rfm_notebook(clean_transactions(skewed))
    got = rfm.score_notebook(r).toPandas().sort_values("CustomerID").reset_index(drop=True)
    pdf = r.toPandas().sort_values("CustomerID").reset_index(drop=True)
    want_r = pd.qcut(pdf["Recency"], 5, labels=[5, 4, 3, 2, 1], duplicates="drop")
    want_f = pd.qcut(pdf["Frequency"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5])
    want_m = pd.qcut(pdf["Monetary"], 5, labels=[1, 2, 3, 4, 5], duplicates="drop")
    assert got["R_Score"].tolist() == want_r.astype(int).tolist()
    assert got["F_Score"].tolist() == want_f.astype(int).tolist()
    assert got["M_Score"].tolist() == want_m.astype(int).tolist()

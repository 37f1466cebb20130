"""Hand-made edge rows: null customer / invoice / description, cancellations,
zero price, single-line customer, Sunday/Monday boundary, sub-24-hour
recency, probability 0, zero actuals, missing class."""

import datetime as dt
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.functions import expressions as X
from tillroll.operators import churn, clean, metrics, rfm, sales, timeseries as ts
from tillroll.sources.schema import RETAIL_SCHEMA


def T(s):
    return dt.datetime.fromisoformat(s)


ROWS = [
    # invoice, stock, description, qty, date, price, customer, country
    ("1001", "A", "Lamp", 2, T("2011-01-02 23:59:00"), Decimal("10.000"), 1, "UK"),  # Sunday
    ("1002", "B", None, 1, T("2011-01-03 00:00:00"), Decimal("5.500"), 1, "UK"),     # Monday
    ("C1003", "A", "Lamp", -2, T("2011-01-04 10:00:00"), Decimal("10.000"), 1, "UK"),
    ("1004", "C", "Mug", 3, T("2011-01-05 10:00:00"), Decimal("0.000"), 2, "FR"),    # price 0
    ("1005", "C", "Mug", 1, T("2011-01-05 11:00:00"), Decimal("4.000"), None, "FR"),  # anon
    (None, "D", "Pen", 1, T("2011-01-06 12:00:00"), Decimal("1.000"), 3, "DE"),      # null inv
    ("1007", "E", "Cup", 1, T("2011-01-07 23:00:00"), Decimal("2.000"), 4, "DE"),    # 1 line
    ("1008", "E", "Cup", 1, T("2011-01-08 22:00:00"), Decimal("2.000"), 5, "DE"),    # latest
]


@pytest.fixture(scope="module")
def retail(spark):
    return spark.createDataFrame(ROWS, RETAIL_SCHEMA)


def test_notebook_cleaning_rules(retail):
    got = clean.clean_transactions(retail).select("invoice").toPandas()["invoice"].tolist()
    # null invoice kept (text 'nan' is not a cancellation), anon / cancel / price 0 dropped
    assert sorted(got, key=str) == sorted(["1001", "1002", None, "1007", "1008"], key=str)


def test_sql_cleaning_drops_null_invoice(retail):
    got = clean.sql_rfm_filter(retail).select("invoice").toPandas()["invoice"].tolist()
    assert None not in got and len(got) == 4


def test_week_labels_sunday_vs_monday(retail):
    out = retail.select(X.week_ending_sunday("invoice_date").alias("sun"),
                        X.week_starting_monday("invoice_date").alias("mon")).toPandas()
    assert str(out.loc[0, "sun"]) == "2011-01-02" and str(out.loc[1, "sun"]) == "2011-01-09"
    assert str(out.loc[0, "mon"])[:10] == "2010-12-27" and str(out.loc[1, "mon"])[:10] == "2011-01-03"


def test_floor_days_vs_calendar_days(spark):
    df = spark.createDataFrame([(T("2011-01-07 23:00:00"), T("2011-01-08 01:00:00"))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(X.floor_days("a", "b").alias("f"), X.calendar_days("a", "b").alias("c")).first()
    assert (r["f"], r["c"]) == (0, 1)


def test_rfm_reference_date_and_single_line_customer(retail):
    r = rfm.rfm_notebook(clean.clean_transactions(retail)).toPandas().set_index("CustomerID")
    # reference = 2011-01-09 22:00; customer 4's last line 2011-01-07 23:00 → 1 whole day
    assert r.loc[4, "Recency"] == 1 and r.loc[5, "Recency"] == 1
    assert r.loc[1, "Frequency"] == 2 and r.loc[1, "Monetary"] == pytest.approx(25.5)
    f = churn.churn_features(clean.clean_transactions(retail), home="UK").toPandas()
    assert f.set_index("CustomerID").loc[4, "StdOrderValue"] == 0.0
    assert f.set_index("CustomerID").loc[1, "IsUK"] == 1


def test_tier_rule_is_the_code_not_the_comment(spark):
    df = spark.createDataFrame([(5, 5, 4), (3, 3, 3), (1, 1, 3), (2, 2, 1), (1, 5, 2)],
                               "r int, f int, m int")
    got = [r[0] for r in df.select(X.tier("r", "f", "m")).collect()]
    assert got == ["VVIC", "VIC", "Prestige", "Prestige", "One-time"]


def test_risk_band_zero_probability_is_null(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.30001,), (0.6,), (1.0,), (1.2,)], "p double")
    got = [r[0] for r in df.select(X.risk_band("p")).collect()]
    assert got == [None, "Low", "Medium", "Medium", "High", None]


def test_geo_ratio_never_divides_by_zero(retail):
    out = sales.geographic_analysis(retail).toPandas()
    assert out["avg_customer_value"].notna().all()


def test_mape_skips_zero_actuals(spark):
    df = spark.createDataFrame([("S", 0.0, 1.0), ("S", 2.0, 1.0)],
                               "series_key string, actual double, predicted double")
    r = ts.accuracy(df).first()
    assert r["mape"] == pytest.approx(50.0) and r["mae"] == pytest.approx(1.0)


def test_confusion_matrix_with_missing_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "label int, prediction int")
    cm = metrics.confusion_matrix(df).orderBy("actual").toPandas()
    assert cm.values.tolist() == [[0, 0, 0], [1, 1, 2]]
    rep = metrics.classification_report(df).toPandas().set_index("class_name")
    assert rep.loc["Active", "precision"] == 0.0 and rep.loc["Churned", "support"] == 3


def test_auc_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    n = 300
    score = rng.integers(0, 20, n) / 20.0  # many ties
    label = (rng.random(n) < 0.3 + 0.5 * score).astype(int)
    pdf = pd.DataFrame({"id": range(n), "score": score, "label": label})
    pos, neg = score[label == 1], score[label == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) \
        / (len(pos) * len(neg))
    df = spark.createDataFrame(pdf)
    got = metrics.auc(df, "label", "score", "id").first()["auc"]
    assert got == pytest.approx(brute, abs=1e-12)
    flipped = metrics.auc(df.withColumn("score", -F.col("score")), "label", "score", "id")
    assert flipped.first()["auc"] == pytest.approx(1 - brute, abs=1e-12)
    roc = metrics.roc_curve(df, "label", "score").toPandas()
    assert roc["fpr"].max() == 1.0 and roc["tpr"].max() == 1.0
    assert len(roc) == len(set(score)) + 1


def test_stratified_split_is_exact(spark):
    pdf = pd.DataFrame({"CustomerID": range(103), "Churned": [1] * 70 + [0] * 33})
    out = churn.stratified_split(spark.createDataFrame(pdf)).toPandas()
    per = out.groupby("Churned")["is_test"].sum().to_dict()
    assert per == {0: 7, 1: 14}  # ceil(0.2 * n) per class
    assert sorted(out["fold"].unique().tolist()) == [0, 1, 2, 3, 4]


def test_recommended_conf_scales_with_input():
    from tillroll.session import recommended_conf
    small = recommended_conf(10 << 30, executors=2, cores_per_executor=4)
    huge = recommended_conf(100 << 40, executors=1000, cores_per_executor=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(huge["spark.sql.shuffle.partitions"]) == (100 << 40) // 4 // (256 << 20)
    assert huge["spark.sql.adaptive.skewJoin.enabled"] == "true"

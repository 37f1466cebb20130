"""End-to-end jobs on the smoke data, and the production reader with the
workbook's column names."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tillroll.operators import models
from tillroll.plans import jobs
from tillroll.session import scratch_path
from tillroll.sources.retail import read_segmentation, read_transactions, tpch_retail_view
from tillroll.sources.schema import RETAIL_SCHEMA


def test_read_transactions_csv_with_workbook_names(spark):
    path = scratch_path(spark, "test_raw", uuid.uuid4().hex)
    raw = spark.createDataFrame(
        [("536365", "85123A", "WHITE HANGING HEART", 6, dt.datetime(2010, 12, 1, 8, 26), 2.55,
          17850.0, "United Kingdom"),
         ("C536379", "D", "Discount", -1, dt.datetime(2010, 12, 1, 9, 41), 27.5, 14527.0,
          "United Kingdom")],
        "Invoice string, StockCode string, Description string, Quantity int, "
        "InvoiceDate timestamp_ntz, Price double, `Customer ID` double, Country string")
    raw.write.option("header", True).csv(path)
    df = read_transactions(spark, path, "csv")
    assert df.schema == RETAIL_SCHEMA
    rows = df.orderBy("invoice").collect()
    assert rows[0]["customer_id"] == 17850 and str(rows[0]["price"]) == "2.550"
    assert rows[0]["invoice_date"] == dt.datetime(2010, 12, 1, 8, 26)


def test_segmentation_then_churn_jobs(spark, sf_small):
    out = scratch_path(spark, "test_jobs", uuid.uuid4().hex)
    lines = tpch_retail_view(spark, sf_small)
    seg_paths = jobs.segmentation_job(lines, out)
    seg = read_segmentation(spark, seg_paths["customer_segmentation"])
    assert seg.count() == 150
    kpi = spark.read.parquet(seg_paths["kpi_summary"]).collect()
    assert {r["Metric"] for r in kpi} >= {"Total Customers", "VVIC Count"}
    small = {models.FOREST: {"trees": 4}, models.BOOSTED: {"rounds": 3}}
    paths = jobs.churn_job(lines, out, seg_paths["customer_segmentation"], home="NATION_0", fit_args=small)
    preds = spark.read.csv(paths["churn_predictions"], header=True)
    assert preds.count() == 150
    assert spark.read.parquet(paths["clv_at_risk"]).count() == 1
    board = spark.read.parquet(paths["model_leaderboard"]).collect()
    assert {r.model for r in board} == set(models.MODEL_NAMES) and sum(r.is_best for r in board) == 1
    scores = spark.read.parquet(paths["model_scores"])
    assert scores.count() == 3 * 150
    n_test = scores.where("fit = 0").count() // 3
    report = {r.class_name: r for r in spark.read.parquet(paths["classification_report"]).collect()}
    assert report["accuracy"].support == n_test
    cells = spark.read.parquet(paths["confusion_matrix"]).agg(F.sum(F.col("predicted_0") + F.col("predicted_1"))).first()
    assert cells[0] == n_test
    assert spark.read.parquet(paths["roc_curves"]).select("model").distinct().count() == 3
    assert spark.read.parquet(paths["feature_importance"]).count() == 10
    loaded = models.load_model(spark, paths["model_gradient_boosted_trees"])
    assert loaded.select("tree").distinct().count() == 3


def test_forecast_job_per_country(spark, sf_small):
    out = scratch_path(spark, "test_jobs", uuid.uuid4().hex)
    paths = jobs.forecast_job(tpch_retail_view(spark, sf_small), out, by="country")
    fc = spark.read.parquet(paths["revenue_forecast"])
    assert fc.filter(F.col("series_key") == "ALL").count() == 12


def test_kpi_stream_job(spark, sf_small):
    from tillroll.streaming import kpis
    run = uuid.uuid4().hex
    out, ckpt = scratch_path(spark, "test_jobs", run, "o"), scratch_path(spark, "test_jobs", run,
                                                                         "c")
    jobs.kpi_stream_job(spark, sf_small, out, ckpt).awaitTermination()
    got = kpis.read_latest(spark, out)
    assert got.agg(F.sum("events")).first()[0] == spark.read.parquet(
        f"{sf_small}/events.parquet").count()


def test_register_views_for_sql_users(spark, sf_small):
    from tillroll.plans.views import register_views
    names = register_views(spark, sf_small)
    assert {"online_retail", "customer_segmentation", "weekly_sales"} <= set(names)
    tiers = spark.sql("SELECT CustomerTier, COUNT(*) AS n FROM customer_segmentation "
                      "GROUP BY CustomerTier").toPandas()
    assert tiers["n"].sum() == 150
    fc = spark.sql("SELECT COUNT(*) FROM revenue_forecast WHERE series_key = 'ALL'").first()[0]
    assert fc == 12

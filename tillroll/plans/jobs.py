"""End-to-end batch jobs: segmentation, churn and forecasting.

Each job reads the invoice lines, runs the library's operators and writes
its result tables; nothing is collected to the driver except the handful of
model metrics.

    python -m tillroll.plans.jobs segmentation --lines PATH --out DIR
    python -m tillroll.plans.jobs churn --lines PATH --out DIR [--home "United Kingdom"]
    python -m tillroll.plans.jobs forecast --lines PATH --out DIR [--by country]
    python -m tillroll.plans.jobs kpis --events DIR --out DIR --checkpoint DIR
                                       [--every "1 minute"]

``--lines`` is a Parquet (or ``--format csv``) folder of invoice lines with
the workbook's or the library's column names; ``--tpch DIR`` derives the
lines from TPC-H-style tables instead.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.expressions import HOME_COUNTRY
from tillroll.operators import churn, forecast, models, reports, rfm, timeseries as ts
from tillroll.operators.clean import clean_transactions
from tillroll.operators.metrics import classification_report, confusion_matrix, risk_distribution, roc_curve
from tillroll.session import clear_scratch, durable_checkpoint, scratch_dir
from tillroll.sources.retail import read_segmentation, read_transactions, tpch_retail_view
from tillroll.sources.sinks import write_table
from tillroll.streaming import kpis


def segmentation_job(lines: DataFrame, out: str) -> dict[str, str]:
    """Segmentation: export (11 columns, CSV with header) plus the summary
    tables (tier distribution, revenue, CLV, concentration, at-risk, KPIs)."""
    seg = rfm.segment_customers(lines)
    base = write_table(seg, f"{out}/segmentation_full")
    seg = lines.sparkSession.read.parquet(base)
    paths = {"customer_segmentation": write_table(
        seg.select(*rfm.SEGMENTATION_COLUMNS), f"{out}/customer_segmentation", "csv")}
    for name, fn in (("tier_distribution", reports.tier_distribution),
                     ("tier_revenue", reports.tier_revenue),
                     ("clv_summary", reports.clv_summary),
                     ("concentration", reports.concentration),
                     ("at_risk", reports.at_risk),
                     ("kpi_summary", reports.kpi_summary)):
        paths[name] = write_table(fn(seg), f"{out}/{name}")
    return paths


def churn_job(lines: DataFrame, out: str, segmentation_csv: str | None = None,
              home: str = HOME_COUNTRY, names: list[str] = models.MODEL_NAMES,
              fit_args: dict[str, dict] | None = None) -> dict[str, str]:
    """Churn: features → split → three models with cross-validation → leaderboard, report,
    matrix and curves on the test rows, importances; scores of every customer by the
    boosted trees, risk distribution, retention list joined with the segmentation export,
    the models as tables.  ``fit_args`` are parameters of the fits by model name."""
    spark = lines.sparkSession
    feats = churn.stratified_split(churn.churn_features(clean_transactions(lines), home=home))
    matrix = durable_checkpoint(churn.feature_matrix(feats))
    paths, scores, fits = {}, None, {}
    for name in names:
        fits[name] = models.fit(name, matrix, **(fit_args or {}).get(name, {}))
        slug = name.lower().replace(" ", "_").replace("-", "_")
        paths[f"model_{slug}"] = models.save_model(fits[name].table, f"{out}/model_{slug}")
        each = fits[name].scores.withColumn("model", F.lit(name))
        scores = each if scores is None else scores.unionByName(each)
    scores = spark.read.parquet(write_table(scores, f"{out}/model_scores"))
    paths["model_scores"] = f"{out}/model_scores"
    board = spark.read.parquet(write_table(models.leaderboard(scores), f"{out}/model_leaderboard"))
    paths["model_leaderboard"] = f"{out}/model_leaderboard"
    best = board.agg(F.max(F.when(F.col("is_best") == 1, F.col("model")))).scalar()
    judged = models.test_predictions(scores.where(F.col("model") == best))
    paths["classification_report"] = write_table(classification_report(judged), f"{out}/classification_report")
    paths["confusion_matrix"] = write_table(confusion_matrix(judged), f"{out}/confusion_matrix")
    curves = [roc_curve(models.test_predictions(scores.where(F.col("model") == n)), "label", "score")
              .withColumn("model", F.lit(n)) for n in names]
    paths["roc_curves"] = write_table(reduce(DataFrame.unionByName, curves), f"{out}/roc_curves")
    if models.BOOSTED not in names:
        return paths
    table = spark.read.parquet(paths["model_gradient_boosted_trees"])
    paths["feature_importance"] = write_table(models.feature_importances(table, top=None), f"{out}/feature_importance")
    scored = durable_checkpoint(models.score_customers(table, matrix))
    paths["churn_predictions"] = write_table(
        scored.select(*churn.CHURN_EXPORT_COLUMNS), f"{out}/churn_predictions", "csv")
    paths["risk_distribution"] = write_table(risk_distribution(scored), f"{out}/risk_distribution")
    if segmentation_csv:
        merged = churn.join_segments(scored, read_segmentation(spark, segmentation_csv))
        retention = churn.priority_retention(merged)
        paths["priority_retention"] = write_table(retention.select(
            "CustomerID", "ChurnProbability", "CustomerTier", "CLV"), f"{out}/priority_retention")
        paths["clv_at_risk"] = write_table(churn.clv_at_risk(retention), f"{out}/clv_at_risk")
    return paths


def forecast_job(lines: DataFrame, out: str, by: str | None = None) -> dict[str, str]:
    """Forecasting: weekly series (total, or per ``by`` value plus the total),
    decomposition, hold-out accuracy, 12-week forecast and its summary."""
    weekly = ts.weekly_sales(clean_transactions(lines), by=by, with_total=by is not None)
    weekly_path = write_table(weekly, f"{out}/weekly_sales")
    weekly = lines.sparkSession.read.parquet(weekly_path)
    table = forecast.forecast_table(weekly)
    return {
        "weekly_sales": weekly_path,
        "decomposition": write_table(ts.decompose(weekly), f"{out}/decomposition"),
        "holdout_accuracy": write_table(forecast.holdout_accuracy(weekly),
                                        f"{out}/holdout_accuracy"),
        "revenue_forecast": write_table(table, f"{out}/revenue_forecast"),
        "forecast_summary": write_table(forecast.forecast_summary(table),
                                        f"{out}/forecast_summary"),
    }


class KpiQueries(list):
    """The running queries of the KPI table."""

    def awaitTermination(self) -> None:
        for query in self:
            query.awaitTermination()


def kpi_stream_job(spark: SparkSession, events_dir: str, out: str, checkpoint: str,
                   every: str | None = None) -> KpiQueries:
    """Streaming weekly KPIs and exact distinct users over event files: run to completion
    over what is there (``every=None``, availableNow) or keep running on a processing-time
    trigger.  Returns the two streaming queries."""
    events = kpis.event_stream(spark, events_dir)
    how = {"available_now": every is None, "processing_time": every}
    return KpiQueries([
        kpis.run_to_table(kpis.weekly_kpis(events, approx_users=False), out, f"{checkpoint}/kpis", **how),
        kpis.run_users_to_table(kpis.weekly_users(events), out, f"{checkpoint}/users", **how)])


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="tillroll.plans.jobs")
    ap.add_argument("job", choices=["segmentation", "churn", "forecast", "kpis"])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--lines")
    src.add_argument("--tpch")
    src.add_argument("--events")
    ap.add_argument("--checkpoint")
    ap.add_argument("--every")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--out", required=True)
    ap.add_argument("--segmentation-csv")
    ap.add_argument("--home", default=HOME_COUNTRY)
    ap.add_argument("--by")
    args = ap.parse_args(argv)
    spark = _job_session()
    try:
        _run(spark, args)
    finally:
        clear_scratch(spark)


def _job_session() -> SparkSession:
    """The session of ``spark-submit`` (its master and settings), or a local one;
    jobs read wall-clock times, so the session zone is UTC either way."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("tillroll").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    scratch_dir(spark)  # fails now, not in the middle, without a shared folder on a cluster
    return spark


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "kpis":
        query = kpi_stream_job(spark, args.events, args.out, args.checkpoint, args.every)
        query.awaitTermination()
        return
    lines = (tpch_retail_view(spark, args.tpch) if args.tpch
             else read_transactions(spark, args.lines, args.format))
    if args.job == "segmentation":
        paths = segmentation_job(lines, args.out)
    elif args.job == "churn":
        paths = churn_job(lines, args.out, args.segmentation_csv, args.home)
    else:
        paths = forecast_job(lines, args.out, args.by)
    for name, path in paths.items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()

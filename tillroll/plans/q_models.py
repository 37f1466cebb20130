"""Registered queries: fitted churn models (ML5–ML9, ML11, ML12, ML16, ML17, SNK2, SNK5).

The logistic regression has an exact DuckDB statement (its Newton steps written out), and
so have its predictions, curve, report and cross-validation.  The trees have none: their
queries return the operators' rows, and the tests hold the fits against brute force.
Beside these stand queries that return what holds for any fit, with statements."""

from __future__ import annotations

import functools
import threading
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import churn, metrics, models
from tillroll.plans.catalog import register
from tillroll.plans.q_churn import REPORT_BODY, REPORT_SQL, ROC_BODY, ROC_SQL, churn_oracle, split_features
from tillroll.plans.q_segmentation import segmentation
from tillroll.plans.sql_logistic import logistic_ctes
from tillroll.session import durable_checkpoint, scratch_path
from tillroll.sources.tables import materialized


def model_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features → exact split (is_test, fold) → assembled vector + label."""
    return churn.feature_matrix(split_features(spark, sf_dir))


_FIT_LOCK = threading.Lock()


def fitted(spark: SparkSession, sf_dir: str, name: str) -> models.Fits:
    """All fits of a model, made once for the state of the source: its tables are written."""
    once = functools.cache(lambda: models.fit(name, model_matrix(spark, sf_dir)))
    slug = name.lower().replace(" ", "_").replace("-", "_")

    def part(which: str) -> DataFrame:
        return materialized(spark, f"{slug}_{which}", sf_dir, lambda: getattr(once(), which))

    with _FIT_LOCK:
        return models.Fits(name, part("table"), part("scores"), None if name == models.FOREST else part("all_scores"))


def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, fit, id, label, score) of the three models."""
    return reduce(DataFrame.unionByName, [
        fitted(spark, sf_dir, n).scores.select(F.lit(n).alias("model"), "fit", "id", "label", "score")
        for n in models.MODEL_NAMES])


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, "model_leaderboard", sf_dir, lambda: models.leaderboard(all_scores(spark, sf_dir)))


def best_test_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT5: of the model with the greatest test AUC, named by a scalar subquery."""
    best = board(spark, sf_dir).agg(F.max(F.when(F.col("is_best") == 1, F.col("model")))).scalar()
    return models.test_predictions(all_scores(spark, sf_dir).where(F.col("model") == best))


def test_predictions(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return models.test_predictions(fitted(spark, sf_dir, name).scores)


def boosted_test_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_predictions(spark, sf_dir, models.BOOSTED)


def _in_unit(c: str) -> F.Column:
    return F.col(c).between(0, 1)


# Logistic regression, with exact statements -----------------------------------

_LOGISTIC = logistic_ctes()
# Scores as both engines round them: sums of doubles differ in their last digits.
_LTEST = _LOGISTIC + """,
ltest AS (SELECT label, round(score, 9) AS score, id, CAST(score > 0.5 AS INTEGER) AS prediction
          FROM lscored WHERE fit = 0)"""


def _rounded_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fit, id, label, score) with scores of nine digits."""
    return fitted(spark, sf_dir, models.LOGISTIC).scores.withColumn("score", F.round("score", 9))


@register("ml6_logistic_coefficients", churn_oracle(extra=_LOGISTIC, body="""
SELECT fit, """ + "CASE j " + " ".join(f"WHEN {i + 2} THEN '{c}'" for i, c in enumerate(churn.FEATURE_COLUMNS))
                                              + " END AS feature, round(w[j], 6) AS coefficient FROM lw, range(1, 12) t(j)"))
def q_ml6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML5 + ML6: coefficients of the full fit and of the five folds' (null: the intercept)."""
    return fitted(spark, sf_dir, models.LOGISTIC).table.select("fit", "feature", F.round("coefficient", 6).alias("coefficient"))


@register("ml9_test_predictions_logistic", churn_oracle(extra=_LTEST, body="""
SELECT id, label, prediction, round(score, 6) AS score FROM ltest"""))
def q_ml9_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.test_predictions(_rounded_logistic(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("ml11_logistic_cross_validation", churn_oracle(extra=_LOGISTIC + """,
rk AS (SELECT fit, label, round(score, 9) AS score, row_number() OVER (PARTITION BY fit ORDER BY round(score, 9), id) AS rn
       FROM lscored),
ties AS (SELECT fit, score, MIN(rn) + MAX(rn) AS tm, SUM(label) AS pos, COUNT(*) AS cnt FROM rk GROUP BY fit, score)""", body="""
SELECT fit, round(CAST(SUM(pos * tm) - SUM(pos) * (SUM(pos) + 1) AS DOUBLE)
         / CAST(2 * SUM(pos) * (SUM(cnt) - SUM(pos)) AS DOUBLE), 9) AS auc FROM ties GROUP BY fit"""))
def q_ml11_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML10 + ML11: test AUC (fit 0) and the AUC of each fold outside its fit."""
    scores = _rounded_logistic(spark, sf_dir).withColumn("model", F.lit(models.LOGISTIC))
    return models.fit_aucs(scores).select("fit", F.round("auc", 9).alias("auc"))


@register("ml13_classification_report_logistic", churn_oracle(
    extra=_LTEST + "," + REPORT_SQL.replace("FROM test", "FROM ltest"), body=REPORT_BODY))
def q_ml13_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_report(test_predictions(spark, sf_dir, models.LOGISTIC))


@register("ml14_confusion_matrix_logistic", churn_oracle(extra=_LTEST, body="""
SELECT k AS actual, COUNT(*) FILTER (WHERE prediction = 0) AS predicted_0,
       COUNT(*) FILTER (WHERE prediction = 1) AS predicted_1
FROM (VALUES (0), (1)) c(k) LEFT JOIN ltest ON label = k GROUP BY k"""))
def q_ml14_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(test_predictions(spark, sf_dir, models.LOGISTIC))


@register("ml15_roc_curve_logistic", churn_oracle(
    extra=_LTEST + "," + ROC_SQL.replace("FROM test", "FROM ltest"), body=f"""
SELECT round(threshold, 6) AS threshold, fps, tps, fpr, tpr FROM ({ROC_BODY})"""))
def q_ml15_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML15: every point of the curve."""
    scores = _rounded_logistic(spark, sf_dir).where("fit = 0")
    return metrics.roc_curve(scores, "label", "score").withColumn("threshold", F.round("threshold", 6))


# All three models: the operators' rows ------------------------------------------


@register("ml12_leaderboard_rows")
def q_ml12_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML12 + SRT5: model, test AUC, mean and deviation of the five folds' AUCs, the best."""
    return board(spark, sf_dir)


@register("ml11_fold_aucs")
def q_ml11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML11: model, fit and AUC outside it (fit 0: on the test rows)."""
    return models.fit_aucs(all_scores(spark, sf_dir))


@register("ml7_forest_nodes")
def q_ml7_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML7: the fitted forest as a table of nodes."""
    return fitted(spark, sf_dir, models.FOREST).table


@register("ml8_boosted_nodes")
def q_ml8_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML8: the fitted boosted trees as a table of nodes."""
    return fitted(spark, sf_dir, models.BOOSTED).table


@register("ml9_test_predictions_all_models")
def q_ml9_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML9: probability and class of every test row by each model."""
    parts = [test_predictions(spark, sf_dir, n).withColumn("model", F.lit(n)) for n in models.MODEL_NAMES]
    return reduce(DataFrame.unionByName, parts)


@register("ml13_report_of_best")
def q_ml13_best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML13 of the model with the greatest test AUC, all rows of the report."""
    return metrics.classification_report(best_test_predictions(spark, sf_dir))


@register("ml14_matrix_of_best")
def q_ml14_best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(best_test_predictions(spark, sf_dir))


@register("ml15_roc_points_all_models")
def q_ml15_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML15: every point of the three curves."""
    parts = [metrics.roc_curve(test_predictions(spark, sf_dir, n), "label", "score").withColumn("model", F.lit(n))
             for n in models.MODEL_NAMES]
    return reduce(DataFrame.unionByName, parts)


@register("ml16_top_features")
def q_ml16_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML16 + SRT4: the five greatest importances of the boosted trees (T22)."""
    return models.feature_importances(fitted(spark, sf_dir, models.BOOSTED).table, top=5)


def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML17: every customer with the boosted trees' probability and its band (T22)."""
    return models.score_customers(fitted(spark, sf_dir, models.BOOSTED).table, model_matrix(spark, sf_dir))


@register("ml17_churn_probabilities_boosted")
def q_ml17_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML17 / SNK2: the export's columns with fitted probabilities."""
    return boosted_scores(spark, sf_dir).select(*churn.CHURN_EXPORT_COLUMNS)


@register("ml18_risk_distribution_boosted")
def q_ml18_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML18: customers and share of each risk band, by the boosted trees."""
    return metrics.risk_distribution(boosted_scores(spark, sf_dir))


def boosted_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.join_segments(boosted_scores(spark, sf_dir), segmentation(spark, sf_dir)).select(
        "CustomerID", "ChurnProbability", "ChurnRisk", "CustomerTier", "CLV")


@register("ml19_priority_retention_boosted")
def q_ml19_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML19: the retention list by the boosted trees."""
    return churn.priority_retention(boosted_merged(spark, sf_dir))


# What holds for any fit, with statements -----------------------------------------


@register("ml12_model_leaderboard", """
SELECT model, 1 AS aucs_in_range, 1 AS one_best FROM (
  VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient-Boosted Trees')) m(model)""")
def q_ml12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML5–ML12: three models, test AUC, 5-fold CV AUC, best model."""
    rows = board(spark, sf_dir)
    ok = _in_unit("test_auc") & _in_unit("cv_mean") & (F.col("cv_std") >= 0)
    best = rows.agg((F.sum("is_best") == 1).cast("int")).scalar()
    return rows.select("model", ok.cast("int").alias("aucs_in_range"), best.alias("one_best"))


@register("ml16_feature_importance", """
SELECT 5 AS n_top, 1 AS known_features, 1 AS descending, 1 AS all_sum_to_one""")
def q_ml16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML16 + SRT4: the five greatest importances, checked as a whole."""
    nodes = fitted(spark, sf_dir, models.BOOSTED).table
    top = models.feature_importances(nodes, top=5).agg(
        F.count("*").cast("int").alias("n_top"),
        F.bool_and(F.col("Feature").isin(churn.FEATURE_COLUMNS)).cast("int").alias("known_features"),
        F.collect_list("Importance").alias("_i"))
    total = models.feature_importances(nodes, top=None).agg(F.sum("Importance")).scalar()
    return top.select("n_top", "known_features",
                      (F.col("_i") == F.sort_array("_i", asc=False)).cast("int").alias("descending"),
                      (F.abs(total - 1) < 1e-9).cast("int").alias("all_sum_to_one"))


@register("ml17_churn_scores_boosted", churn_oracle("""
SELECT CustomerID, Recency, Frequency, TotalSpend, Churned, 1 AS probability_in_range,
       1 AS band_agrees FROM cf"""))
def q_ml17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML17 / SNK2: every customer scored by the boosted trees (T22)."""
    p = F.col("ChurnProbability")
    band = F.when(p <= 0, None).when(p <= 0.3, "Low").when(p <= 0.6, "Medium").otherwise("High")
    return boosted_scores(spark, sf_dir).select(
        "CustomerID", "Recency", "Frequency", "TotalSpend", "Churned",
        _in_unit("ChurnProbability").cast("int").alias("probability_in_range"),
        F.col("ChurnRisk").eqNullSafe(band).cast("int").alias("band_agrees"))


@register("snk5_model_roundtrip", churn_oracle("""
SELECT COUNT(*) AS customers, COUNT(*) AS same_as_fitted FROM cf"""))
def q_snk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: export the model's table, load it back, score every customer with it and count
    those whose probability is the number that the fit itself arrived at."""
    fits = fitted(spark, sf_dir, models.BOOSTED)
    path = models.save_model(fits.table, scratch_path(spark, "models", uuid.uuid4().hex, "churn_boosted"))
    loaded = models.score_boosted(models.load_model(spark, path), model_matrix(spark, sf_dir), "p_loaded").select(
        F.col("CustomerID").cast("long").alias("id"), "p_loaded")
    return fits.all_scores.join(loaded, "id").agg(
        F.count("*").alias("customers"), F.count(F.when(F.col("score") == F.col("p_loaded"), 1)).alias("same_as_fitted"))


@register("ml9_test_predictions_boosted", churn_oracle("""
SELECT id, label, 1 AS prediction_agrees FROM test"""))
def q_ml9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML9: test rows with their label; the predicted class is that of P > 0.5."""
    agrees = F.col("prediction") == (F.col("score") > 0.5).cast("int")
    return boosted_test_predictions(spark, sf_dir).select(
        "id", "label", agrees.cast("int").alias("prediction_agrees"))


@register("ml10_test_auc_boosted", churn_oracle("""
SELECT CAST(COUNT(*) FILTER (WHERE label = 1) AS BIGINT) AS n_pos,
       CAST(COUNT(*) FILTER (WHERE label = 0) AS BIGINT) AS n_neg, 1 AS above_chance FROM test"""))
def q_ml10_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.auc(boosted_test_predictions(spark, sf_dir), "label", "score", "id")
    return out.select("n_pos", "n_neg", (F.col("auc").between(0.5, 1)).cast("int").alias("above_chance"))


_SUPPORT = """
SELECT class_name, CAST(COUNT(label) AS BIGINT) AS support, 1 AS in_range FROM (
  VALUES (0, 'Active'), (1, 'Churned')) c(k, class_name) LEFT JOIN test ON label = k GROUP BY class_name"""


def _report_checks(pred: DataFrame) -> DataFrame:
    report = metrics.classification_report(pred)
    ok = F.lit(True)
    for c in ("precision", "recall", "f1_score"):
        ok = ok & F.coalesce(_in_unit(c), F.lit(True))
    return report.filter(F.col("class_name").isin(metrics.CLASS_NAMES)).select(
        "class_name", F.col("support").cast("bigint").alias("support"), ok.cast("int").alias("in_range"))


def _matrix_checks(pred: DataFrame) -> DataFrame:
    """Support per class from the cells of the confusion matrix."""
    cells = metrics.confusion_matrix(pred)
    return cells.select("actual", (F.col("predicted_0") + F.col("predicted_1")).alias("support"))


_MATRIX = """
SELECT k AS actual, COUNT(label) AS support FROM (VALUES (0), (1)) c(k) LEFT JOIN test ON label = k
GROUP BY k"""


def _curve_checks(pred: DataFrame) -> DataFrame:
    """One row: the curve of ROC points begins at the origin, ends with every
    test row counted, and no point falls behind one of a higher threshold."""
    curve = metrics.roc_curve(pred, "label", "score")
    seen = curve.withColumn("_n", F.col("fps") + F.col("tps"))
    twin = seen.groupBy("_n").agg(F.countDistinct("fps").alias("_k"))
    rising = twin.agg((F.max("_k") == 1).cast("int")).scalar()
    return seen.agg((F.min("_n") == 0).cast("int").alias("starts_at_origin"), F.max("fps").alias("n_neg"),
                    F.max("tps").alias("n_pos"),
                    (F.max("_n") == F.max("fps") + F.max("tps")).cast("int").alias("ends_at_all"),
                    F.bool_and(F.col("fpr").between(0, 1) & F.col("tpr").between(0, 1)).cast("int")
                    .alias("rates_in_range")).withColumn("one_point_a_count", rising)


_CURVE = """
SELECT 1 AS starts_at_origin, CAST(COUNT(*) FILTER (WHERE label = 0) AS BIGINT) AS n_neg,
       CAST(COUNT(*) FILTER (WHERE label = 1) AS BIGINT) AS n_pos, 1 AS ends_at_all,
       1 AS rates_in_range, 1 AS one_point_a_count FROM test"""


@register("ml13_classification_report_boosted", churn_oracle(_SUPPORT))
def q_ml13_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_checks(boosted_test_predictions(spark, sf_dir))


@register("ml14_confusion_matrix_boosted", churn_oracle(_MATRIX))
def q_ml14_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix_checks(boosted_test_predictions(spark, sf_dir))


@register("ml15_roc_curve_boosted", churn_oracle(_CURVE))
def q_ml15_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve_checks(boosted_test_predictions(spark, sf_dir))


@register("ml13_classification_report_best", churn_oracle(_SUPPORT))
def q_ml13_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML13 of the model with the greatest test AUC."""
    return _report_checks(best_test_predictions(spark, sf_dir))


@register("ml14_confusion_matrix_best", churn_oracle(_MATRIX))
def q_ml14_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix_checks(best_test_predictions(spark, sf_dir))


@register("ml15_roc_curves_all_models", churn_oracle(f"""
SELECT model, c.* FROM (VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient-Boosted Trees'))
  m(model), ({_CURVE}) c"""))
def q_ml15_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML15: the ROC curve of each of the three models."""
    curves = [_curve_checks(test_predictions(spark, sf_dir, n)).withColumn("model", F.lit(n))
              for n in models.MODEL_NAMES]
    return reduce(DataFrame.unionByName, curves)


@register("ml18_risk_distribution_fitted", churn_oracle("""
SELECT band AS ChurnRisk, (SELECT COUNT(*) FROM cf) AS customers_in_all, 1 AS share_agrees
FROM (VALUES ('High'), ('Medium'), ('Low')) b(band)"""))
def q_ml18_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML18 on the boosted trees' scores: every band's share is its count over all customers."""
    scored = boosted_scores(spark, sf_dir)
    total = scored.agg(F.count("*")).scalar()
    d = metrics.risk_distribution(scored)
    share = F.abs(F.col("pct") - F.col("customers") * 100.0 / total) < 1e-9
    return d.select("ChurnRisk", total.alias("customers_in_all"), share.cast("int").alias("share_agrees"))


@register("ml19_priority_retention_fitted", churn_oracle("""
SELECT COUNT(*) AS top_tier_customers, 1 AS listed_are_top_tier_and_high, 1 AS unlisted_are_not
FROM seg_full WHERE CustomerTier IN ('VVIC', 'VIC')""", with_seg=True))
def q_ml19_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML19 + AGG16 on the boosted trees' scores: the retention list is exactly the customers
    of the two top tiers in the High band, and its CLV is theirs."""
    merged = durable_checkpoint(boosted_merged(spark, sf_dir))
    listed = churn.priority_retention(merged).select("CustomerID", F.lit(1).alias("_in"))
    top = merged.filter(F.col("CustomerTier").isin("VVIC", "VIC")).join(listed, "CustomerID", "full")
    high = F.col("ChurnProbability") > 0.6
    value = churn.clv_at_risk(churn.priority_retention(merged)).select("customers_at_risk").scalar()
    return top.agg(
        F.count("ChurnProbability").alias("top_tier_customers"),
        (F.bool_and(F.when(F.col("_in") == 1, F.coalesce(high, F.lit(False))).otherwise(F.lit(True)))
         & (F.count("_in") == value)).cast("int").alias("listed_are_top_tier_and_high"),
        F.bool_and(F.when(F.col("_in").isNull(), ~high).otherwise(F.lit(True))).cast("int")
        .alias("unlisted_are_not"))

"""Classification metrics as distributed aggregates (ML10, ML13–ML15, ML18).

No metric collects the scores: AUC is the Mann–Whitney statistic with
mid-ranks from one global ranking; the ROC curve is a global running sum over
the distinct scores; the confusion matrix and the report are conditional
counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.expressions import RISK_LABELS
from tillroll.operators.ranking import RANK, global_cumsum, global_rank
from tillroll.operators.reports import distribution

# --- fixed values that must equal the reference's ---------------------------
CLASS_NAMES = ["Active", "Churned"]
# -----------------------------------------------------------------------------


def auc(scored: DataFrame, label: str = "label", score: str = "score",
        key: str = "id", group: str | None = None) -> DataFrame:
    """ML10: ROC AUC with mid-ranks for tied scores (= ``roc_auc_score``).

    ``AUC = (Σ_pos 2·midrank − n1(n1+1)) / (2·n1·n0)``; the doubled mid-rank
    of a tie group is ``min rank + max rank``, so everything before the one
    division is exact integer arithmetic.  ``group`` computes one AUC per
    group value (e.g. per model)."""
    gcols = [group] if group else []
    ranked = global_rank(scored.select(*gcols, label, score, key), [*gcols, score, key])
    if group:
        base = ranked.groupBy(group).agg((F.min(RANK) - 1).alias("_base"))
        ranked = ranked.join(base, group).withColumn(
            RANK, F.col(RANK) - F.col("_base"))
    ties = ranked.groupBy(*gcols, score).agg(
        (F.min(RANK) + F.max(RANK)).alias("_twice_mid"),
        F.sum(F.col(label).cast("bigint")).alias("_pos"),
        F.count(F.lit(1)).alias("_cnt"))
    tot = ties.groupBy(*gcols).agg(
        F.sum(F.col("_pos") * F.col("_twice_mid")).alias("_s"),
        F.sum("_pos").alias("n_pos"), (F.sum("_cnt") - F.sum("_pos")).alias("n_neg"))
    num = F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1)
    den = 2 * F.col("n_pos") * F.col("n_neg")
    return tot.select(*gcols, F.try_divide(num.cast("double"), den.cast("double")).alias("auc"),
                      "n_pos", "n_neg")


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ML15: one ROC point per distinct score threshold (descending), plus
    the (0, 0) point at threshold +∞; collinear points are kept."""
    hist = scored.groupBy(score).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"),
        F.sum((1 - F.col(label).cast("bigint"))).alias("_neg"))
    cum = global_cumsum(hist, [F.col(score).desc()], {"tps": "_pos", "fps": "_neg"})
    totals = hist.agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    tot = totals.select(F.struct("_P", "_N")).scalar()
    pts = cum.select(
        F.col(score).cast("double").alias("threshold"), "fps", "tps",
        F.try_divide(F.col("fps").cast("double"), tot["_N"].cast("double")).alias("fpr"),
        F.try_divide(F.col("tps").cast("double"), tot["_P"].cast("double")).alias("tpr"))
    origin = totals.select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint")
                           .alias("fps"), F.lit(0).cast("bigint").alias("tps"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def confusion_matrix(pred: DataFrame, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """ML14: 2×2 counts, rows = actual class, columns = predicted class;
    a class absent from the data still gets its zero row (T24)."""
    counts = pred.groupBy(F.col(label).cast("int").alias("actual")).agg(
        F.count(F.when(F.col(prediction).cast("int") == 0, 1)).alias("predicted_0"),
        F.count(F.when(F.col(prediction).cast("int") == 1, 1)).alias("predicted_1"))
    domain = pred.sparkSession.range(2).select(F.col("id").cast("int").alias("actual"))
    return domain.join(counts, "actual", "left").select(
        "actual", F.coalesce("predicted_0", F.lit(0)).alias("predicted_0"),
        F.coalesce("predicted_1", F.lit(0)).alias("predicted_1"))


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0 for 0/0 (sklearn's zero_division default)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(pred: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """ML13: precision, recall, F1 and support per class, accuracy, macro and
    weighted averages — from one conditional count."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = pred.agg(*[F.count(F.when((y == a) & (p == b), 1)).alias(f"c{a}{b}")
                   for a in (0, 1) for b in (0, 1)])
    per_class = []
    for k in (0, 1):  # class k: tp = c_kk, fp = c_ok, fn = c_ko (o = the other class)
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        per_class += [_div0(tp, tp + fp).alias(f"p{k}"), _div0(tp, tp + fn).alias(f"r{k}"),
                      (tp + fn).alias(f"s{k}")]
    acc = _div0(F.col("c00") + F.col("c11"),
                F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11"))
    wide = c.select(*per_class, acc.alias("_acc"))
    f1 = {k: _div0(2 * F.col(f"p{k}") * F.col(f"r{k}"), F.col(f"p{k}") + F.col(f"r{k}"))
          for k in (0, 1)}
    wide = wide.withColumn("f0", f1[0]).withColumn("f1", f1[1])
    n = F.col("s0") + F.col("s1")
    out = [
        F.struct(F.lit(0).alias("row_order"), F.lit(CLASS_NAMES[0]).alias("class_name"),
                 F.col("p0").alias("precision"), F.col("r0").alias("recall"),
                 F.col("f0").alias("f1_score"), F.col("s0").cast("bigint").alias("support")),
        F.struct(F.lit(1).alias("row_order"), F.lit(CLASS_NAMES[1]).alias("class_name"),
                 F.col("p1").alias("precision"), F.col("r1").alias("recall"),
                 F.col("f1").alias("f1_score"), F.col("s1").cast("bigint").alias("support")),
        F.struct(F.lit(2).alias("row_order"), F.lit("accuracy").alias("class_name"),
                 F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"),
                 F.col("_acc").alias("f1_score"), n.cast("bigint").alias("support")),
        F.struct(F.lit(3).alias("row_order"), F.lit("macro avg").alias("class_name"),
                 ((F.col("p0") + F.col("p1")) / 2).alias("precision"),
                 ((F.col("r0") + F.col("r1")) / 2).alias("recall"),
                 ((F.col("f0") + F.col("f1")) / 2).alias("f1_score"),
                 n.cast("bigint").alias("support")),
        F.struct(F.lit(4).alias("row_order"), F.lit("weighted avg").alias("class_name"),
                 _div0(F.col("p0") * F.col("s0") + F.col("p1") * F.col("s1"), n).alias("precision"),
                 _div0(F.col("r0") * F.col("s0") + F.col("r1") * F.col("s1"), n).alias("recall"),
                 _div0(F.col("f0") * F.col("s0") + F.col("f1") * F.col("s1"), n).alias("f1_score"),
                 n.cast("bigint").alias("support")),
    ]
    return wide.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def risk_distribution(scored: DataFrame, risk: str = "ChurnRisk") -> DataFrame:
    """ML18: customers per risk band (High, Medium, Low) and share of all
    customers (the NULL band counts in the total, as in the reference)."""
    domain = scored.sparkSession.createDataFrame(
        [(b, i) for i, b in enumerate(reversed(RISK_LABELS))], f"{risk} string, band_order int")
    return distribution(scored, risk, domain)

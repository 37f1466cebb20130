"""Churn models (ML5–ML9, ML11, ML12, ML16, ML17, SNK5): the fits of one model for the
whole training set and for every cross-validation fold, in the same jobs.

Fit 0 trains on all training rows, fit f + 1 on those outside fold f.  Every customer is
outside exactly one fit that is to be judged by it: a test row outside fit 0, a training
row outside its own fold's fit.  So the scores of a model are one row a customer, and
test AUC and cross-validation AUCs come from one grouped ranking.

* logistic regression, C = 1, on features standardised once over the training rows (ML6);
* random forest, 100 full trees of Poisson draws, √p features a split (ML7);
* boosted trees, second order, 100 rounds, depth 6, step 0.3, leaf penalty 1 (ML8).

Trees see features as at most 256 bins between quantiles of the training rows.  A fit
depends on the rows alone, not on how they are dealt.  A fitted model is a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.expressions import risk_band
from tillroll.operators import boosting, forest, logistic
from tillroll.operators.churn import FEATURE_COLUMNS
from tillroll.operators.metrics import auc
from tillroll.session import durable_checkpoint

# --- fixed values that must equal the reference's ---------------------------
LOGISTIC, FOREST, BOOSTED = "Logistic Regression", "Random Forest", "Gradient-Boosted Trees"
MODEL_NAMES = [LOGISTIC, FOREST, BOOSTED]
SEED = 42
TREES, FOLDS = 100, 5
# -----------------------------------------------------------------------------

# Partitions of a training matrix: a parameter of a fit, whatever the row count.
# Set it to a few times the cores of the cluster for large tables.
TRAIN_PARTITIONS = 8
#: Rank error of a bin's edge, as a share of the rows: one in so many.
EDGE_ACCURACY = 100_000


@dataclass
class Fits:
    """``table``: the model of fit 0; ``scores``: fit, id, label, score of the rows outside
    each fit; ``all_scores``: id, score by fit 0 of every row, where the model gives it."""
    name: str
    table: DataFrame
    scores: DataFrame
    all_scores: DataFrame | None = None


def outside_fit() -> Column:
    """The fit that judges itself by this row."""
    return F.when(F.col("is_test") == 1, 0).otherwise(F.col("fold") + 1).cast("int")


def trains(fit: int) -> Column:
    train = F.col("is_test") == 0
    return train if fit == 0 else train & (F.col("fold") != fit - 1)


def training_flags(folds: int) -> Column:
    """A byte a fit: 1 where the row trains it."""
    return F.concat(*[F.when(trains(f), F.lit(b"\x01")).otherwise(F.lit(b"\x00")) for f in range(folds + 1)])


def bin_edges(train: DataFrame, columns: list[str], bins: int = forest.BINS) -> list[list[float]]:
    """Upper edges of the bins of each column: quantiles of the training rows, one edge for
    equal ones.  ``len(columns) * bins`` numbers at most."""
    shares = [i / bins for i in range(1, bins)]
    row = train.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, EDGE_ACCURACY).alias(f"e{i}")
                      for i, c in enumerate(columns)]).first()
    return [sorted(set(row[f"e{i}"] or [])) for i in range(len(columns))]


def with_bins(rows: DataFrame, columns: list[str], edges: list[list[float]], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``bins``, a byte a feature: how many edges lie below its value."""
    values = F.array(*[F.col(c).cast("double") for c in columns]).alias("_v")
    src = rows.select(*keep, values)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", bins binary"

    def run(batches):
        for b in batches:
            v = b.column(len(keep)).flatten().to_numpy().reshape(b.num_rows, len(columns))
            out = np.empty(v.shape, np.uint8)
            for i, e in enumerate(edges):
                out[:, i] = np.searchsorted(np.array(e), v[:, i], side="left")
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array([x.tobytes() for x in out], pa.binary())],
                                             names=[*keep, "bins"])

    return src.mapInArrow(run, schema)


def _keyed(matrix: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return matrix.select(F.col(key).cast("long").alias("id"), F.col("label").cast("int").alias("label"),
                         F.col("is_test").cast("int").alias("is_test"), F.col("fold").cast("int").alias("fold"),
                         *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def fit_logistic(matrix: DataFrame, key: str = "CustomerID", columns: list[str] = FEATURE_COLUMNS,
                 folds: int = FOLDS, steps: int = logistic.STEPS) -> Fits:
    """ML5 + ML6.  The table: fit, feature (null: the intercept), coefficient, mean, deviation."""
    rows, width = _keyed(matrix, key, columns), len(columns)
    scale = logistic.standardisation(rows.where(trains(0)), columns)
    x = durable_checkpoint(rows.select("id", "label", "is_test", "fold", logistic.standardised(columns, scale).alias("x")))
    w = logistic.fit_logistic(x.select("label", "x", training_flags(folds).alias("train")), folds + 1, width, steps)
    spark = matrix.sparkSession
    table = spark.createDataFrame(
        [(f, None if j == 0 else columns[j - 1], float(w[f][j]), *([None, None] if j == 0 else scale[j - 1]))
         for f in range(folds + 1) for j in range(width + 1)],
        "fit int, feature string, coefficient double, mean double, deviation double")
    score = logistic.probability(F.col("x"), F.col("w"), width).alias("score")
    by_fit = logistic.coefficient_rows(spark, w)
    scores = x.withColumn("fit", outside_fit()).join(by_fit, "fit").select("fit", "id", "label", score)
    every = x.withColumn("fit", F.lit(0)).join(by_fit, "fit").select("id", score)
    return Fits(LOGISTIC, table, scores, every)


def _named(nodes: DataFrame, columns: list[str], edges: list[list[float]], cut: str) -> tuple[Column, Column, Column]:
    """(whether a node splits, its feature's name, the greatest value that goes left)."""
    inner = F.col("feature") >= 0
    edge = F.array(*[F.array(*[F.lit(float(x)) for x in e]).cast("array<double>") for e in edges])
    at = F.greatest(F.col("feature"), F.lit(0)) + 1
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), at)
    return inner, F.when(inner, name), F.when(inner, F.try_element_at(F.element_at(edge, at), F.col(cut) + 1))


def fit_forest(matrix: DataFrame, key: str = "CustomerID", columns: list[str] = FEATURE_COLUMNS,
               folds: int = FOLDS, trees: int = TREES, seed: int = SEED,
               local_rows: int = forest.LOCAL_ROWS) -> Fits:
    """ML7.  The table: tree, node, feature, edge, left, right, weight, positive, value."""
    rows = _keyed(matrix, key, columns)
    edges = bin_edges(rows.where(trains(0)), columns)
    binned = durable_checkpoint(with_bins(rows, columns, edges, ["id", "label", "is_test", "fold"]))
    own = F.when(F.col("is_test") == 1, F.array(F.lit(0))).otherwise(F.array(*[F.lit(f) for f in range(folds + 1)]))
    each = binned.withColumn("fit", F.explode(own)).withColumn("is_train", F.col("fit") != outside_fit())
    nodes, leaves = forest.grow_forests(each.select("fit", "id", "label", "bins", "is_train"), trees, len(columns),
                                        max(1, int(len(columns) ** 0.5)), seed, local_rows, node_fits=[0])
    scores = forest.forest_probability(leaves, trees).join(binned.select("id", "label"), "id")
    inner, feature, edge = _named(nodes, columns, edges, "bin")
    table = nodes.where("fit = 0").select(
        "tree", "node", feature.alias("feature"), edge.alias("edge"), F.when(inner, F.col("left")).alias("left"),
        F.when(inner, F.col("right")).alias("right"), "weight", "positive",
        (F.col("p").cast("double") / float(forest.UNIT)).alias("value"))
    return Fits(FOREST, table, scores.select("fit", "id", "label", "score"))


def fit_boosted(matrix: DataFrame, key: str = "CustomerID", columns: list[str] = FEATURE_COLUMNS,
                folds: int = FOLDS, partitions: int = TRAIN_PARTITIONS, rounds: int = 100,
                local_rows: int = boosting.LOCAL_ROWS) -> Fits:
    """ML8.  The table: tree, node, feature, edge, left, right, value, gain, cover."""
    rows = _keyed(matrix, key, columns)
    edges = bin_edges(rows.where(trains(0)), columns)
    binned = with_bins(rows, columns, edges, ["id", "label", "is_test", "fold"])
    nodes, every = boosting.boost(binned.select("id", "label", "bins", training_flags(folds).alias("train")), folds + 1, len(columns),
                                  partitions, boosting.BoostParams(rounds=rounds), local_rows)
    own = _keyed(matrix, key, []).select("id", outside_fit().alias("fit"))
    scores = every.join(own, ["id", "fit"]).select("fit", "id", "label", "score")
    inner, feature, edge = _named(nodes, columns, edges, "cut")
    child = F.when(inner, 2 * F.col("node") + 1)
    table = nodes.where("fit = 0").select(
        "tree", "node", feature.alias("feature"), edge.alias("edge"), child.alias("left"), (child + 1).alias("right"),
        F.when(~inner, F.col("value")).alias("value"), F.when(inner, F.col("gain")).alias("gain"), "cover")
    return Fits(BOOSTED, table, scores, every.where("fit = 0").select("id", "score"))


FITTERS = {LOGISTIC: fit_logistic, FOREST: fit_forest, BOOSTED: fit_boosted}


def fit(name: str, matrix: DataFrame, **kw) -> Fits:
    """All fits of one of the three models on a matrix with label, is_test and fold."""
    return FITTERS[name](matrix, **kw)


def fit_aucs(scores: DataFrame, by: list[str] = ["model"]) -> DataFrame:
    """``by``, fit, auc: ML10 of every fit on the rows outside it, from one ranking."""
    runs = scores.withColumn("run", F.concat_ws("\x1f", *by, F.col("fit").cast("string")))
    found = auc(runs, "label", "score", "id", group="run")
    parts = F.split("run", "\x1f")
    return found.select(*[parts[i].alias(c) for i, c in enumerate(by)], parts[len(by)].cast("int").alias("fit"), "auc")


def leaderboard(scores: DataFrame) -> DataFrame:
    """ML12 (+ SRT5): model, test_auc, cv_mean, cv_std (population deviation over the folds)
    and is_best, from the scores (model, fit, id, label, score) of the models."""
    board = fit_aucs(scores).groupBy("model").agg(
        F.max(F.when(F.col("fit") == 0, F.col("auc"))).alias("test_auc"),
        F.avg(F.when(F.col("fit") > 0, F.col("auc"))).alias("cv_mean"),
        F.stddev_pop(F.when(F.col("fit") > 0, F.col("auc"))).alias("cv_std"))
    board = durable_checkpoint(board)
    # Ties: the model named last.
    best = board.agg(F.max(F.struct("test_auc", "model"))["model"]).scalar()
    return board.withColumn("is_best", (F.col("model") == best).cast("int"))


def test_predictions(scores: DataFrame) -> DataFrame:
    """ML9: id, label, prediction and score of the test rows; the class is that of P > 0.5."""
    return scores.where("fit = 0").select("id", "label", (F.col("score") > 0.5).cast("int").alias("prediction"), "score")


def feature_importances(nodes: DataFrame, columns: list[str] = FEATURE_COLUMNS, top: int | None = 5) -> DataFrame:
    """ML16 + SRT4: Feature, Importance: mean gain of the splits by a feature, as a share of
    all features' (0: never used), descending, ties by name."""
    spark = nodes.sparkSession
    mean = nodes.where("feature is not null").groupBy(F.col("feature").alias("Feature")).agg(F.avg("gain").alias("_g"))
    every = spark.createDataFrame([(c,) for c in columns], "Feature string").join(mean, "Feature", "left")
    total = mean.agg(F.sum("_g")).scalar()
    ordered = every.select("Feature", F.coalesce(F.try_divide(F.col("_g"), total), F.lit(0.0)).alias("Importance")).orderBy(
        F.desc("Importance"), "Feature")
    return ordered.limit(top) if top else ordered


def score_boosted(nodes: DataFrame, rows: DataFrame, out: str = "ChurnProbability") -> DataFrame:
    """ML9 + ML17 from a model table: ``rows`` and their probability.  The table has at most
    rounds x (2^(depth + 1) - 1) nodes, set by the parameters, and goes to every task."""
    table = nodes.orderBy("tree", "node").toPandas()
    columns = sorted(table["feature"].dropna().unique().tolist())
    place = {c: i for i, c in enumerate(columns)}
    trees = []
    for _, t in table.groupby("tree", sort=True):
        size = int(t["node"].max()) + 1
        feature, edge, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = t["node"].to_numpy()
        feature[at] = [place.get(c, -1) for c in t["feature"]]
        edge[at], value[at] = t["edge"].fillna(0.0), t["value"].fillna(0.0)
        trees.append((feature, edge, value))
    src = rows.withColumn("_v", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
                          if columns else F.array().cast("array<double>"))
    schema = rows.select("*", F.lit(0.0).alias(out)).schema

    def run(batches):
        for b in batches:
            v = b.column(b.num_columns - 1).flatten().to_numpy().reshape(b.num_rows, len(columns))
            margin, each = np.zeros(b.num_rows), np.arange(b.num_rows)
            for feature, edge, value in trees:
                at = np.zeros(b.num_rows, np.int64)
                while (inner := feature[at] >= 0).any():
                    right = v[each, np.maximum(feature[at], 0)] > edge[at]
                    at = np.where(inner, 2 * at + 1 + right, at)
                margin += value[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(boosting.sigmoid(margin))], names=schema.names)

    return src.mapInArrow(run, schema)


def score_forest(nodes: DataFrame, rows: DataFrame, key: str = "CustomerID", out: str = "ChurnProbability") -> DataFrame:
    """``rows`` and their probability from a forest's table, which grows with the training
    rows: a join a level moves every (row, tree) to the next node until all stand on leaves."""
    used = [r[0] for r in nodes.where("feature is not null").select("feature").distinct().collect()]
    values = F.create_map(*[x for c in used for x in (F.lit(c), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))]) \
        if used else F.create_map().cast("map<string,double>")
    trees = nodes.select("tree").distinct()
    count = trees.count()
    at = rows.select(F.col(key).alias("_id"), values.alias("_v"),
                     F.explode(F.sequence(F.lit(0), F.lit(max(count, 1) - 1))).alias("tree"), F.lit(1).cast("long").alias("node"))
    ended = None
    while True:
        met = durable_checkpoint(at.join(nodes, ["tree", "node"]))
        here = met.where("feature is null").select("_id", "value")
        ended = here if ended is None else ended.unionByName(here)
        at = met.where("feature is not null").select(
            "_id", "_v", "tree", F.when(F.col("_v")[F.col("feature")] <= F.col("edge"), F.col("left"))
            .otherwise(F.col("right")).alias("node"))
        if at.isEmpty():
            break
    units = F.round(F.col("value") * float(forest.UNIT)).cast("long")
    mean = ended.groupBy("_id").agg((F.sum(units).cast("double") / float(count * forest.UNIT)).alias(out))
    return rows.join(mean, rows[key] == mean["_id"], "left").drop("_id")


def score_customers(nodes: DataFrame, matrix: DataFrame) -> DataFrame:
    """ML17: P(churn) of every customer (training rows included, as in the reference) by the
    boosted trees, with its risk band."""
    return score_boosted(nodes, matrix).withColumn("ChurnRisk", risk_band("ChurnProbability"))


def save_model(table: DataFrame, path: str) -> str:
    """SNK5: a model is its table."""
    table.write.mode("overwrite").parquet(path)
    return path


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

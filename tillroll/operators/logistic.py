"""L2 logistic regression of all fits by Newton steps (ML5, ML6, ML11).

A step reads every row once for all fits.  Each task adds up, for each fit, what a Newton
step needs: the gradient and the Hessian, 132 sums for ten features; an aggregate adds the
tasks' sums.  The driver solves these small systems.  The number of steps is fixed.  Features are standardised
by the mean and population deviation of all training rows, once, for the folds too.
The penalty is half the squared coefficients (C = 1); the intercept has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Newton steps from zero coefficients.
STEPS = 12


def standardisation(train: DataFrame, columns: list[str]) -> list[tuple[float, float]]:
    """(mean, population deviation) of each column; a constant column is only centred."""
    row = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(columns)
                      for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [(row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i in range(len(columns))]


def standardised(columns: list[str], scale: list[tuple[float, float]]) -> Column:
    """1 and the standardised features, as an array."""
    return F.array(F.lit(1.0), *[(F.col(c).cast("double") - m) / s for c, (m, s) in zip(columns, scale, strict=True)])


def probability(x: Column, w: Column, width: int) -> Column:
    """Of the positive class, from the row's ``x`` and the coefficients ``w``."""
    z = F.lit(0.0)
    for j in range(1, width + 2):
        z = z + F.element_at(w, j) * F.element_at(x, j)
    return 1.0 / (1.0 + F.exp(-z))


def coefficient_rows(spark: SparkSession, w: np.ndarray) -> DataFrame:
    """(fit, w): one row a fit, which goes to every task."""
    return F.broadcast(spark.createDataFrame([(f, r.tolist()) for f, r in enumerate(w)], "fit int, w array<double>"))


def newton_sums(x: np.ndarray, label: np.ndarray, train: np.ndarray, w: np.ndarray) -> np.ndarray:
    """[fit, coefficient, coefficient + 1]: the Hessian and, last, the gradient of each fit,
    without the penalty, over the rows that it trains (``train`` [row, fit])."""
    with np.errstate(over="ignore"):
        p = 1.0 / (1.0 + np.exp(-(x @ w.T)))
    spread, error = (np.where(train, v, 0.0) for v in (p * (1.0 - p), p - label[:, None]))
    return np.stack([np.column_stack([x.T @ (x * spread[:, [k]]), x.T @ error[:, k]]) for k in range(len(w))])


def fit_logistic(rows: DataFrame, fits: int, width: int, steps: int = STEPS) -> np.ndarray:
    """[fit, coefficient], the intercept first.  ``rows`` hold label, x (1 and the standardised
    features) and train (a byte a fit: 1 where the row belongs to it)."""
    n = width + 1
    w = np.zeros((fits, n))
    penalty = np.diag([0.0] + [1.0] * width)
    rows = rows.select("label", "x", "train")

    def sums_at(w: np.ndarray):
        def run(batches):
            total, met = np.zeros((fits, n, n + 1)), np.zeros(fits, bool)
            for b in batches:
                label, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, n)
                train = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, fits).astype(bool)
                total += newton_sums(x, label, train, w)
                met |= train.any(0)
            # A fit without rows has no sums.
            fit, place = np.repeat(np.flatnonzero(met), n * (n + 1)), np.tile(np.arange(n * (n + 1)), met.sum())
            yield pa.RecordBatch.from_arrays([pa.array(fit, pa.int32()), pa.array(place, pa.int32()),
                                              pa.array(total[met].ravel())], names=["fit", "place", "value"])

        return rows.mapInArrow(run, "fit int, place int, value double").groupBy("fit", "place").agg(
            F.sum("value").alias("value"))

    for _ in range(steps):
        found = np.zeros((fits, n * (n + 1)))
        met = set()
        for r in sums_at(w).collect():
            found[r["fit"], r["place"]] = r["value"]
            met.add(r["fit"])
        for k in met:
            s = found[k].reshape(n, n + 1)
            w[k] -= np.linalg.solve(s[:, :n] + penalty, s[:, n] + penalty @ w[k])
    return w

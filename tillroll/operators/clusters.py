"""K-Means customer segments (KM1, a claimed method with no code in the reference) on
log-scaled, standardised R, F, M.

Features are whole multiples of 2^-20, so that sums do not depend on the order of rows.
Centres start at quantiles (high values for F and M go with low ones for R).  A Lloyd step
is one aggregate: counts and exact sums of the rows nearest to each centre, k rows in all;
a centre without rows stays.  The number of steps is stated; an earlier step that moves no
centre ends the loop with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.ranking import exact_quantiles
from tillroll.session import durable_checkpoint

UNIT = 1 << 20
STEPS = 15
_AXES = ["_r", "_f", "_m"]


def _logged(c: str) -> Column:
    x = F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.round(F.log(x + 1.0) * UNIT).cast("long")


def scaled(rfm: DataFrame) -> DataFrame:
    """CustomerID, R, F, M and the three features in units of 2^-20."""
    logged = durable_checkpoint(rfm.select(
        "CustomerID", "Recency", "Frequency", "Monetary",
        *[_logged(c).alias(a) for c, a in zip(("Recency", "Frequency", "Monetary"), _AXES, strict=True)]))
    exact = [F.sum(F.col(a).cast("decimal(19,0)") * F.col(a).cast("decimal(19,0)")).cast("decimal(38,0)").alias(f"{a}2")
             for a in _AXES]
    sums = logged.agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(a) for a in _AXES], *exact).first()
    out, n = [], sums["n"] or 1
    for a in _AXES:
        total, squares = int(sums[a] or 0), int(sums[f"{a}2"] or 0)
        deviation = (float(n * squares - total * total) / (float(n) * float(n))) ** 0.5 or 1.0
        out.append(F.round((F.col(a).cast("double") - total / n) / deviation * UNIT).cast("long").alias(a))
    return logged.select("CustomerID", "Recency", "Frequency", "Monetary", *out)


def starting_centres(points: DataFrame, k: int) -> list[list[float]]:
    """Centre j at the quantiles (2 j + 1) / 2 k, the recency's from the other end."""
    probs = [(2 * j + 1, 2 * k) for j in range(k)]
    names = [f"q{j}" for j in range(k)]
    rows = [exact_quantiles(points, a, "CustomerID", probs, names, 6).first() for a in _AXES]
    by_axis = [[float(r[n] or 0.0) for n in names] for r in rows]
    by_axis[0].reverse()
    return [list(c) for c in zip(*by_axis, strict=True)]


def nearest(centres: list[list[float]]) -> Column:
    """The number of the nearest centre; ties go to the lower."""
    def distance(c: list[float]) -> Column:
        out = None
        for a, x in zip(_AXES, c, strict=True):
            d = F.col(a).cast("double") - F.lit(float(x))
            out = d * d if out is None else out + d * d
        return out

    return F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centres)]))["j"]


def fit_centres(points: DataFrame, k: int, steps: int = STEPS) -> list[list[float]]:
    centres = starting_centres(points, k)
    for _ in range(steps):
        sums = points.groupBy(nearest(centres).alias("j")).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(a) for a in _AXES]).collect()
        moved = [list(c) for c in centres]
        for r in sums:
            moved[r["j"]] = [float(r[a]) / float(r["n"]) for a in _AXES]
        if moved == centres:
            break
        centres = moved
    return centres


def kmeans_segments(rfm: DataFrame, k: int = 4, steps: int = STEPS) -> DataFrame:
    """CustomerID, the RFM values, cluster (0..k−1) and its centre (standard deviations from
    the mean of the logarithms)."""
    points = durable_checkpoint(scaled(rfm))
    centres = fit_centres(points, k, steps)
    array = F.array(*[F.array(*[F.lit(x / UNIT) for x in c]) for c in centres])
    found = points.withColumn("cluster", nearest(centres).cast("int"))
    own = F.element_at(array, F.col("cluster") + 1)
    return found.select("CustomerID", "Recency", "Frequency", "Monetary", "cluster",
                        *[own[i].alias(f"centre_{n}") for i, n in enumerate(("recency", "frequency", "monetary"))])


def cluster_profile(segments: DataFrame) -> DataFrame:
    """Size, mean R, F, M and the centre of each cluster."""
    centre = [F.first(c).alias(c) for c in segments.columns if c.startswith("centre_")]
    return segments.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("Recency").alias("mean_recency"),
        F.avg("Frequency").alias("mean_frequency"), F.avg("Monetary").alias("mean_monetary"), *centre)

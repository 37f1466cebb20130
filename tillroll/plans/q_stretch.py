"""Registered queries for the reference's claimed-only items: streaming KPIs
(STR1) and K-Means (KM1, every step in the oracle)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.clean import clean_transactions
from tillroll.operators.clusters import STEPS, UNIT, cluster_profile, kmeans_segments
from tillroll.operators.rfm import rfm_notebook
from tillroll.plans.catalog import register, ts_text
from tillroll.plans.oracles import CLEAN_CTE, RETAIL_CTE, with_ctes
from tillroll.plans.q_segmentation import RFM_CTE
from tillroll.session import scratch_path
from tillroll.sources.retail import load_retail
from tillroll.sources.tables import materialized
from tillroll.streaming import kpis


@register("str1_streaming_weekly_event_kpis", """
SELECT strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases, COUNT(DISTINCT user_id) AS users
FROM events GROUP BY date_trunc('week', ts), event_type""")
def q_str1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the stream over the event files to completion (availableNow) and
    return the KPI table's current state."""
    run = uuid.uuid4().hex
    out = scratch_path(spark, "streams", run, "out")
    ckpt = scratch_path(spark, "streams", run, "checkpoint")
    events = kpis.event_stream(spark, sf_dir, "events.parquet")
    running = [kpis.run_to_table(kpis.weekly_kpis(events, approx_users=False), out, f"{ckpt}/kpis"),
               kpis.run_users_to_table(kpis.weekly_users(events), out, f"{ckpt}/users")]
    for query in running:
        query.awaitTermination()
    res = kpis.read_latest(spark, out)
    return res.select(ts_text("window_start"), "event_type", "events",
                      F.col("total_value").cast("double").alias("total_value"), "purchases", "users")


def kmeans_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every customer, fitted once per session."""
    return materialized(spark, "kmeans_segments", sf_dir, lambda: kmeans_segments(
        rfm_notebook(clean_transactions(load_retail(spark, sf_dir)))))


def _kmeans_ctes(k: int = 4) -> str:
    """``kc`` (j and the centre) and ``ks`` (every customer with its cluster), each Lloyd step
    written out."""
    axes = {"r": "Recency", "f": "Frequency", "m": "Monetary"}
    logged = ", ".join(f"CAST(round(ln(greatest(CAST({c} AS DOUBLE), 0) + 1) * {UNIT}) AS BIGINT) AS {a}" for a, c in axes.items())
    moments = ", ".join(
        f"CAST(SUM({a}) AS DOUBLE) / COUNT(*) AS mean_{a}, sqrt(CAST(COUNT(*) * SUM(CAST({a} AS HUGEINT) * {a}) "
        f"- CAST(SUM({a}) AS HUGEINT) * SUM({a}) AS DOUBLE) / (CAST(COUNT(*) AS DOUBLE) * COUNT(*))) AS sd_{a}" for a in axes)
    z = ", ".join(f"CAST(round((CAST({a} AS DOUBLE) - mean_{a}) / sd_{a} * {UNIT}) AS BIGINT) AS {a}" for a in axes)
    starts = " UNION ALL ".join(
        f"SELECT {j} AS j, " + ", ".join(
            f"round(quantile_cont({a}, {(2 * (k - 1 - j if a == 'r' else j) + 1) / (2 * k)!r}), 6) AS {a}" for a in axes)
        + " FROM kp" for j in range(k))
    distance = " + ".join(f"(CAST(p.{a} AS DOUBLE) - c.{a}) * (CAST(p.{a} AS DOUBLE) - c.{a})" for a in axes)

    def nearest(s: int) -> str:
        return (f"SELECT p.*, c.j FROM kp p, kc{s} c "
                f"QUALIFY row_number() OVER (PARTITION BY CustomerID ORDER BY {distance}, j) = 1")

    steps = [f"kc{s + 1} AS MATERIALIZED (SELECT c.j, " + ", ".join(f"coalesce(n.{a}, c.{a}) AS {a}" for a in axes)
             + f" FROM kc{s} c LEFT JOIN (SELECT j, " + ", ".join(f"CAST(SUM({a}) AS DOUBLE) / COUNT(*) AS {a}" for a in axes)
             + f" FROM ({nearest(s)}) GROUP BY j) n USING (j))" for s in range(STEPS)]
    return ",\n".join([
        f"kl AS MATERIALIZED (SELECT CustomerID, Recency, Frequency, Monetary, {logged} FROM rfm)",
        f"kp AS MATERIALIZED (SELECT CustomerID, Recency, Frequency, Monetary, {z} FROM kl, (SELECT {moments} FROM kl))",
        f"kc0 AS MATERIALIZED ({starts})", *steps,
        f"ks AS MATERIALIZED (SELECT CustomerID, Recency, Frequency, Monetary, CAST(j AS INTEGER) AS cluster FROM ({nearest(STEPS)}))"])


_CENTRE = ", ".join(f"round({a} / {UNIT}, 6) AS centre_{n}" for a, n in (("r", "recency"), ("f", "frequency"), ("m", "monetary")))


@register("km1_kmeans_segments", with_ctes(RETAIL_CTE, CLEAN_CTE, RFM_CTE, _kmeans_ctes(), body="""
SELECT CustomerID, Recency, Frequency, Monetary, cluster FROM ks"""))
def q_km1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KM1: every customer's cluster."""
    return kmeans_table(spark, sf_dir).select("CustomerID", "Recency", "Frequency", "Monetary", "cluster")


@register("km1_kmeans_profile", with_ctes(RETAIL_CTE, CLEAN_CTE, RFM_CTE, _kmeans_ctes(), body=f"""
SELECT cluster, COUNT(*) AS customers, round(AVG(Recency), 6) AS mean_recency, round(AVG(Frequency), 6) AS mean_frequency,
       round(AVG(Monetary), 4) AS mean_monetary, any_value(centre_recency) AS centre_recency,
       any_value(centre_frequency) AS centre_frequency, any_value(centre_monetary) AS centre_monetary
FROM ks JOIN (SELECT CAST(j AS INTEGER) AS cluster, {_CENTRE} FROM kc{STEPS}) USING (cluster) GROUP BY cluster"""))
def q_km1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KM1: size, means and centre of each cluster."""
    p = cluster_profile(kmeans_table(spark, sf_dir))
    return p.select("cluster", "customers", *[F.round(c, 4 if c == "mean_monetary" else 6).alias(c)
                                              for c in p.columns if c.startswith(("mean_", "centre_"))])

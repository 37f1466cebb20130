"""Expose the fact table and the derived tables to Spark SQL.

    register_views(spark, "/path/to/tables")
    spark.sql("SELECT CustomerTier, COUNT(*) FROM customer_segmentation GROUP BY 1")

Views over the once-per-session derived tables: ``online_retail``,
``customer_segmentation``, ``customer_rfm_scored`` (SQL query 1's result),
``churn_features``, ``weekly_sales`` (per country plus 'ALL'),
``revenue_forecast``.  ``sf_dir`` is a folder of the TPC-H-style tables, and
the registered queries' parameters apply (report date ``AS_OF``, home
country ``TEST_HOME``); over real invoice lines use the operators or
``plans.jobs`` directly.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tillroll.operators import rfm
from tillroll.plans.catalog import AS_OF
from tillroll.plans.q_churn import features
from tillroll.plans.q_forecast import forecast_by_country
from tillroll.plans.q_segmentation import segmentation
from tillroll.plans.q_timeseries import weekly_by_country
from tillroll.sources.retail import register_retail


def register_views(spark: SparkSession, sf_dir: str, as_of: str | None = AS_OF) -> list[str]:
    """Create the temp views and return their names."""
    register_retail(spark, sf_dir, "online_retail")
    views = {
        "customer_segmentation": segmentation(spark, sf_dir),
        "customer_rfm_scored": rfm.customer_rfm_scored(spark.table("online_retail"), as_of),
        "churn_features": features(spark, sf_dir),
        "weekly_sales": weekly_by_country(spark, sf_dir),
        "revenue_forecast": forecast_by_country(spark, sf_dir),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return ["online_retail", *views]

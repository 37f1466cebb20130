"""tillroll — retail transaction analytics on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver.  Sub-packages:

* ``sources``   – declared schemas, readers, the test-data adapter, sinks
* ``functions`` – column expressions (predicates, date arithmetic, CASE rules)
* ``operators`` – cleaning, profiling, ranking, RFM, sales, churn, metrics,
                  models, time series, forecasting, clustering
* ``plans``     – the SQL feature queries and the end-to-end jobs
* ``streaming`` – Structured Streaming KPIs
"""

from tillroll.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]

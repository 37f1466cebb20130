"""All registered queries and oracles (importing a module registers its queries).

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
fact table derived from the tables in ``sf_dir``.  Output columns are cast at
the edge (counts → bigint, amounts → double, dates → ISO text) so both
engines produce the same schema.
"""

from __future__ import annotations

from tillroll.plans import (  # noqa: F401
    q_churn, q_exports, q_forecast, q_models, q_reports, q_segmentation, q_stretch,
    q_timeseries,
)
from tillroll.plans.catalog import AS_OF, ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "seg1_customer_segmentation"

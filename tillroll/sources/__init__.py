from tillroll.sources.retail import (  # noqa: F401
    load_retail, preview, read_segmentation, read_transactions, register_retail,
    tpch_retail_view,
)
from tillroll.sources.schema import RETAIL_SCHEMA, SEGMENTATION_SCHEMA  # noqa: F401

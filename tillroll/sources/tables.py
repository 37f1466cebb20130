"""Derived tables materialised once per session in the shared scratch folder.

The reference hands results between jobs as files (segmentation → churn);
here each shared intermediate (curated fact table, customer segmentation,
churn features, weekly series) is written once as Parquet and every report
scans it with pushdown instead of recomputing it.  Written tables are
durable: a lost executor never forces a recomputation of the lineage.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.session import folder_version, scratch_path

_TABLES: dict[tuple, str] = {}
_LOCK = threading.Lock()
_BUILDING: dict[tuple, threading.Lock] = {}


def materialized(spark: SparkSession, name: str, source: str,
                 build: Callable[[], DataFrame], **params) -> DataFrame:
    """``build()`` written to the scratch folder on first use in this session;
    later calls read the written table.  A table is reused for the same name,
    source folder, state of its files and ``params`` of the build only."""
    source = source.rstrip("/")
    key = (spark.sparkContext.applicationId, name, source, folder_version(spark, source),
           repr(sorted(params.items())))
    with _LOCK:
        lock = _BUILDING.setdefault(key, threading.Lock())
    with lock:  # concurrent callers wait for one build instead of racing
        if key not in _TABLES:
            digest = hashlib.sha1(repr(key).encode()).hexdigest()[:12]
            path = scratch_path(spark, "tables", name, digest)
            build().write.mode("overwrite").parquet(path)
            _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])

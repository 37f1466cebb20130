"""Sinks (SNK1–SNK4): write a result table to the shared folder.

Writes go through Spark's committer (task output is only published when the
job commits), so a lost executor re-runs its tasks without leaving partial
files.  CSV keeps the reference's header-row format; Parquet is the default
for anything read back by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write ``df`` to ``path`` (``fmt`` = parquet | csv) and return the path."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path

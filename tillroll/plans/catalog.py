"""Query catalogue: ``register`` adds a Spark query and its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Report date of the registered SQL-variant queries (the library default is
# CURRENT_DATE); a literal keeps both engines comparable.
AS_OF = "2001-08-02"
# Home country of the synthetic tables (the library default is the UK).
TEST_HOME = "NATION_0"


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def ts_text(c: str) -> Column:
    """Timestamp as ISO text at the output edge."""
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(c)


def date_text(c: str) -> Column:
    """Date as ISO text at the output edge."""
    return F.date_format(F.to_date(F.col(c)), "yyyy-MM-dd").alias(c)

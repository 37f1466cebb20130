"""Data profiling (PRF1–PRF4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.expressions import is_cancellation
from tillroll.operators.ranking import exact_quantiles


def overview(df: DataFrame) -> DataFrame:
    """PRF1: rows, distinct customers / products / countries, date range.  Each count
    is a grouping of its own over a scan of its column alone; no line is expanded."""
    def distinct(c: str):
        return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1).alias("_one")).agg(F.count(F.lit(1))).scalar()

    one = df.agg(F.count(F.lit(1)).alias("total_transactions"), F.min("invoice_date").alias("first_date"),
                 F.max("invoice_date").alias("last_date"))
    return one.select("total_transactions", distinct("customer_id").alias("unique_customers"),
                      distinct("stock_code").alias("unique_products"), distinct("country").alias("countries"),
                      "first_date", "last_date")


def missing_values(df: DataFrame) -> DataFrame:
    """PRF2: null count and percentage per column, as a long table
    (column_name, missing, missing_pct)."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    long = wide.unpivot("_n", df.columns, "column_name", "missing")
    return long.select("column_name", "missing",
                       (F.col("missing") * 100.0 / F.col("_n")).alias("missing_pct"))


def cleaning_funnel(df: DataFrame) -> DataFrame:
    """PRF3: rows removed and left after each cumulative cleaning step, from
    one conditional aggregate."""
    s1 = F.col("customer_id").isNotNull()
    s2 = s1 & ~is_cancellation("invoice", null_as_text=True)
    s3 = s2 & (F.col("quantity") > 0) & (F.col("price") > 0)
    wide = df.agg(F.count(F.lit(1)).alias("s0"), F.count(F.when(s1, 1)).alias("s1"),
                  F.count(F.when(s2, 1)).alias("s2"), F.count(F.when(s3, 1)).alias("s3"))
    steps = wide.select(F.expr(
        "stack(4, 0, 'loaded', s0, s0, 1, 'known customer', s0, s1, "
        "2, 'not cancelled', s1, s2, 3, 'positive quantity and price', s2, s3) "
        "AS (step, step_name, rows_before, rows_left)"))
    return steps.select("step", "step_name",
                        (F.col("rows_before") - F.col("rows_left")).alias("rows_removed"),
                        "rows_left")


_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe(df: DataFrame, columns: list[str], key: str, digits: int = 2,
             bounded: tuple[str, ...] = ()) -> DataFrame:
    """PRF4: pandas-style ``describe().round(2)`` with *exact* quartiles
    (linear interpolation; ``DataFrame.summary`` would give approximate ones).
    Columns named in ``bounded`` (integers from a small domain) use Spark's
    exact ``percentile``; the others selection by counting, exact at any
    cardinality.  Long table: statistic, then one double column per column."""
    per_col = []
    for c in columns:
        basic = df.agg(F.count(c).cast("double").alias("count"),
                       F.avg(F.col(c).cast("double")).alias("mean"),
                       F.stddev_samp(F.col(c).cast("double")).alias("std"),
                       F.min(c).cast("double").alias("min"),
                       F.max(c).cast("double").alias("max"))
        if c in bounded:
            pct = F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
            quart = df.agg(pct.alias("_q")).select(*[
                F.col("_q")[i].alias(n) for i, n in enumerate(["25%", "50%", "75%"])])
        else:
            quart = exact_quantiles(df, c, key, [(1, 4), (1, 2), (3, 4)],
                                    ["25%", "50%", "75%"], digits=None)
        q = quart.select(F.struct("25%", "50%", "75%")).scalar()
        row = basic.select("*", *[q[n].alias(n) for n in ("25%", "50%", "75%")])
        stacked = row.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("stat_order"), F.lit(s).alias("statistic"),
                     F.round(F.col(f"`{s}`"), digits).alias("value"))
            for i, s in enumerate(_STATS)])).alias("s")).select(
            "s.stat_order", "s.statistic", F.col("s.value").alias(c))
        per_col.append(stacked)
    return reduce(lambda a, b: a.join(b, ["stat_order", "statistic"]), per_col)

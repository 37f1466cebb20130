"""Daily / weekly revenue series and the exact series operators
(AGG5, AGG6, TS1–TS5, TS8, TS9, WIN5, WIN6).

A series is identified by ``series_key``: ``'ALL'`` for the total, or the
value of a grouping column (e.g. country) for many series at once.  All
volume is in the first aggregation (shuffle on series × day); everything
after works on series tables whose length is bounded by the calendar, so
windows partitioned by ``series_key`` are safe.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.expressions import week_ending_sunday

ALL = "ALL"
EXACT = "decimal(38,3)"


def _series_key(by: str | None) -> Column:
    return F.lit(ALL) if by is None else F.col(by).cast("string")


def daily_exact(clean: DataFrame, by: str | None = None, with_total: bool = False) -> DataFrame:
    """Per series and day: exact revenue (decimal ``_rev``), distinct invoices,
    distinct customers.  ``with_total`` adds the ``'ALL'`` series.

    The lines are aggregated once, to (series, day, invoice, customer); sums and
    both distinct counts come from that table, each through one more grouping,
    and the total reads it a second time instead of the lines."""
    base = clean.groupBy(_series_key(by).alias("series_key"), F.to_date("invoice_date").alias("Date"),
                         "invoice", "customer_id").agg(F.sum("amount").cast(EXACT).alias("_rev"))
    if by is not None and with_total:
        base = base.unionAll(base.withColumn("series_key", F.lit(ALL)))
    day, none = ["series_key", "Date"], F.lit(0).cast("bigint")
    invoices = base.groupBy(*day, "invoice").agg(F.sum("_rev").cast(EXACT).alias("_rev")).select(
        *day, "_rev", F.col("invoice").isNotNull().cast("bigint").alias("_i"), none.alias("_c"))
    customers = base.groupBy(*day, "customer_id").agg(F.lit(0).cast(EXACT).alias("_rev")).select(
        *day, "_rev", none.alias("_i"), F.col("customer_id").isNotNull().cast("bigint").alias("_c"))
    return invoices.unionAll(customers).groupBy(*day).agg(
        F.sum("_rev").cast(EXACT).alias("_rev"), F.sum("_i").alias("Transactions"),
        F.sum("_c").alias("UniqueCustomers"))


def daily_sales(clean: DataFrame, by: str | None = None, with_total: bool = False) -> DataFrame:
    """AGG5: Date, Revenue, Transactions, UniqueCustomers per series."""
    return daily_exact(clean, by, with_total).select(
        "series_key", "Date", F.col("_rev").cast("double").alias("Revenue"), "Transactions",
        "UniqueCustomers")


def fill_daily(daily: DataFrame) -> DataFrame:
    """TS1: one row per series and calendar day between the series' first and
    last day, missing days as zeros (``asfreq('D', fill_value=0)``)."""
    value_cols = [c for c in daily.columns if c not in ("series_key", "Date")]
    spine = (daily.groupBy("series_key").agg(F.min("Date").alias("_lo"),
                                             F.max("Date").alias("_hi"))
             .select("series_key", F.explode(F.sequence("_lo", "_hi")).alias("Date")))
    filled = spine.join(daily, ["series_key", "Date"], "left")
    return filled.select("series_key", "Date", *[
        F.coalesce(F.col(c), F.lit(0).cast(daily.schema[c].dataType)).alias(c)
        for c in value_cols])


def weekly_exact(daily: DataFrame) -> DataFrame:
    """Weekly roll-up of a daily series: weeks end on Sunday and are labelled
    by it; the weekly distinct counts are sums of the daily ones (T9); weeks
    without revenue are dropped (T11).  Zero-filled days add nothing, so the
    roll-up reads the unfilled daily table."""
    weekly = daily.groupBy("series_key", week_ending_sunday("Date").alias("Date")).agg(
        F.sum("_rev").alias("_rev"),
        F.sum("Transactions").cast("bigint").alias("Transactions"),
        F.sum("UniqueCustomers").cast("bigint").alias("UniqueCustomers"))
    return weekly.filter(F.col("_rev") > 0)


def weekly_revenue_exact(clean: DataFrame, by: str | None = None,
                         with_total: bool = False) -> DataFrame:
    """AGG6 with ``Revenue`` kept as an exact decimal (for exact decomposition
    and error metrics)."""
    return weekly_exact(daily_exact(clean, by, with_total)).select(
        "series_key", "Date", F.col("_rev").cast("decimal(24,3)").alias("Revenue"),
        "Transactions", "UniqueCustomers")


def weekly_sales(clean: DataFrame, by: str | None = None, with_total: bool = False) -> DataFrame:
    """AGG6: weekly series (Date = week-ending Sunday, Revenue, Transactions,
    UniqueCustomers)."""
    return weekly_exact(daily_exact(clean, by, with_total)).select(
        "series_key", "Date", F.col("_rev").cast("double").alias("Revenue"), "Transactions",
        "UniqueCustomers")


def series_range(series: DataFrame) -> DataFrame:
    """TS2: first day, last day and number of points per series."""
    return series.groupBy("series_key").agg(
        F.min("Date").alias("first_date"), F.max("Date").alias("last_date"),
        F.count(F.lit(1)).alias("points"))


def with_positions(series: DataFrame, holdout: int = 8) -> DataFrame:
    """WIN5 / TS4: 0-based position ``t`` and length ``n`` per series (no index
    in Spark), plus ``is_test`` for the last ``holdout`` points."""
    w = Window.partitionBy("series_key").orderBy("Date")
    return (series.withColumn("t", F.row_number().over(w) - 1)
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series_key")))
            .withColumn("is_test", (F.col("t") >= F.col("n") - holdout).cast("int")))


def centred_trend(y: str = "Revenue", period: int = 4, exact: bool = False) -> Column:
    """WIN6: centred 2×4 moving average (weights 1/8, 1/4, 1/4, 1/4, 1/8); NULL
    for the first and last two points.  ``exact`` keeps a decimal series in
    decimal arithmetic (the weights are exact binary fractions)."""
    assert period == 4, "the reference uses period 4"
    w = Window.partitionBy("series_key").orderBy("t")
    yc = F.col(y)
    terms = [F.lag(yc, 2).over(w), F.lag(yc, 1).over(w), yc, F.lead(yc, 1).over(w),
             F.lead(yc, 2).over(w)]
    if exact:
        weights = [Decimal("0.125"), Decimal("0.25"), Decimal("0.25"), Decimal("0.25"),
                   Decimal("0.125")]
        out = F.lit(weights[0]) * terms[0]
        for wt, term in zip(weights[1:], terms[1:]):
            out = out + F.lit(wt) * term
        return out
    return ((F.lit(0.5) * terms[0] + terms[1] + terms[2] + terms[3] + F.lit(0.5) * terms[4])
            / F.lit(4.0))


def decompose(series: DataFrame, y: str = "Revenue", period: int = 4) -> DataFrame:
    """TS3: additive decomposition — observed, trend (WIN6), seasonal (mean of
    detrended values per phase ``t mod period``, centred so the phase means
    average to zero), residual.  A decimal ``y`` is decomposed exactly up to
    the per-phase division, so results do not depend on summation order."""
    exact = isinstance(series.schema[y].dataType, T.DecimalType)
    pos = with_positions(series).withColumn("phase", F.col("t") % period)
    pos = pos.withColumn("trend", centred_trend(y, period, exact))
    detr = F.col(y) - F.col("trend")
    phase = (pos.groupBy("series_key", "phase")
             .agg(F.try_divide(F.sum(detr).cast("double"), F.count(detr).cast("double"))
                  .alias("_pm")))
    wide = phase.groupBy("series_key").agg(*[
        F.max(F.when(F.col("phase") == i, F.col("_pm"))).alias(f"_p{i}") for i in range(period)])
    total = F.coalesce(F.col("_p0"), F.lit(0.0))
    avail = F.col("_p0").isNotNull().cast("int")
    for i in range(1, period):
        total = total + F.coalesce(F.col(f"_p{i}"), F.lit(0.0))
        avail = avail + F.col(f"_p{i}").isNotNull().cast("int")
    wide = wide.select("series_key", F.try_divide(total, avail.cast("double")).alias("_mpm"))
    seas = phase.join(wide, "series_key").select(
        "series_key", "phase", (F.col("_pm") - F.col("_mpm")).alias("seasonal"))
    out = pos.join(seas, ["series_key", "phase"])
    obs, trd = F.col(y).cast("double"), F.col("trend").cast("double")
    return out.select("series_key", "Date", "t", obs.alias("observed"), trd.alias("trend"),
                      "seasonal", (obs - trd - F.col("seasonal")).alias("residual"))


def difference(series: DataFrame, y: str = "Revenue", lag: int = 1,
               seasonal_lag: int = 4) -> DataFrame:
    """TS5: regular then seasonal differencing, ``(1−B)(1−B^s) y``; the first
    ``lag + seasonal_lag`` points have no value and are dropped."""
    pos = with_positions(series)
    w = Window.partitionBy("series_key").orderBy("t")
    d1 = F.col(y) - F.lag(y, lag).over(w)
    pos = pos.withColumn("d1", d1)
    pos = pos.withColumn("d2", F.col("d1") - F.lag("d1", seasonal_lag).over(w))
    return pos.filter(F.col("d2").isNotNull()).select("series_key", "Date", "t", "d1", "d2")


def accuracy(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """TS8 / FN16: MAE, RMSE and MAPE (%) per series.  Absolute and squared
    errors are summed before the one division (exact for decimal inputs);
    MAPE skips zero actuals (NULL ratio) instead of failing."""
    err = F.col(actual) - F.col(predicted)
    n = F.count(err).cast("double")
    ratio = F.try_divide(err.cast("double"), F.col(actual).cast("double"))
    return pred.groupBy("series_key").agg(
        (F.sum(F.abs(err)).cast("double") / n).alias("mae"),
        F.sqrt(F.sum(err * err).cast("double") / n).alias("rmse"),
        (F.avg(F.abs(ratio)) * 100.0).alias("mape"),
        F.count(err).alias("points"))


def seasonal_naive_holdout(series: DataFrame, y: str = "Revenue", holdout: int = 8,
                           season: int = 4) -> DataFrame:
    """Fixed prediction for checking TS8 exactly: ``y[t−season]`` on the
    hold-out points (a test device; the forecasting model is TS6)."""
    pos = with_positions(series, holdout)
    w = Window.partitionBy("series_key").orderBy("t")
    pos = pos.withColumn("predicted", F.lag(y, season).over(w))
    return pos.filter((F.col("is_test") == 1) & F.col("predicted").isNotNull()).select(
        "series_key", "Date", F.col(y).alias("actual"), "predicted")


def future_weeks(series: DataFrame, steps: int = 12) -> DataFrame:
    """TS9 / FN14: the next ``steps`` week-ending dates after each series' last
    point, with the step number."""
    last = series.groupBy("series_key").agg(F.max("Date").alias("_last"))
    return last.select("series_key", F.posexplode(F.sequence(
        F.date_add("_last", 7), F.date_add("_last", 7 * steps),
        F.expr("INTERVAL 7 DAYS"))).alias("_i", "Date")).select(
        "series_key", (F.col("_i") + 1).cast("int").alias("Week"), "Date")

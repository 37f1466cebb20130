"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference's -------------------------
# Tier labels in report order, tier thresholds, churn threshold, risk-band
# cut points and labels, home country of the UK flag, cancellation prefix.
TIER_ORDER = ["VVIC", "VIC", "Prestige", "One-time"]
CHURN_THRESHOLD_DAYS = 90
RISK_BINS = [0.0, 0.3, 0.6, 1.0]
RISK_LABELS = ["Low", "Medium", "High"]
HOME_COUNTRY = "United Kingdom"
CANCEL_PREFIX = "C"
# ---------------------------------------------------------------------------


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_cancellation(invoice: str | Column = "invoice", null_as_text: bool = True) -> Column:
    """FN1 / FLT2: invoice starts with 'C'.

    ``null_as_text=True`` follows the notebook (a null invoice is cast to the
    text 'nan' first, so it is *not* a cancellation); ``False`` follows SQL
    (``NOT STARTSWITH(NULL)`` is NULL, so the row is filtered out).
    """
    inv = col_(invoice)
    if null_as_text:
        inv = F.coalesce(inv, F.lit(""))
    return inv.startswith(CANCEL_PREFIX)


def line_amount(quantity: str | Column = "quantity", price: str | Column = "price") -> Column:
    """PRJ1: exact decimal line amount quantity × price."""
    return col_(quantity) * col_(price)


def _wall(ts: str | Column) -> Column:
    return col_(ts).cast("timestamp_ntz")


def _time_of_day(ts: Column) -> Column:
    """Interval since midnight; wall-clock arithmetic knows no time zone."""
    return ts - F.to_date(ts).cast("timestamp_ntz")


def floor_days(start: str | Column, end: str | Column) -> Column:
    """FN9: whole elapsed 24-hour days from ``start`` to ``end`` (pandas ``.days``),
    on the wall-clock values themselves, so the session time zone has no part."""
    s, e = _wall(start), _wall(end)
    return F.datediff(F.to_date(e), F.to_date(s)) - (_time_of_day(e) < _time_of_day(s)).cast("int")


def calendar_days(start: str | Column, end: str | Column) -> Column:
    """FN10: calendar-day boundaries crossed, SQL ``DATEDIFF('day', start, end)``."""
    return F.datediff(F.to_date(col_(end)), F.to_date(col_(start)))


def week_ending_sunday(ts: str | Column) -> Column:
    """T8 notebook rule: label of the Monday–Sunday week is its Sunday."""
    return F.date_add(F.to_date(F.date_trunc("week", col_(ts))), 6)


def week_starting_monday(ts: str | Column) -> Column:
    """T8 SQL rule: ``DATE_TRUNC('week', ts)`` (Monday 00:00)."""
    return F.date_trunc("week", col_(ts))


def tier(r: str | Column, f: str | Column, m: str | Column) -> Column:
    """FN3: customer tier from the three 1–5 scores (the code's rule, not the comments')."""
    r, f, m = col_(r), col_(f), col_(m)
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), F.lit(TIER_ORDER[0]))
            .when((r >= 3) & (f >= 3) & (m >= 3), F.lit(TIER_ORDER[1]))
            .when(((r >= 2) & (f >= 2)) | (m >= 3), F.lit(TIER_ORDER[2]))
            .otherwise(F.lit(TIER_ORDER[3])))


def churn_flag(recency: str | Column, threshold: int = CHURN_THRESHOLD_DAYS) -> Column:
    """FN4 / ML2: 1 when inactive for more than ``threshold`` days."""
    return (col_(recency) > F.lit(threshold)).cast("int")


def risk_band(p: str | Column) -> Column:
    """FN5: right-closed bins (0,.3] (.3,.6] (.6,1]; 0 and out-of-range → NULL."""
    p = col_(p)
    lo, a, b, hi = RISK_BINS
    return (F.when((p > lo) & (p <= a), F.lit(RISK_LABELS[0]))
            .when((p > a) & (p <= b), F.lit(RISK_LABELS[1]))
            .when((p > b) & (p <= hi), F.lit(RISK_LABELS[2])))


def home_flag(country: str | Column, home: str = HOME_COUNTRY) -> Column:
    """FN6: 1 for the home country."""
    return (col_(country) == F.lit(home)).cast("int")


def clip_lower(c: str | Column, lower: float) -> Column:
    """FN7: ``clip(lower=…)``."""
    return F.greatest(col_(c), F.lit(lower))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """FN15: double ratio that is NULL (not an ANSI error) when the divisor is 0."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


_EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_to_instant(ts: str | Column) -> Column:
    """Wall-clock TIMESTAMP_NTZ → TIMESTAMP instant read as UTC, independent of
    the session time zone (a stream's event time needs an instant)."""
    since = _wall(ts) - F.lit(_EPOCH_NTZ).cast("timestamp_ntz")
    minutes = ((F.extract(F.lit("DAY"), since).cast("long") * 24
                + F.extract(F.lit("HOUR"), since)) * 60 + F.extract(F.lit("MINUTE"), since))
    micros = (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")
    return F.timestamp_micros(minutes * 60_000_000 + micros)


def instant_to_ntz(ts: str | Column) -> Column:
    """Inverse of ``ntz_to_instant`` (UTC wall clock, session-TZ independent)."""
    return F.timestamp_add("SECOND", F.unix_seconds(col_(ts)),
                           F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))

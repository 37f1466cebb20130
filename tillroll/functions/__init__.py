from tillroll.functions.expressions import (  # noqa: F401
    CHURN_THRESHOLD_DAYS, HOME_COUNTRY, RISK_LABELS, TIER_ORDER, calendar_days, churn_flag,
    clip_lower, floor_days, home_flag, is_cancellation, line_amount, risk_band, safe_ratio,
    tier, week_ending_sunday, week_starting_monday,
)

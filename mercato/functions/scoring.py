"""Score -> label expressions used by churn scoring and its reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.operators._util import col_of

# Fixed values (must equal the original behaviour):
# decision thresholds tried when picking the best-F1 cut: 0.10, 0.11, ..., 0.89
RISK_THRESHOLD_LOW = 10
RISK_THRESHOLD_HIGH = 89
RISK_THRESHOLDS = [j / 100.0 for j in range(RISK_THRESHOLD_LOW, RISK_THRESHOLD_HIGH + 1)]
# label cut-offs: "High Risk" needs at least max(threshold, 0.7); confidence is
# clamped to [0.1, 0.9]; the display tier uses > 0.7 and > 0.4
HIGH_RISK_FLOOR = 0.7
CONFIDENCE_MIN, CONFIDENCE_MAX = 0.1, 0.9
TIER_HIGH, TIER_MEDIUM = 0.7, 0.4
# rule-based risk points: +2 inactive > 90 days, +2 fewer than 3 orders,
# +1 free segment, +1 subscribed > 365 days with fewer than 10 orders;
# probability = min(points / 6, 0.8)
RULE_INACTIVE_DAYS, RULE_FEW_ORDERS = 90, 3
RULE_LONG_SUBSCRIPTION, RULE_LOW_ACTIVITY = 365, 10
RULE_POINTS_MAX, RULE_PROBABILITY_CAP = 6.0, 0.8


def confidence(p) -> Column:
    p = col_of(p)
    return F.least(F.greatest(F.abs(p - F.lit(0.5)) * F.lit(2.0), F.lit(CONFIDENCE_MIN)),
                   F.lit(CONFIDENCE_MAX))


def risk_label(p, threshold) -> Column:
    p = col_of(p)
    thr = col_of(threshold) if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    return (F.when(p >= F.greatest(thr, F.lit(HIGH_RISK_FLOOR)), F.lit("High Risk"))
            .when(p >= thr, F.lit("Medium Risk"))
            .otherwise(F.lit("Low Risk")))


def display_tier(p) -> Column:
    p = col_of(p)
    return (F.when(p > F.lit(TIER_HIGH), F.lit("high"))
            .when(p > F.lit(TIER_MEDIUM), F.lit("medium"))
            .otherwise(F.lit("low")))


def rule_risk_points(days_inactive, n_orders, segment, subscription_days,
                     free_segment: str = "Free") -> Column:
    d, n, s, sub = map(col_of, (days_inactive, n_orders, segment, subscription_days))
    return ((F.when(d > RULE_INACTIVE_DAYS, 2).otherwise(0))
            + F.when(n < RULE_FEW_ORDERS, 2).otherwise(0)
            + F.when(s == F.lit(free_segment), 1).otherwise(0)
            + F.when((sub > RULE_LONG_SUBSCRIPTION) & (n < RULE_LOW_ACTIVITY), 1).otherwise(0)
            ).cast("int")


def rule_risk_probability(points) -> Column:
    return F.least(col_of(points).cast("double") / F.lit(RULE_POINTS_MAX),
                   F.lit(RULE_PROBABILITY_CAP))


def threshold_bucket(score, lo: int = RISK_THRESHOLD_LOW, hi: int = RISK_THRESHOLD_HIGH) -> Column:
    """Largest j in [lo, hi] with ``score >= j/100`` (``lo - 1`` if none).

    ``floor(score * 100)`` alone is wrong at the edges (0.29 * 100 < 29), so
    the first guess is corrected by one comparison against the exact
    threshold value in either direction.
    """
    s = col_of(score).cast("double")
    j0 = F.floor(s * F.lit(100.0)).cast("int")
    j = (F.when(s < j0 / F.lit(100.0), j0 - 1)
         .when(s >= (j0 + 1) / F.lit(100.0), j0 + 1)
         .otherwise(j0))
    return F.least(F.greatest(j, F.lit(lo - 1)), F.lit(hi)).cast("int")

"""Column-expression helpers (pure ``pyspark.sql.functions`` compositions,
JVM-side and whole-stage-codegen friendly; no Python UDFs)."""

from mercato.functions.coerce import (  # noqa: F401
    days_elapsed, lenient_number, lenient_number_or_zero, lenient_timestamp,
    finite_or_zero, weekday_mon0, as_timestamp,
)
from mercato.functions.scoring import (  # noqa: F401
    confidence, risk_label, display_tier, rule_risk_points, rule_risk_probability,
    threshold_bucket, RISK_THRESHOLDS,
)

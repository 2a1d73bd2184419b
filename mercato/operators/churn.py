"""Churn features, one-hot encoding, rule-based risk, rates and label gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.coerce import days_elapsed
from mercato.functions.scoring import rule_risk_points, rule_risk_probability
from mercato.operators._util import attach_group_stats, keys
from mercato.operators.quantiles import exact_quantiles

# Missing "days since last activity" -> 365, missing
# subscription length / business counts -> 0, missing categories ->
# "Unknown"; at least 10 labelled rows are needed to train a tenant's model.
NEVER_ACTIVE_DAYS = 365
UNKNOWN = "Unknown"
MIN_LABELLED_ROWS = 10
TEST_PERCENT = 20
VALIDATION_PERCENT = 10


def churn_features(df: DataFrame, as_of, *, last_active_col: str = "last_login_date",
                   median_cols: Sequence[str] = ("age",),
                   zero_cols: Sequence[str] = ("subscription_length", "total_orders",
                                               "total_spent", "avg_order_value"),
                   unknown_cols: Sequence[str] = ("gender", "segment"),
                   group_cols: Sequence[str] = (),
                   medians: DataFrame | None = None) -> DataFrame:
    """Feature columns of a customer table.

    ``days_since_last_login`` = whole days from ``last_active_col`` to
    ``as_of`` (a literal or a column), 365 when never active; ``median_cols``
    are filled with their (per-group) exact median, or with the medians
    learnt at training time when ``medians`` is given; ``zero_cols`` with 0;
    ``unknown_cols`` with "Unknown".
    """
    g = keys(group_cols)
    as_of_c = as_of if not isinstance(as_of, str) else F.lit(as_of).cast("timestamp")
    out = df
    if last_active_col in df.columns:
        out = out.withColumn("days_since_last_login", F.coalesce(
            days_elapsed(F.col(last_active_col), as_of_c), F.lit(NEVER_ACTIVE_DAYS)))
    else:
        out = out.withColumn("days_since_last_login", F.lit(NEVER_ACTIVE_DAYS).cast("long"))
    for c in zero_cols:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
        else:
            out = out.withColumn(c, F.lit(0))
    for c in unknown_cols:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)))
    med_cols = [c for c in median_cols if c in out.columns]
    if med_cols:
        if medians is None:
            medians = median_table(df, med_cols, g)
        out = attach_group_stats(out, medians, g)
        for c in med_cols:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"median__{c}")))
        out = out.drop(*[f"median__{c}" for c in med_cols])
    return out


def median_table(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per group with ``median__<col>`` (exact, distributed)."""
    g = keys(group_cols)
    q = exact_quantiles(df, cols, [0.5], g)
    return q.groupBy(*g).agg(*[F.max(F.when(F.col("column") == c, F.col("value")))
                               .alias(f"median__{c}") for c in cols])


def one_hot(df: DataFrame, levels: dict[str, list[str]], drop_source: bool = True) -> DataFrame:
    """``<col>_<level>`` 0/1 columns for levels that the caller names; a value
    that is none of them gets all zeros.  (For levels that the data decide,
    see :mod:`mercato.operators.encode`.)"""
    out = df
    for c, vals in levels.items():
        out = out.withColumns({f"{c}_{v}": (F.col(c).cast("string") == F.lit(v)).cast("int")
                               for v in vals})
        out = out.withColumns({f"{c}_{v}": F.coalesce(F.col(f"{c}_{v}"), F.lit(0))
                               for v in vals})
        if drop_source:
            out = out.drop(c)
    return out


NUMERIC_FEATURES = ("age", "subscription_length", "days_since_last_login", "total_orders",
                    "total_spent", "avg_order_value")


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project ``features`` in model order; features missing from ``df`` are
    0.0 and every feature is DOUBLE (missing values -> 0)."""
    cols = [F.col(c) for c in keep]
    for f in features:
        if f in df.columns:
            cols.append(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f))
        else:
            cols.append(F.lit(0.0).alias(f))
    return df.select(*cols)


def rule_churn_risk(df: DataFrame, days_col: str = "days_since_last_login",
                    orders_col: str = "total_orders", segment_col: str = "segment",
                    subscription_col: str = "subscription_length",
                    free_segment: str = "Free") -> DataFrame:
    """Rule points (0..6) and probability min(points / 6, 0.8)."""
    pts = rule_risk_points(days_col, orders_col, segment_col, subscription_col, free_segment)
    return (df.withColumn("risk_points", pts)
            .withColumn("risk_probability", rule_risk_probability("risk_points")))


def churn_rate_by(df: DataFrame, label_col: str = "churned", by: Sequence[str] = ("segment",)
                  ) -> DataFrame:
    """Customers, churned customers and churn rate in percent per segment, of
    the labelled rows; a segment without any has zeros."""
    known = F.col(label_col).isNotNull()
    return df.groupBy(*keys(by)).agg(
        F.count_if(known).alias("customers"),
        F.coalesce(F.sum(F.col(label_col).cast("long")), F.lit(0)).alias("churned")).withColumn(
        "churn_rate", F.coalesce(F.try_divide(F.col("churned"), F.col("customers")) * F.lit(100.0),
                                 F.lit(0.0)))


def labelled_counts(df: DataFrame, tenant_col: str = "tenant_id", label_col: str = "churned",
                    min_rows: int = MIN_LABELLED_ROWS) -> DataFrame:
    """Labelled rows per tenant and whether the tenant may train a model."""
    return (df.groupBy(tenant_col)
            .agg(F.count(F.col(label_col)).alias("labelled_rows"))
            .withColumn("eligible", F.col("labelled_rows") >= min_rows))


def eligible_rows(df: DataFrame, tenant_col: str = "tenant_id", label_col: str = "churned",
                  min_rows: int = MIN_LABELLED_ROWS) -> DataFrame:
    """Labelled rows of tenants with at least ``min_rows`` labels (semi-join
    against the per-tenant counts: no per-tenant loop)."""
    ok = labelled_counts(df, tenant_col, label_col, min_rows).where("eligible")
    return (df.where(F.col(label_col).isNotNull())
            .join(ok.select(tenant_col), on=tenant_col, how="left_semi"))

"""Pipeline-run history analytics: status mapping, look-back filter, counts,
per-day breakdown, newest runs and latest state per upload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.operators._util import attach_group_stats, col_of, keys, null_safe_join

# Raw run status -> display status (anything else is "Other"),
# the three displayed statuses in display order, default look-back of 30 days.
STATUS_MAP = {"started": "Running", "completed": "Success", "failed": "Failed"}
DISPLAY_STATUSES = ("Success", "Failed", "Running")
LOOKBACK_DAYS = 30
RECENT_RUNS = 10


def ui_status(status) -> Column:
    m = F.create_map(*[x for k, v in STATUS_MAP.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[col_of(status)], F.lit("Other"))


def with_ui_status(runs: DataFrame, status_col: str = "status") -> DataFrame:
    return runs.withColumn("ui_status", ui_status(status_col))


def of_status(runs: DataFrame, status: str, status_col: str = "status") -> DataFrame:
    """The runs of one status."""
    return runs.where(F.col(status_col) == status)


def padded_id(c, prefix: str = "", width: int = 6) -> Column:
    """An id of at least ``width`` digits behind a prefix; longer ones stay whole."""
    digits = col_of(c).cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def percent(part, whole) -> Column:
    """A share of two counts as text in percent with one decimal, rounded
    half up exactly; of nothing, 0.0%."""
    whole = F.greatest(col_of(whole).cast("long"), F.lit(1))
    tenths = F.floor((col_of(part).cast("decimal(20,0)") * 2000 + whole) / (whole * 2)).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%"))


def recent(runs: DataFrame, ts_col: str = "created_at", days: int = LOOKBACK_DAYS,
           as_of=None, status: str | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """Runs at or after ``as_of - days`` (``as_of`` defaults to the latest run
    of the group), optionally only one display status."""
    g = keys(group_cols)
    out = runs if "ui_status" in runs.columns else with_ui_status(runs)
    if as_of is None:
        ref = out.groupBy(*g).agg(F.max(ts_col).alias("__as_of"))
        out = attach_group_stats(out, ref, g)
        cut = F.col("__as_of") - F.make_interval(days=F.lit(days))
    else:
        cut = F.lit(as_of).cast(dict(out.dtypes)[ts_col]) - F.make_interval(days=F.lit(days))
    out = out.where(F.col(ts_col) >= cut)
    if status is not None:
        out = out.where(F.col("ui_status") == status)
    return out.drop("__as_of")


def status_counts(runs: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Count per display status; always one row per status, zeros kept."""
    g = keys(group_cols)
    out = runs if "ui_status" in runs.columns else with_ui_status(runs)
    wide = out.groupBy(*g).agg(F.array(*[
        F.struct(F.lit(s).alias("ui_status"), F.count_if(F.col("ui_status") == s).alias("runs"))
        for s in DISPLAY_STATUSES]).alias("c"))
    return wide.select(*g, F.inline("c"))


def status_by_day(runs: DataFrame, ts_col: str = "created_at",
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """Per calendar day: number of Success / Failed / Running runs (days that
    only have other statuses appear with zeros)."""
    g = keys(group_cols)
    out = runs if "ui_status" in runs.columns else with_ui_status(runs)
    return (out.where(F.col(ts_col).isNotNull())
            .groupBy(*g, F.to_date(ts_col).alias("day"))
            .agg(*[F.count_if(F.col("ui_status") == s).alias(s) for s in DISPLAY_STATUSES]))


def newest(df: DataFrame, ts_col: str = "created_at", n: int = RECENT_RUNS,
           tie_col: str | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """The ``n`` newest rows overall or per group (ties broken by ``tie_col``
    descending).  Per group this is a ``row_number() <= n`` filter, which
    Spark plans with a per-partition group limit before the shuffle."""
    g = keys(group_cols)
    order = [F.col(ts_col).desc()] + ([F.col(tie_col).desc()] if tie_col else [])
    if not g:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*g).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def latest_per_key(df: DataFrame, key_cols: Sequence[str], ts_col: str = "created_at",
                   tie_col: str | None = None) -> DataFrame:
    """The latest row per key (ties -> larger ``tie_col``).  A ``max_by``
    aggregate: partial aggregation keeps one candidate per key per task, so
    a key with a third of all rows costs no more than any other."""
    k = keys(key_cols)
    rest = [c for c in df.columns if c not in k]
    order = F.struct(F.col(ts_col), *([F.col(tie_col)] if tie_col else []))
    return (df.groupBy(*k).agg(F.max_by(F.struct(*rest), order).alias("__r"))
            .select(*k, *[F.col(f"__r.{c}").alias(c) for c in rest]))


def preview(df: DataFrame, n: int, order_cols: Sequence, group_cols: Sequence[str] = ()
            ) -> DataFrame:
    """The first ``n`` rows in ``order_cols`` order (per group), each carrying
    ``more`` = how many rows were not shown (``greatest(count - n, 0)``).
    The count is an aggregate, the slice a top-n: no full sort."""
    g = keys(group_cols)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    if not g:
        head = df.orderBy(*order).limit(n)
        total = df.agg(F.count(F.lit(1)).alias("__n"))
        return (head.crossJoin(F.broadcast(total))
                .withColumn("more", F.greatest(F.col("__n") - n, F.lit(0))).drop("__n"))
    w = Window.partitionBy(*g).orderBy(*order)
    head = df.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= n).drop("__rk")
    total = df.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"))
    return (null_safe_join(head, total, g)
            .withColumn("more", F.greatest(F.col("__n") - n, F.lit(0))).drop("__n"))

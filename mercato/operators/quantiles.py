"""Exact and approximate quantiles, modes and value counts over many columns.

Columns are stacked into long ``(column, value)`` rows so one shuffle serves
all of them.  Exact quantiles never hold a column in one task: duplicates
are collapsed by a partial aggregate, the distinct values are cut into
balanced buckets by approximate quantiles, ranks come from windows
partitioned by bucket plus per-bucket offsets, and the rows at the wanted
ranks are interpolated linearly (the pandas / SQL ``quantile_cont`` rule).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.operators._util import attach_group_stats, null_safe_join, with_bucket
from mercato.operators._util import keys as _keys
from mercato.session import materialize

RANK_BUCKETS = 64


def stack_columns(df: DataFrame, cols: Sequence[str], value_type: str = "double",
                  group_cols: Sequence[str] = (), ids: bool = False) -> DataFrame:
    """Long form ``(group..., column, value)`` of ``cols`` cast to one type;
    NULL (and NaN for doubles) values are dropped.  With ``ids`` the column
    is identified by its position ``cid`` (an int hashes and sorts faster
    than a name; see :func:`with_names`)."""
    g = _keys(group_cols)
    key = (lambda i, c: F.lit(i).alias("cid")) if ids else (lambda i, c: F.lit(c).alias("column"))
    arr = F.array(*[F.struct(key(i, c), F.col(c).cast(value_type).alias("value"))
                    for i, c in enumerate(cols)])
    long = df.select(*g, F.inline(arr))
    cond = F.col("value").isNotNull()
    if value_type == "double":
        cond = cond & ~F.isnan("value")
    return long.where(cond)


def with_names(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace the position ``cid`` by the column name ``column``."""
    names = F.array(*[F.lit(c) for c in cols])
    return df.withColumn("column", F.element_at(names, F.col("cid") + 1)).drop("cid")


def value_counts(df: DataFrame, cols: Sequence[str], value_type: str = "string",
                 group_cols: Sequence[str] = (), ids: bool = False) -> DataFrame:
    """``(group..., column, value, cnt)``: one row per distinct non-null
    value.  Map-side partial aggregation keeps hot values cheap.  Grouping
    runs on the column position; names are attached after the aggregate
    unless ``ids`` keeps the position (``cid``)."""
    g = _keys(group_cols)
    out = (stack_columns(df, cols, value_type, g, ids=True)
           .groupBy(*g, "cid", "value").agg(F.count(F.lit(1)).alias("cnt")))
    return out if ids else with_names(out, cols)


def column_modes(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per column (ties -> smallest), its frequency, the
    number of distinct values and of non-null values.  ``value`` is a string;
    cast back to the column type when filling."""
    g = _keys(group_cols)
    vc = value_counts(df, cols, "string", g, ids=True)
    out = vc.groupBy(*g, "cid").agg(
        F.min_by("value", F.struct((-F.col("cnt")).alias("neg"), F.col("value"))).alias("top"),
        F.max("cnt").alias("freq"),
        F.count(F.lit(1)).alias("unique"),
        F.sum("cnt").alias("count"))
    return with_names(out, cols)


def _bucketed(vc: DataFrame, k: list[str], buckets: int, value: str = "value") -> DataFrame:
    """Rows with a balanced bucket that never decreases as ``value`` grows:
    the position of ``value`` among the per-key approximate quantiles."""
    cuts = vc.groupBy(*k).agg(F.percentile_approx(
        F.col(value).cast("double"), [i / buckets for i in range(1, buckets)],
        10 * buckets).alias("__cuts"))
    joined = attach_group_stats(vc, cuts, k)
    return with_bucket(joined, "__cuts", F.col(value).cast("double"), buckets - 1,
                       "bucket").drop("__cuts")


def _bucket_offsets(b: DataFrame, k: list[str], count_col: str) -> DataFrame:
    """Per (key, bucket): total count, running offset of the bucket and the
    key total (at most ``buckets`` rows per key)."""
    totals = b.groupBy(*k, "bucket").agg(F.sum(count_col).alias("bt"))
    w = Window.partitionBy(*k)
    return (totals.withColumn("off", F.coalesce(F.sum("bt").over(
        w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("n", F.sum("bt").over(w)))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    group_cols: Sequence[str] = (), buckets: int = RANK_BUCKETS) -> DataFrame:
    """``(group..., column, q, value)`` with the exact linearly interpolated
    quantile: position ``q * (n - 1)`` in sorted order.

    1. distinct values with counts (partial aggregate, written once), cut
       into balanced buckets at approximate quantiles;
    2. per-bucket totals and their running offsets (one row per key x
       bucket) locate the bucket holding each wanted rank;
    3. only those buckets are ranked, by a window per (key, bucket, target).
    """
    g = _keys(group_cols)
    k = [*g, "cid"]
    # read by several branches below: materialise the distinct values once
    vc = materialize(value_counts(df, cols, "double", g, ids=True))
    b = _bucketed(vc, k, buckets)
    offs = _bucket_offsets(b, k, "cnt")
    n1 = F.col("n").cast("double") - 1
    targets = offs.select(*k, "bucket", "off", "bt", F.inline(F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.lit(side).alias("side"),
                 (F.floor(F.lit(float(q)) * n1) if side == 0 else F.ceil(F.lit(float(q)) * n1))
                 .cast("long").alias("rank"),
                 (F.lit(float(q)) * n1 - F.floor(F.lit(float(q)) * n1)).alias("frac"))
        for q in probs for side in (0, 1)]))).where(
        (F.col("off") <= F.col("rank")) & (F.col("rank") < F.col("off") + F.col("bt")))
    ranked = (null_safe_join(b, targets, [*k, "bucket"], equal=["cid", "bucket"])
              .withColumn("cum", F.sum("cnt").over(
                  Window.partitionBy(*k, "bucket", "q", "side").orderBy("value")
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    hit = ranked.where((F.col("off") + F.col("cum") - F.col("cnt") <= F.col("rank"))
                       & (F.col("rank") < F.col("off") + F.col("cum")))
    out = hit.groupBy(*k, "q").agg(
        F.max(F.when(F.col("side") == 0, F.col("value"))).alias("v_lo"),
        F.max(F.when(F.col("side") == 1, F.col("value"))).alias("v_hi"),
        F.max("frac").alias("frac"))
    out = out.select(*k, "q", (F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo")))
                     .alias("value"))
    return with_names(out, cols).select(*g, "column", "q", "value")


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     group_cols: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Same shape as :func:`exact_quantiles` from ``percentile_approx``
    (bounded memory per group, rank error <= n / accuracy)."""
    g = _keys(group_cols)
    k = [*g, "column"]
    long = stack_columns(df, cols, "double", g)
    agg = long.groupBy(*k).agg(F.percentile_approx("value", list(map(float, probs)), accuracy)
                               .alias("vals"))
    return agg.select(*k, F.posexplode("vals").alias("i", "value")).select(
        *k, F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1).alias("q"),
        "value")


def quantiles_wide(long: DataFrame, probs: Sequence[float], names: Sequence[str],
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """Pivot ``(group..., column, q, value)`` to one column per quantile."""
    k = [*_keys(group_cols), "column"]
    return long.groupBy(*k).agg(*[
        F.max(F.when(F.col("q") == F.lit(float(p)), F.col("value"))).alias(n)
        for p, n in zip(probs, names)])

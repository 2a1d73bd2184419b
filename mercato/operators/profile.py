"""Dataset summary and per-column profile ("describe everything")."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.coerce import finite_or_zero
from mercato.operators._util import keys, null_safe_join
from mercato.operators.quantiles import (approx_quantiles, column_modes, exact_quantiles,
                                         quantiles_wide)

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
QUARTILES = (0.25, 0.5, 0.75)
STAT_COLS = ["count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max"]


def column_kinds(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """numeric / datetime / categorical per column (plan-time, from the schema)."""
    out = {}
    for f in df.schema.fields:
        if cols is not None and f.name not in cols:
            continue
        if isinstance(f.dataType, NUMERIC):
            out[f.name] = "numeric"
        elif isinstance(f.dataType, DATETIME):
            out[f.name] = "datetime"
        else:
            out[f.name] = "categorical"
    return out


def dataset_summary(df: DataFrame, date_col: str | None = "order_date",
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Row count, column names/count and the latest value of ``date_col``
    (NULL when the column is absent)."""
    g = keys(group_cols)
    names = [c for c in df.columns if c not in g]
    last = F.max(date_col) if date_col and date_col in df.columns else F.lit(None)
    return df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(names)).alias("column_count"),
        F.array(*[F.lit(c) for c in names]).alias("columns"),
        last.alias("last_order_date"))


def _numeric_view(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Datetime columns as epoch microseconds so they can be averaged and
    ranked like numbers."""
    out = df
    for c, k in kinds.items():
        if k == "datetime":
            out = out.withColumn(c, F.unix_micros(F.col(c).cast("timestamp")).cast("double"))
    return out


def describe(df: DataFrame, cols: Sequence[str] | None = None, group_cols: Sequence[str] = (),
             exact: bool = True) -> DataFrame:
    """One row per (group, column): count, unique, top, freq, mean, std, min,
    quartiles, max.  Numeric and datetime columns fill the numeric stats
    (datetime as epoch microseconds, no std); categorical columns fill
    count/unique/top/freq.  Three jobs for any number of columns: one wide
    aggregate for the moments, one stacked rank job for the quartiles, one
    stacked value-count job for the modes."""
    g = keys(group_cols)
    cols = [c for c in (cols or df.columns) if c not in g]
    kinds = column_kinds(df, cols)
    num = [c for c in cols if kinds[c] != "categorical"]
    cat = [c for c in cols if kinds[c] == "categorical"]
    parts = []
    if num:
        view = _numeric_view(df.select(*g, *num), kinds)
        aggs = []
        for c in num:
            x = F.col(c).cast("double")
            std = F.stddev_samp(x) if kinds[c] == "numeric" else F.lit(None).cast("double")
            aggs.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"),
                                 F.avg(x).alias("mean"), std.alias("std"),
                                 F.min(x).alias("min"), F.max(x).alias("max")))
        wide = view.groupBy(*g).agg(F.array(*aggs).alias("m"))
        moments = wide.select(*g, F.inline("m"))
        qfn = exact_quantiles if exact else approx_quantiles
        q = quantiles_wide(qfn(view, num, QUARTILES, g), QUARTILES, ["p25", "p50", "p75"], g)
        parts.append(null_safe_join(moments, q, [*g, "column"], "left", equal=["column"]).select(
            *g, "column", F.col("count").cast("long").alias("count"),
            F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("long").alias("freq"), "mean", "std", "min", "p25", "p50", "p75",
            "max"))
    if cat:
        m = column_modes(df, cat, g).drop("count")
        # non-null counts from one wide aggregate: columns with no value at
        # all still get their row
        counts = (df.groupBy(*g).agg(F.array(*[
            F.struct(F.lit(c).alias("column"), F.count(c).alias("count")) for c in cat])
            .alias("c")).select(*g, F.inline("c")))
        m = null_safe_join(counts, m, [*g, "column"], "left", equal=["column"])
        nulls = [F.lit(None).cast("double").alias(c)
                 for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
        parts.append(m.select(*g, "column", F.col("count").cast("long").alias("count"),
                              F.coalesce(F.col("unique"), F.lit(0)).cast("long").alias("unique"),
                              F.col("top").cast("string").alias("top"),
                              F.col("freq").cast("long").alias("freq"), *nulls))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kind_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(kinds[c]))])
    return out.withColumn("kind", kind_map[F.col("column")])


def json_safe(profile: DataFrame) -> DataFrame:
    """NaN / infinite / missing numeric statistics -> 0 (JSON-safe); ``top``
    stays NULL for columns that have none."""
    out = profile
    for c in ("mean", "std", "min", "p25", "p50", "p75", "max"):
        out = out.withColumn(c, finite_or_zero(c))
    for c in ("count", "unique", "freq"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return out


def column_variances(df: DataFrame, cols: Sequence[str] | None = None,
                     group_cols: Sequence[str] = (), scale: int | None = None) -> DataFrame:
    """Sample variance per numeric column, long form ``(group..., column,
    variance)``.  With ``scale`` (values have at most that many decimals) the
    sums run on exact integers, so the result does not depend on the order
    partitions are merged in."""
    g = keys(group_cols)
    kinds = column_kinds(df, cols)
    num = [c for c, k in kinds.items() if k == "numeric" and c not in g]
    structs = []
    for c in num:
        if scale is None:
            v = F.var_samp(F.col(c).cast("double"))
        else:
            x = F.round(F.col(c) * F.lit(10 ** scale)).cast("decimal(38,0)")
            n = F.count(x).cast("decimal(38,0)")
            num_ = (n * F.sum(x * x) - F.sum(x) * F.sum(x)).cast("double")
            den = (F.count(x) * (F.count(x) - 1)).cast("double")
            v = F.try_divide(F.try_divide(num_, den), F.lit(float(10 ** (2 * scale))))
        structs.append(F.struct(F.lit(c).alias("column"), v.alias("variance")))
    return df.groupBy(*g).agg(F.array(*structs).alias("v")).select(*g, F.inline("v"))

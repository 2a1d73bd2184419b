"""Missing-value imputation, date parsing and numeric enforcement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.coerce import lenient_timestamp, parses_as
from mercato.operators._util import attach_group_stats, keys, null_safe_join
from mercato.operators.profile import column_kinds
from mercato.operators.quantiles import column_modes

# A column is parsed as a date when its lower-cased name
# contains one of these words.
DATE_NAME_WORDS = ("date", "tarih")


def fill_values(df: DataFrame, group_cols: Sequence[str] = (),
                cols: Sequence[str] | None = None) -> DataFrame:
    """One row per group with the value each column is filled with: the mean
    for numeric columns, the most frequent value (ties -> smallest) for the
    others.  Columns named ``fill__<col>``."""
    g = keys(group_cols)
    kinds = column_kinds(df, [c for c in (cols or df.columns) if c not in g])
    num = [c for c, k in kinds.items() if k == "numeric"]
    other = [c for c, k in kinds.items() if k != "numeric"]
    # every group has a row here, also one without any value to fill with
    means = df.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"), *[
        F.avg(F.col(c).cast("double")).alias(f"fill__{c}") for c in num]).drop("__n")
    if not other:
        return means
    modes = column_modes(df, other, g).groupBy(*g).agg(*[
        F.max(F.when(F.col("column") == c, F.col("top"))).alias(f"fill__{c}") for c in other])
    return null_safe_join(means, modes, g, "left")


def clean_missing(df: DataFrame, group_cols: Sequence[str] = (),
                  cols: Sequence[str] | None = None) -> DataFrame:
    """Impute: numeric -> mean (integers become DOUBLE first), other -> mode.
    Columns with no value at all stay NULL.  The fill values are a
    one-row-per-group aggregate joined back, so nothing passes through the
    driver."""
    g = keys(group_cols)
    kinds = column_kinds(df, [c for c in (cols or df.columns) if c not in g])
    if not kinds:
        return df
    fills = fill_values(df, g, list(kinds))
    joined = attach_group_stats(df, fills, g)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c not in kinds:
            out.append(F.col(c))
        elif kinds[c] == "numeric":
            out.append(F.coalesce(F.col(c).cast("double"), F.col(f"fill__{c}")).alias(c))
        else:
            fill = F.col(f"fill__{c}")
            if not isinstance(types[c], T.StringType):
                fill = fill.try_cast(types[c])
            out.append(F.coalesce(F.col(c), fill).alias(c))
    return joined.select(*out)


def parse_dates(df: DataFrame, words: Sequence[str] = DATE_NAME_WORDS,
                formats: tuple[str, ...] = ()) -> DataFrame:
    """String columns whose name contains one of ``words`` -> TIMESTAMP,
    unparsable -> NULL.  Non-string columns are left as they are."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and any(w in f.name.lower() for w in words):
            out = out.withColumn(f.name, lenient_timestamp(f.name, formats))
    return out


def numeric_string_columns(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """For string columns whose every non-null value parses as a number:
    ``{column: "long" | "double"}``.  One aggregate job, one row back."""
    strs = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and (cols is None or f.name in cols)]
    if not strs:
        return {}
    aggs = []
    for c in strs:
        x = F.trim(F.col(c))
        aggs.append(F.bool_and(x.isNull() | parses_as(x, "double")).alias(f"d__{c}"))
        aggs.append(F.bool_and(x.isNull() | parses_as(x, "long")).alias(f"l__{c}"))
    row = df.agg(*aggs).first()
    out = {}
    for c in strs:
        if row[f"d__{c}"] is not False:
            out[c] = "long" if row[f"l__{c}"] is not False else "double"
    return out


def enforce_numeric(df: DataFrame, cols: Sequence[str] | None = None,
                    conv: dict[str, str] | None = None) -> DataFrame:
    """All-or-nothing numeric conversion of string columns: a column becomes
    LONG/DOUBLE only if every non-null value parses; otherwise it stays a
    string.  ``conv`` (from :func:`numeric_string_columns`) skips the check,
    e.g. when it was made on the raw rows before imputation, which fills
    only with values the column already has and so cannot change it."""
    if conv is None:
        conv = numeric_string_columns(df, cols)
    out = df
    for c, t in conv.items():
        if c in out.columns and isinstance(out.schema[c].dataType, T.StringType):
            out = out.withColumn(c, F.trim(F.col(c)).try_cast(t))
    return out

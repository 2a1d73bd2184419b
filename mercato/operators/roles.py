"""Find the date column and the quantity column of an arbitrary upload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators.profile import column_variances

# Name keywords, tried first as an exact (lower-cased, trimmed)
# match and then as a substring, in column order.
DATE_KEYWORDS = ("date", "time", "created", "order", "timestamp", "tarih",
                 "zaman", "sipariş", "registered", "updated", "modified")
QUANTITY_KEYWORDS = ("quantity", "qty", "amount", "count", "total", "miktar",
                     "adet", "sayı", "tutar", "price", "fiyat", "sales", "satış")


def _by_name(columns, words):
    for c in columns:
        if c.lower().strip() in words:
            return c
    for c in columns:
        low = c.lower().strip()
        if any(w in low for w in words):
            return c
    return None


def date_parse_rates(df: DataFrame) -> DataFrame:
    """Share of non-null values that parse as a timestamp, per string column
    (long form; one aggregate job)."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strs:
        return df.sparkSession.createDataFrame([], "column string, parse_rate double")
    structs = [F.struct(F.lit(c).alias("column"),
                        F.try_divide(F.count(F.try_to_timestamp(F.col(c))), F.count(F.col(c)))
                        .alias("parse_rate")) for c in strs]
    return df.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def find_date_column(df: DataFrame, strict: bool = False) -> str | None:
    """Exact keyword -> substring keyword -> first timestamp-typed column or
    string column whose every non-null value parses as a timestamp.  With
    ``strict`` only date-like columns (typed, or fully parsable strings) are
    candidates for the name match, so ``order_id`` can no longer win."""
    dated = [f.name for f in df.schema.fields
             if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    rates: dict | None = None

    def parse_rates():
        nonlocal rates
        if rates is None:
            rates = ({r["column"]: r["parse_rate"] for r in date_parse_rates(df).collect()}
                     if strs else {})
        return rates

    def date_like(c):
        return c in dated or (c in strs and (parse_rates().get(c) or 0.0) >= 1.0)

    names = [c for c in df.columns if date_like(c)] if strict else list(df.columns)
    hit = _by_name(names, DATE_KEYWORDS)
    if hit is not None:
        return hit
    for c in df.columns:
        if date_like(c):
            return c
    return None


def find_quantity_column(df: DataFrame, strict: bool = False) -> str | None:
    """Exact keyword -> substring keyword -> numeric column with the largest
    sample variance (one aggregate job)."""
    numeric = [f.name for f in df.schema.fields if isinstance(
        f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                     T.DoubleType, T.DecimalType))]
    names = numeric if strict else df.columns
    hit = _by_name(names, QUANTITY_KEYWORDS)
    if hit is not None:
        return hit
    if not numeric:
        return None
    best = (column_variances(df, numeric).where(F.col("variance").isNotNull())
            .agg(F.max_by("column", "variance").alias("c")).first())
    return best["c"] if best else None

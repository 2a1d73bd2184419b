"""CSV uploads: many files read as one table with an upload id per file.

Files are read as text (so one bad value never fails or silently mistypes a
whole file), the pandas-style missing-value tokens become NULL, and then each column is typed all-or-nothing by one aggregate job: LONG if
every non-null value is an integer, DOUBLE if every one is a number,
BOOLEAN if every one is true/false, otherwise it stays a string.  Dates
stay strings here (``clean.parse_dates`` handles them), like the original
reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.coerce import parses_as
from mercato.operators._util import salted_join
from mercato.sources import records
from mercato.sources.records import CSV_GLOB

def read_uploads(spark: SparkSession, paths: str | Sequence[str], infer_types: bool = True,
                 schema: T.StructType | str | None = None) -> DataFrame:
    """All CSV files under ``paths`` as one DataFrame with ``upload_file``
    (the file path) and ``upload_id`` (a stable hash of it).

    Columns are bound by the names in each file's own header (see
    :mod:`mercato.sources.records`): one plan for any number of headers, a
    column that a file lacks being null there.  ``schema`` picks and types
    columns by name; without it every name of any header is a column."""
    rows = records.records(records.file_lines(spark, paths))
    named = records.headers(rows)
    cells = records.with_cells(rows, named)
    if schema is not None:
        return records.bound(cells, schema)
    names = records.column_names(named)
    df = cells.select(*[F.col("cells")[c].alias(c) for c in names], "upload_file", "upload_id")
    return infer_column_types(df, names) if infer_types else df


def upload_types(df: DataFrame, cols: Sequence[str], upload_col: str = "upload_id") -> DataFrame:
    """(upload, column, kind): the all-or-nothing type of each column in each
    upload: long, double, boolean, string, or missing."""
    bools = F.array(F.lit("true"), F.lit("false"))
    cells = df.select(upload_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.trim(F.col(c)).alias("x")) for c in cols])).alias("c"))
    x = F.col("c.x")
    some = x.isNotNull()
    return (cells.groupBy(upload_col, F.col("c.column").alias("column")).agg(
        F.count(x).alias("n"), F.bool_and(~some | parses_as(x, "long")).alias("l"),
        F.bool_and(~some | parses_as(x, "double")).alias("d"),
        F.bool_and(~some | F.array_contains(bools, F.lower(x))).alias("b"))
        .select(upload_col, "column", F.when(F.col("n") == 0, "missing").when(F.col("l"), "long")
                .when(F.col("d"), "double").when(F.col("b"), "boolean")
                .otherwise("string").alias("kind")))


def with_upload_numbers(df: DataFrame, cols: Sequence[str], upload_col: str = "upload_id",
                        suffix: str = "_number") -> DataFrame:
    """Add ``<column>_number`` for each string column: its value as a double
    in the uploads where the whole column is numeric, null in the others, so
    one upload's bad value never changes another's numbers."""
    kinds = (upload_types(df, cols, upload_col).where(F.col("kind").isin("long", "double"))
             .groupBy(upload_col).agg(F.collect_set("column").alias("__numeric")))
    out = salted_join(df, kinds, [upload_col], how="left")
    return out.withColumns({c + suffix: F.when(F.array_contains("__numeric", F.lit(c)),
                                               F.trim(F.col(c)).try_cast("double"))
                            for c in cols}).drop("__numeric")


def infer_column_types(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Type string columns all-or-nothing (one aggregate job, one row back)."""
    strs = [f.name for f in df.schema.fields
            if f.name in cols and isinstance(f.dataType, T.StringType)]
    if not strs:
        return df
    bools = F.array(F.lit("true"), F.lit("false"))
    aggs = []
    for i, c in enumerate(strs):
        x = F.trim(df[f"`{c}`"])
        aggs += [F.bool_and(x.isNull() | parses_as(x, "long")).alias(f"l__{i}"),
                 F.bool_and(x.isNull() | parses_as(x, "double")).alias(f"d__{i}"),
                 F.bool_and(x.isNull() | F.array_contains(bools, F.lower(x))).alias(f"b__{i}"),
                 F.count(x).alias(f"n__{i}")]
    row = df.agg(*aggs).first()
    conv = {}
    for i, c in enumerate(strs):
        if not row[f"n__{i}"]:
            continue  # all missing: keep as string
        x = F.trim(df[f"`{c}`"])
        if row[f"l__{i}"]:
            conv[c] = x.try_cast("long")
        elif row[f"d__{i}"]:
            conv[c] = x.try_cast("double")
        elif row[f"b__{i}"]:
            conv[c] = F.lower(x) == F.lit("true")
    return df.withColumns(conv) if conv else df


def ingest_manifest(spark: SparkSession, paths: str | Sequence[str],
                    tenant_id: int | None = None) -> DataFrame:
    """One row per uploaded file: id, name, path, size, modification time,
    status 'uploaded' (read from file metadata, no data rows are parsed)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", CSV_GLOB)
             .load(paths).select("path", "length", "modificationTime"))
    return files.select(
        F.xxhash64("path").alias("upload_id"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("path").alias("file_path"), F.col("length").alias("file_size"),
        F.lit("text/csv").alias("mime_type"), F.lit("uploaded").alias("status"),
        F.lit(tenant_id).cast("long").alias("tenant_id"),
        F.col("modificationTime").alias("created_at"))

"""Table writers: analyses, run events, predictions, customer upserts,
CSV export and per-tenant replacement.  Every writer appends or replaces
whole partitions, so a retried task or job rewrites the same files instead
of duplicating rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators._util import keys, null_safe_join


def _writer(df: DataFrame, partition_cols: Sequence[str]):
    w = df.write
    p = keys(partition_cols)
    return w.partitionBy(*p) if p else w


def append_table(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> None:
    """Append rows (analyses, pipeline-run events, predictions)."""
    _writer(df, partition_cols).mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_cols: Sequence[str]) -> None:
    """Overwrite only the partitions present in ``df`` (e.g. one tenant's
    customers, or one micro-batch's output): idempotent under retries."""
    (df.write.option("partitionOverwriteMode", "dynamic").partitionBy(*keys(partition_cols))
     .mode("overwrite").parquet(path))


def analyses_rows(doc: DataFrame, upload_col: str = "upload_id") -> DataFrame:
    """Analysis documents as table rows: nested columns stay typed; the JSON
    text forms are added for consumers that want strings."""
    cols = [c for c in doc.columns if c != upload_col]
    return doc.select(upload_col, *cols,
                      *[F.to_json(F.col(c)).alias(f"{c}_json") for c in cols
                        if dict(doc.dtypes)[c].startswith(("struct", "map", "array"))],
                      F.current_timestamp().alias("created_at"))


def document_rows(doc: DataFrame, upload_col: str = "upload_id") -> DataFrame:
    """Analysis documents as (upload, document VARIANT, created_at): the
    document keeps its own fields and types, whatever analysis made it."""
    fields = F.struct(*[c for c in doc.columns if c != upload_col])
    return doc.select(upload_col, F.to_variant_object(fields).alias("document"),
                      F.current_timestamp().alias("created_at"))


def document_schema(documents: DataFrame) -> str:
    """The schema of all documents, read from the data by one aggregate."""
    return documents.agg(F.schema_of_variant_agg("document")).first()[0]


def latest_documents(documents: DataFrame, fields: dict[str, str], upload_col: str = "upload_id",
                     tie_col: str | None = None) -> DataFrame:
    """The latest document of each upload (ties: by ``tie_col``) with the
    fields picked by path, ``{"records": "$.record_count:long"}``; a field
    that a document lacks is null."""
    order = [F.col("created_at"), *([F.col(tie_col)] if tie_col else [])]
    last = documents.groupBy(upload_col).agg(F.max_by("document", F.struct(*order)).alias("document"))
    picked = {name: path.rsplit(":", 1) for name, path in fields.items()}
    return last.select(upload_col, *[F.try_variant_get("document", path, kind).alias(name)
                                     for name, (path, kind) in picked.items()])


def export_csv(df: DataFrame, path: str, date_cols: Sequence[str] = (),
               fmt: str = "yyyy-MM-dd") -> None:
    """CSV with a header; dates written as ``fmt``."""
    out = df.withColumns({c: F.date_format(c, fmt) for c in date_cols}) if date_cols else df
    out.write.mode("overwrite").option("header", True).csv(path)


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every required field present, and the others with a reason
    naming the first missing field."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    reason = F.lit(None).cast("string")
    for c in reversed(list(required)):
        reason = F.when(F.col(c).isNull(), F.lit(f"missing required field: {c}")).otherwise(reason)
    return df.where(ok), df.where(~ok).withColumn("reason", reason)


def new_rows_only(existing: DataFrame, incoming: DataFrame, key_cols: Sequence[str],
                  required: Sequence[str] = (), defaults: dict | None = None,
                  order_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Batch insert of records: required-field check, defaults for absent
    business fields, reject keys that already exist (anti-join) and all but
    one row of a key inside the batch: the first by ``order_cols`` (all other
    columns when not given).  Returns (accepted, rejected with a reason);
    together they hold every incoming row."""
    k = keys(key_cols)
    valid, rejected = split_valid(incoming, required)
    if defaults:
        valid = valid.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in valid.columns
                                   else F.lit(v) for c, v in defaults.items()})
    known = existing.select(*k)
    dup = null_safe_join(valid, known, k, "left_semi").withColumn(
        "reason", F.lit("already exists"))
    fresh = null_safe_join(valid, known, k, "left_anti")
    # aggregates on both sides: a key that fills the batch is no one task's
    order = [c for c in order_cols or () if c not in k]
    order += [c for c in fresh.columns if c not in (*k, *order)]
    accepted = fresh.distinct() if not order else (
        fresh.groupBy(*k).agg(F.min(F.struct(*order)).alias("__first"))
        .select(*[F.col(c) if c in k else F.col("__first")[c].alias(c) for c in fresh.columns]))
    again = fresh.exceptAll(accepted).withColumn("reason", F.lit("duplicate key in batch"))
    return (accepted,
            rejected.unionByName(dup, allowMissingColumns=True)
            .unionByName(again, allowMissingColumns=True))


def latest_analysis(analyses: DataFrame, upload_id=None, upload_col: str = "upload_id",
                    created_col: str = "created_at", json_schemas: dict | None = None
                    ) -> DataFrame:
    """Read analyses back: optionally one upload (a partition-prunable
    filter), the latest row per upload by ``created_col`` (``max_by``, no
    sort of all rows), and ``<col>_json`` text decoded with ``from_json``
    for the schemas given."""
    df = analyses if upload_id is None else analyses.where(F.col(upload_col) == upload_id)
    rest = [c for c in df.columns if c != upload_col]
    latest = (df.groupBy(upload_col).agg(F.max_by(F.struct(*rest), F.col(created_col))
                                         .alias("__r"))
              .select(upload_col, *[F.col(f"__r.{c}").alias(c) for c in rest]))
    for col, schema in (json_schemas or {}).items():
        latest = latest.withColumn(col, F.from_json(F.col(f"{col}_json"), schema))
    return latest

"""Structured Streaming ingest of newly arrived upload files.

The file source with a checkpoint sees every file exactly once across runs
(``Trigger.AvailableNow`` processes what has arrived and stops, a
``processingTime`` trigger polls like the hourly scheduler).  Each
micro-batch is analysed per upload in set-based jobs, and its outputs
replace the ``batch_id`` partition of the sink tables, so a replayed batch
rewrites instead of duplicating.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.sources import records
from mercato.sources.sinks import replace_partitions


def upload_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str | None = None,
                  fmt: str = "csv", glob: str | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of new files under ``source_dir``.

    CSV files come as text lines; :func:`run_ingest` binds them by each
    file's own header (``bind``).  Other formats come as rows of ``schema``
    (StructType or DDL; partition folders such as ``upload=...`` become
    columns) with ``upload_file`` / ``upload_id``."""
    if fmt == "csv":
        return records.line_stream(spark, source_dir, max_files_per_trigger)
    r = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob or "*")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.load(source_dir)
    return (df.select("*", F.col("_metadata.file_path").alias("upload_file"))
            .withColumn("upload_id", F.xxhash64("upload_file")))


def by_header(schema: T.StructType | str) -> Callable[[DataFrame], DataFrame]:
    """The ``bind`` of CSV lines to the columns of ``schema``, by name."""
    return lambda lines: records.bound(records.cells(lines), schema)


def run_status_rows(batch: DataFrame, batch_id: int, seq: int, status, message) -> DataFrame:
    """One run row per upload of ``batch``.  ``seq`` orders the rows of an
    upload within a batch; ``status`` and ``message`` are columns over
    (upload_id, rows)."""
    return (batch.groupBy("upload_id").agg(F.count(F.lit(1)).alias("rows"))
            .select("upload_id", status.alias("status"), message.alias("message"),
                    F.current_timestamp().alias("created_at"),
                    F.lit(batch_id).cast("long").alias("batch_id"), F.lit(seq).alias("seq")))


def failing_uploads(batch: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> dict:
    """upload_id -> reason for the uploads that can't be analysed on their
    own.  Called only after the analysis of the whole batch has failed; a
    batch has as many uploads as the trigger takes files."""
    reasons = {}
    for row in batch.select("upload_id").distinct().collect():
        own = batch.where(F.col("upload_id").eqNullSafe(F.lit(row["upload_id"])))
        try:
            analyse(own).write.format("noop").mode("overwrite").save()
        except Exception as error:
            reasons[row["upload_id"]] = str(error).split("\n")[0][:500]
    return reasons


def make_batch_handler(out_dir: str, analyse: Callable[[DataFrame], DataFrame],
                       bind: Callable[[DataFrame], DataFrame] | None = None):
    """foreachBatch handler: ``analyse`` turns the batch, as ``bind`` has
    read it, into one row per upload, written to ``out_dir``/analyses by
    batch id.

    ``out_dir``/pipeline_runs gets a ``started`` row per upload before the
    analysis (seq 0) and a ``completed`` or ``failed`` row after it (seq 1),
    the latter with the reason.  An upload that can't be analysed doesn't
    hold up the others of its batch; if each can be analysed alone but not
    all together, the error is raised and the batch runs again."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        # the batch is read by the run rows and by the analysis: keep it for
        # the duration of the handler (bounded by maxFilesPerTrigger; a lost
        # block is recomputed from the batch's files)
        batch = (bind(batch) if bind else batch).persist()
        runs = os.path.join(out_dir, "pipeline_runs")

        def write(rows: DataFrame) -> None:
            result = analyse(rows).withColumn("batch_id", F.lit(batch_id).cast("long"))
            replace_partitions(result, os.path.join(out_dir, "analyses"), ["batch_id"])

        try:
            replace_partitions(
                run_status_rows(batch, batch_id, 0, F.lit("started"),
                                F.concat(F.lit("analysis of "), F.col("rows").cast("string"),
                                         F.lit(" rows started"))), runs, ["batch_id", "seq"])
            reason = F.lit(None).cast("string")
            try:
                write(batch)
            except Exception:
                reasons = failing_uploads(batch, analyse)
                if not reasons:
                    raise
                good = batch
                for upload, why in reasons.items():
                    this = F.col("upload_id").eqNullSafe(F.lit(upload))
                    good = good.where(~this)
                    reason = F.when(this, F.lit(why)).otherwise(reason)
                if not good.isEmpty():
                    write(good)
            done = F.concat(F.lit("analysis of "), F.col("rows").cast("string"),
                            F.lit(" rows completed"))
            status = F.when(reason.isNull(), F.lit("completed")).otherwise(F.lit("failed"))
            replace_partitions(
                run_status_rows(batch, batch_id, 1, status, F.coalesce(reason, done)),
                runs, ["batch_id", "seq"])
        finally:
            batch.unpersist()
    return handle


def run_ingest(stream: DataFrame, out_dir: str, checkpoint: str,
               analyse: Callable[[DataFrame], DataFrame], available_now: bool = True,
               processing_time: str = "1 hour",
               bind: Callable[[DataFrame], DataFrame] | None = None):
    """Start the ingest query; a CSV stream needs its ``bind``.  ``available_now`` processes everything that
    has arrived and stops (call ``awaitTermination``); otherwise it polls
    every ``processing_time``."""
    w = (stream.writeStream.foreachBatch(make_batch_handler(out_dir, analyse, bind))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def upload_insights(batch: DataFrame, upload_col: str = "upload_id",
                    row_id_col: str | None = None) -> DataFrame:
    """Per-upload insight rows of one micro-batch (set-based: every upload of
    the batch in the same jobs): the insights document flattened to its
    counts plus the top items as a map."""
    from mercato.plans.insights_doc import insights

    doc = insights(batch, group_cols=[upload_col], row_id_col=row_id_col).document
    return doc.select(
        upload_col, F.col("summary.rows").alias("rows"),
        F.col("summary.last_order_date").alias("last_order_date"),
        F.col("insights.top_skus").alias("top_skus"),
        F.col("insights.churn_at_risk_count").alias("churn_at_risk_count"),
        F.col("insights.anomaly_count").alias("anomaly_count"))

"""The whole chain over newly arrived CSV uploads: preprocess, predict, and a
run row for every step of every upload.

Each micro-batch is bound by its files' headers and runs in set-based jobs,
however many uploads it has.  What fails is decided by upload, from its own
rows, and holds up no other:

====  ========================  ==============================================
seq   status                    when
====  ========================  ==============================================
0     started                   always
1     preprocessing_completed   the upload could be read
2     prediction_completed      it has the columns that the model needs
2     prediction_failed         it has them, but an order date is no date
3     completed / failed        at the end; failed: a row has more fields than
                                the header
====  ========================  ==============================================

Outputs (``documents``, ``predictions``, ``pipeline_runs``) replace the
partition of their batch, so a batch that runs again rewrites them.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.coerce import lenient_timestamp
from mercato.operators._util import null_safe_join
from mercato.plans.preprocess_uploads import preprocess_uploads
from mercato.session import written
from mercato.sources import records
from mercato.sources.sinks import document_rows, replace_partitions

# The columns without which an upload is not predicted.
NEEDED = ("sku", "quantity", "order_date")
INPUTS = "upload_id long, row long, sku string, quantity string, price string, order_date string"


def upload_checks(cells: DataFrame) -> DataFrame:
    """(upload_id, rows, wide_rows, predictable, bad_dates) of every upload."""
    has = F.lit(True)
    for c in NEEDED:
        has = has & F.array_contains(F.map_keys("cells"), F.lit(c))
    day = F.col("cells")["order_date"]
    return cells.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("beyond").alias("wide_rows"),
        F.bool_and(has).alias("predictable"),
        F.count_if(day.isNotNull() & lenient_timestamp(day).isNull()).alias("bad_dates"))


def run_rows(checks: DataFrame, documents: DataFrame, predicted: DataFrame) -> DataFrame:
    """The run rows of a batch: (upload_id, seq, status, message)."""
    done = null_safe_join(null_safe_join(checks, documents.select(
        "upload_id", "record_count", "anomaly_count"), ["upload_id"], "left"),
        predicted.groupBy("upload_id").agg(F.count(F.lit(1)).alias("predictions")),
        ["upload_id"], "left")
    failed, bad = F.col("wide_rows") > 0, F.col("bad_dates") > 0

    def row(seq: int, when: Column, status: str, *message) -> Column:
        parts = [F.lit(m) if isinstance(m, str) else m.cast("string") for m in message]
        return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(status).alias("status"),
                                     F.concat(*parts).alias("message")))

    steps = [
        row(0, F.lit(True), "started", F.col("rows"), " rows arrived"),
        row(1, ~failed, "preprocessing_completed", "records: ", F.col("record_count"),
            ", anomalies: ", F.col("anomaly_count")),
        row(2, ~failed & F.col("predictable") & ~bad, "prediction_completed",
            F.coalesce("predictions", F.lit(0)), " predictions"),
        row(2, ~failed & F.col("predictable") & bad, "prediction_failed",
            F.col("bad_dates"), " order dates can't be read"),
        row(3, ~failed, "completed", "all steps done"),
        row(3, failed, "failed", F.col("wide_rows"), " rows have more fields than the header")]
    return done.select("upload_id", F.explode(F.filter(F.array(*steps), F.isnotnull)).alias("s")
                       ).select("upload_id", "s.*")


def chain_handler(out_dir: str, predict: Callable[[DataFrame], DataFrame],
                  name: Column | None = None, strict: bool = True):
    """foreachBatch handler over text lines.  ``predict`` turns rows of
    ``INPUTS`` (text, as uploaded) into predictions that keep upload_id and
    row; ``name`` makes the upload id from upload_file (a hash by default)."""
    def handle(lines: DataFrame, batch_id: int) -> None:
        cells = records.cells(lines)
        if name is not None:
            cells = cells.withColumn("upload_id", name)
        cells = written(records.with_row_numbers(cells, upload="upload_id")
                        .select("upload_id", "row", "cells", "beyond"))
        checks = written(upload_checks(cells))
        good = checks.where("wide_rows = 0").select("upload_id")
        documents = written(preprocess_uploads(
            null_safe_join(cells, good, ["upload_id"], "left_semi"), "upload_id", strict))
        ready = checks.where("wide_rows = 0 AND predictable AND bad_dates = 0").select("upload_id")
        inputs = null_safe_join(cells, ready, ["upload_id"], "left_semi").select(
            "upload_id", "row", *[F.col("cells")[c].alias(c)
                                  for c in ("sku", "quantity", "price", "order_date")])
        predicted = written(predict(inputs))
        stamp = {"batch_id": F.lit(batch_id).cast("long")}
        for table, rows in (("documents", document_rows(documents)), ("predictions", predicted),
                            ("pipeline_runs", run_rows(checks, documents, predicted)
                             .withColumn("created_at", F.current_timestamp()))):
            replace_partitions(rows.withColumns(stamp), os.path.join(out_dir, table), ["batch_id"])
    return handle


def run_chain(stream: DataFrame, out_dir: str, checkpoint: str,
              predict: Callable[[DataFrame], DataFrame], name: Column | None = None):
    """Process everything that has arrived (the stream of
    :func:`mercato.sources.records.line_stream`) and stop."""
    return (stream.writeStream.foreachBatch(chain_handler(out_dir, predict, name))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

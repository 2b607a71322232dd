"""Ingest metrics: what each batch wrote, kept under the checkpoint of its stream.

A batch that is in the lake has a file with its numbers in ``done``, a failure one in ``failed``.
They outlive the job, and compaction and retention of the lake do not change them.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logspark.sources.files import file_system, path_exists, path_of

_PROGRESS = "batch_id bigint, entries bigint, entries_per_ms double, duration_ms bigint, error string"
_METRICS = "batch_id bigint, entries bigint, files bigint, bytes bigint, duration_ms bigint, error string"


def query_progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per micro-batch that a running query still reports (the last hundred): the rows it took in."""
    failure = query.exception()
    rows = [
        (
            report["batchId"],
            report["numInputRows"],
            float(report["processedRowsPerSecond"] or 0.0) / 1000.0,
            int(report["durationMs"].get("triggerExecution", 0)),
            None if failure is None else str(failure),
        )
        for report in query.recentProgress
    ]
    return spark.createDataFrame(rows, _PROGRESS)


def record_metrics(spark: SparkSession, path: str, **numbers) -> None:
    out = file_system(spark, path).create(path_of(spark, path), True)
    try:
        out.write(bytearray(json.dumps(numbers) + "\n", "utf-8"))
    finally:
        out.close()


def read_metrics(spark: SparkSession, path: str) -> bool:
    """Whether a whole record lies at ``path``; one that was cut short does not count."""
    files = file_system(spark, path)
    if not files.exists(path_of(spark, path)):
        return False
    data = files.open(path_of(spark, path))
    try:
        return bytes(data.readAllBytes()).endswith(b"\n")
    finally:
        data.close()


def record_failure(spark: SparkSession, checkpoint: str, batch_id: int, error: Exception) -> None:
    failed = f"{checkpoint}/failed/{int(time.time() * 1000)}-{uuid.uuid4().hex}"
    record_metrics(spark, failed, batch_id=batch_id, error=f"{type(error).__name__}: {error}")


def export_metrics(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per batch in the lake, with its entries, files, bytes and time, and one per failure.

    A batch without rows counts; a failed one is listed with its error, and again once it went through.
    """
    folders = [f"{checkpoint}/{name}" for name in ("done", "failed")]
    folders = [folder for folder in folders if path_exists(spark, folder)]
    if not folders:
        return spark.createDataFrame([], _METRICS)
    return spark.read.schema(_METRICS).json(folders)


def export_totals(metrics: DataFrame) -> DataFrame:
    """One row: exports, entries, files, bytes, entries a millisecond, failures."""
    fine = F.col("error").isNull()
    total = lambda name: F.coalesce(F.sum(F.when(fine, F.col(name))), F.lit(0))
    return metrics.agg(
        F.count_if(fine & (F.col("entries") > 0)).alias("exports"),
        *[total(name).alias(name) for name in ("entries", "files", "bytes")],
        F.try_divide(total("entries"), total("duration_ms")).alias("entries_per_ms"),
        F.count_if(~fine).alias("failures"),
    )

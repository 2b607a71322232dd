"""Distinct values, time ranges and lake statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.operators.filters import distinct_column, non_empty


def distinct_values(logs: DataFrame, column: str, limit: int) -> DataFrame:
    """(column, value): non-empty values in order, the first ``limit``."""
    name = distinct_column(column)
    return (
        logs.where(non_empty(name))
        .select(F.lit(name).alias("column"), F.col(name).alias("value"))
        .distinct()
        .orderBy("value")
        .limit(limit)
    )


def time_range(logs: DataFrame) -> DataFrame:
    """One row: oldest, newest and the seconds between them."""
    return _with_seconds(logs.agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest")))


def stream_time_range(logs: DataFrame) -> DataFrame:
    """The time range of every stream."""
    ranges = logs.groupBy("stream").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    return _with_seconds(ranges)


def _with_seconds(ranges: DataFrame) -> DataFrame:
    span = F.timestamp_diff("MICROSECOND", F.col("oldest"), F.col("newest"))
    return ranges.withColumn("seconds", (span / F.lit(1_000_000)).cast("double"))


def lake_stats(logs: DataFrame, exact: bool = True) -> DataFrame:
    """One row: records, time range and distinct processes, sources, levels.

    A missing process counts as one value, a missing source or level as none.
    The exact form first reduces the rows to their (process, source, level)
    combinations, so the distinct counts never expand the raw rows; the other
    form is a single pass of sketches for lakes where those are too many.
    """
    process = F.coalesce(F.col("process"), F.lit("")).alias("process")
    rows = logs.select("ts", process, "source", "level")
    if not exact:
        return rows.agg(
            F.count("*").alias("total_records"),
            F.min("ts").alias("oldest"),
            F.max("ts").alias("newest"),
            F.approx_count_distinct("process").alias("unique_processes"),
            F.approx_count_distinct("source").alias("unique_sources"),
            F.approx_count_distinct("level").alias("unique_levels"),
        )
    combinations = rows.groupBy("process", "source", "level").agg(
        F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")
    )
    return combinations.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
        F.countDistinct("process").alias("unique_processes"),
        F.countDistinct("source").alias("unique_sources"),
        F.countDistinct("level").alias("unique_levels"),
    )


def stream_list(logs: DataFrame) -> DataFrame:
    """Stream names, hidden ones left out."""
    return logs.select("stream").distinct().where(~F.startswith("stream", F.lit(".")))


def lake_size(inventory: DataFrame) -> DataFrame:
    """One row: number of files and their bytes."""
    return inventory.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_size_bytes"),
    )


def folder_info(inventory: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Per stream: files, bytes, years, files per year and the time range.

    ``inventory`` has stream, dt and length.
    """
    by_year = inventory.groupBy("stream", F.year("dt").alias("year")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")
    )
    info = by_year.groupBy("stream").agg(
        F.sum("files").alias("total_files"),
        F.sum("bytes").alias("total_size_bytes"),
        # one entry per year of one stream
        F.array_sort(F.collect_list(F.struct("year", "files"))).alias("by_year"),
    )
    info = info.select(
        "stream",
        "total_files",
        "total_size_bytes",
        F.col("by_year.year").alias("years"),
        F.map_from_entries("by_year").alias("files_per_year"),
    )
    if logs is None:
        return info
    return info.join(stream_time_range(logs).drop("seconds"), "stream", "left")


def stream_folder_info(
    inventory: DataFrame, stream: str, logs: DataFrame | None = None
) -> DataFrame:
    """folder_info of one stream; raises when the stream has no files."""
    files = inventory.where(F.col("stream") == stream)
    if files.isEmpty():
        raise ValueError(f"process '{stream}' not found")
    return folder_info(files, None if logs is None else logs.where(F.col("stream") == stream))

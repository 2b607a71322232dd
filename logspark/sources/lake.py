"""The lake: logs as Parquet, partitioned by stream, event day and event hour."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from logspark.functions.text import blank_to_null
from logspark.functions.times import to_utc
from logspark.operators.entries import storage_rows
from logspark.runtime import session_conf
from logspark.schema import LAKE_SCHEMA, LOG_COLUMNS, LOG_SCHEMA, PARTITION_COLUMNS
from logspark.sources.files import file_system, path_exists
from logspark.sources.publication import live_files, metadata_path

# Millisecond timestamps carry Parquet statistics, so a scan skips row groups
# outside the time bounds; Spark's default timestamp format does not.
_WRITE_SETTINGS = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MILLIS"}


def lake_rows(rows: DataFrame, collector: str = "default") -> DataFrame:
    """Log rows in storage form with their partition columns, taken from ``ts``."""
    stream = F.coalesce(blank_to_null(F.col("source")), F.lit(collector))
    if "stream" in rows.columns:
        stream = F.coalesce(blank_to_null(F.col("stream")), stream)
    return storage_rows(rows).select(
        *[
            F.col(name).cast(LOG_SCHEMA[name].dataType).alias(name)
            for name in LOG_COLUMNS
        ],
        stream.alias("stream"),
        *utc_partition(F.col("ts"), rows.schema["ts"].dataType.typeName()),
    )


def utc_partition(ts: Column, kind: str) -> list[Column]:
    """dt and hour of a time in UTC, whatever zone the session has."""
    if kind == "timestamp_ntz":
        return [F.to_date(ts).alias("dt"), F.hour(ts).alias("hour")]
    seconds = F.unix_seconds(ts)
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    return [day.alias("dt"), F.pmod(F.floor(seconds / 3600), F.lit(24)).cast("int").alias("hour")]


def write_lake(rows: DataFrame, root: str, collector: str = "default") -> None:
    """Append rows to the lake.

    Rebalancing brings each hour partition into few files and splits one that
    is too large for a task, so neither a hot stream nor many small ones hurt. It is
    adaptive execution's doing, which streams switch off for their batches: without it the hint
    would be dropped, and every task would write a file into every partition.
    """
    with session_conf(rows.sparkSession, {"spark.sql.adaptive.enabled": "true"}):
        write_sorted(lake_rows(rows, collector).hint("rebalance", *PARTITION_COLUMNS), root)


def write_sorted(clustered: DataFrame, root: str) -> None:
    """Append files sorted by time inside each partition."""
    with session_conf(clustered.sparkSession, _WRITE_SETTINGS):
        (
            clustered.sortWithinPartitions(*PARTITION_COLUMNS, "ts")
            .write.mode("append")
            .option("compression", "zstd")
            .partitionBy(*PARTITION_COLUMNS)
            .parquet(root)
        )


def read_lake(
    spark: SparkSession,
    root: str,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    stream: str = "",
) -> DataFrame:
    """The lake, or the folders of it that a time range and a stream can reach.

    With both bounds only the folders of those days (of those hours, within one
    day) are listed; a long range lists by month. The rows are still to be
    filtered: predicates on stream, dt and hour prune partitions, those on ts row
    groups. An empty or missing lake has no rows. Of files that compaction is replacing, the old
    or the new ones are read.
    """
    folders = [root]
    if start is not None and end is not None or stream:
        folders = reachable_folders(spark, root, start, end, stream)
    if not folders or not path_exists(spark, root):
        return spark.createDataFrame([], LAKE_SCHEMA)
    return read_folders(spark, root, folders)


def read_folders(spark: SparkSession, root: str, folders: Sequence[str]) -> DataFrame:
    """The files that count below some folders of a lake."""
    return live_files(spark, root, lambda: read_files(spark, root, folders), metadata_path)


def reachable_folders(
    spark: SparkSession, root: str, start: dt.datetime | None, end: dt.datetime | None, stream: str = ""
) -> list[str]:
    """Existing partition folders of a time range (bounds included) and a stream.

    One lookup of the streams, and one of their days or hours, whatever else the
    lake holds.
    """
    if start is not None and end is not None and to_utc(start) > to_utc(end):
        return []
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    pattern = f"{root}/stream=" + (_plain_glob(escape(stream)) if stream else "*")
    if start is not None and end is not None:
        pattern += "/" + _time_glob(to_utc(start), to_utc(end))
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = file_system(spark, root).globStatus(path)
    return [status.getPath().toString() for status in found or []]


def _plain_glob(text: str) -> str:
    return "".join(f"\\{char}" if char in "*?[]{}\\," else char for char in text)


def _time_glob(start: dt.datetime, end: dt.datetime) -> str:
    """A pattern of day (and hour) folders that holds every hour of the range."""
    days = (end.date() - start.date()).days + 1
    if days == 1:
        hours = ",".join(str(hour) for hour in range(start.hour, end.hour + 1))
        return f"dt={start.date()}/hour={{{hours}}}"
    if days <= 62:
        return "dt={" + ",".join(str(start.date() + dt.timedelta(at)) for at in range(days)) + "}"
    months = (end.year - start.year) * 12 + end.month - start.month + 1
    if months > 240:
        return "dt=*"
    places = [divmod(start.year * 12 + start.month - 1 + at, 12) for at in range(months)]
    return "dt={" + ",".join(f"{year:04d}-{month + 1:02d}-*" for year, month in places) + "}"


def partition_folder(spark: SparkSession, row: Row) -> str:
    """The folder of a partition, relative to the lake."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return "/".join(f"{name}={escape(str(row[name]))}" for name in PARTITION_COLUMNS)


def read_files(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """Exactly the listed data files or folders, with their partition columns."""
    return spark.read.schema(LAKE_SCHEMA).option("basePath", root).parquet(*paths)


def read_foreign_lake(spark: SparkSession, root: str) -> DataFrame:
    """A lake laid out as ``<stream>/year=/month=/day=/hour=/*.parquet``.

    Its first folder level is a bare name, which partition discovery refuses,
    so stream, dt and hour come from the file path. They do not prune; write
    the result with ``write_lake`` once.
    """
    if not path_exists(spark, root):
        return spark.createDataFrame([], LAKE_SCHEMA)
    rows = (
        spark.read.schema(LOG_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(root)
    )
    path = F.col("_metadata.file_path")
    return rows.select(*LOG_COLUMNS, *foreign_partition(path))


def foreign_partition(path: Column) -> list[Column]:
    """stream, dt and hour out of a foreign file path."""
    pattern = r"([^/]+)/year=(\d+)/month=(\d+)/day=(\d+)/hour=(\d+)/[^/]+$"
    part = lambda at: F.regexp_extract(path, pattern, at)
    day = F.concat_ws("-", part(2), part(3), part(4))
    return [
        F.url_decode(F.replace(part(1), F.lit("+"), F.lit("%2B"))).alias("stream"),
        day.try_cast("date").alias("dt"),
        part(5).try_cast("int").alias("hour"),
    ]

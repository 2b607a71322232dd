"""File inventories: path, length and modification time of data files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.sources.files import path_exists
from logspark.sources.lake import foreign_partition, reachable_folders
from logspark.sources.publication import live_files

INVENTORY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("stream", T.StringType()),
        T.StructField("dt", T.DateType()),
        T.StructField("hour", T.IntegerType()),
    ]
)


def file_inventory(
    spark: SparkSession,
    root: str,
    foreign: bool = False,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    stream: str = "",
) -> DataFrame:
    """One row per Parquet file under the lake; file contents are not read.
    Files that compaction has replaced, or has not published yet, do not count.

    With time bounds or a stream only the folders they reach are listed.
    """
    folders = [root] if path_exists(spark, root) else []
    if folders and (start is not None and end is not None or stream):
        folders = reachable_folders(spark, root, start, end, stream)
    if not folders:
        return spark.createDataFrame([], INVENTORY_SCHEMA)
    listed = lambda: stored_files(spark, folders)
    files = listed() if foreign else live_files(spark, root, listed, lambda: F.col("path"))
    place = foreign_partition(F.col("path")) if foreign else _partition(F.col("path"))
    return files.select("path", "length", "mtime", *place)


def stored_files(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Every Parquet file on disk below the folders, whether it counts or not."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(list(folders))
        .select("path", "length", F.col("modificationTime").alias("mtime"))
    )


def _partition(path: Column) -> list[Column]:
    pattern = r"/stream=([^/]+)/dt=(\d+-\d+-\d+)/hour=(\d+)/[^/]+$"
    part = lambda at: F.regexp_extract(path, pattern, at)
    # Folder names escape some characters as %XX and keep a plus sign.
    stream = F.url_decode(F.replace(part(1), F.lit("+"), F.lit("%2B")))
    return [
        stream.alias("stream"),
        part(2).try_cast("date").alias("dt"),
        part(3).try_cast("int").alias("hour"),
    ]

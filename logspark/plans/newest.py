"""The newest rows of every stream of a lake, without reading all of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.operators.filters import time_between
from logspark.operators.sessions import PER_STREAM, newest_per_stream
from logspark.runtime import cut_lineage
from logspark.schema import LAKE_SCHEMA, PARTITION_COLUMNS
from logspark.sources.inventory import file_inventory
from logspark.sources.lake import partition_folder, read_folders


def newest_in_lake(
    spark: SparkSession,
    root: str,
    count: int = PER_STREAM,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    condition: Column | None = None,
) -> DataFrame:
    """``newest_per_stream`` over the lake's rows of a time range that meet ``condition``.

    The hours of each stream are walked backwards, one, then two, then four more, until it has
    ``count`` rows or no hours left; a stream that is done is read no further. So at most
    twice the hours that hold its newest rows are read, in as many rounds as the logarithm of the
    longest walk. A round counts its own hours alone, from file footers where nothing is
    filtered. The driver holds the folders read and a number for each stream.
    """
    bounded = start is not None and end is not None

    def rows_of(folders: list[str]) -> DataFrame:
        rows = read_folders(spark, root, folders)
        rows = rows.where(time_between(rows, start, end)) if bounded else rows
        return rows if condition is None else rows.where(condition)

    hours = file_inventory(spark, root, start=start, end=end).select(*PARTITION_COLUMNS).distinct()
    backwards = Window.partitionBy("stream").orderBy(F.desc("dt"), F.desc("hour"))
    hours = cut_lineage(hours.withColumn("back", F.row_number().over(backwards)))
    found, read, taken, step = {}, [], 0, 1
    while True:
        done = spark.createDataFrame([(s,) for s, rows in found.items() if rows >= count], "stream string")
        band = hours.where((F.col("back") > taken) & (F.col("back") <= taken + step))
        places = band.join(done, "stream", "left_anti").collect()
        if not places:
            break
        folders = [f"{root}/{partition_folder(spark, place)}" for place in places]
        for row in rows_of(folders).groupBy("stream").count().collect():
            found[row["stream"]] = found.get(row["stream"], 0) + row["count"]
        read += folders
        taken, step = taken + step, step * 2
    if not read:
        return spark.createDataFrame([], LAKE_SCHEMA)
    return newest_per_stream(rows_of(read), count)

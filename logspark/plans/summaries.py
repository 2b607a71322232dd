"""Statistics kept beside a lake, one row per data file, so that they are read without its log rows.

Data files never change: what is known of one holds as long as it is in the lake. Statistics
are those of the files that count now, so compaction and retention need not touch the
summaries; rows of files that are gone join with nothing. A file that came in since the last
``summarise_lake`` is read on the spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.sources.files import path_exists
from logspark.sources.inventory import file_inventory
from logspark.sources.lake import read_files
from logspark.sources.publication import metadata_path, place_in_lake

SUMMARIES = "_summaries"
# Sketches of 2**12 registers: a relative standard error of 1.6 %, exact for a handful of values.
LG_REGISTERS = 12
_SCHEMA = (
    "place string, records bigint, oldest timestamp, newest timestamp,"
    " processes binary, sources binary, levels binary"
)
# Files that one job summarises.
_FILES_A_JOB = 20_000


def summarise_lake(spark: SparkSession, root: str) -> int:
    """Summarise the files that have no summary yet; returns how many there were.

    To be called after batches, compaction or retention, or on a schedule. A run that stops
    midway has kept whole rows; one that runs twice at a time repeats rows, which
    count once. The driver holds the paths of the new files.
    """
    paths = [row["path"] for row in _files(spark, root, known=False).select("path").collect()]
    for first in range(0, len(paths), _FILES_A_JOB):
        part = paths[first : first + _FILES_A_JOB]
        _summaries_of(spark, root, part).write.mode("append").parquet(f"{root}/{SUMMARIES}")
    return len(paths)


def kept_stats(spark: SparkSession, root: str, by_stream: bool = False) -> DataFrame:
    """The columns of ``lake_stats`` out of the summaries, in one row or one per stream.

    Records and times are exact, the numbers of distinct values estimates. A missing process
    counts as one value, a missing source or level as none. A lake without rows has one row of
    zeros and nulls, and none by stream.
    """
    rows = _files(spark, root, known=True)
    new = [row["path"] for row in _files(spark, root, known=False).select("path").collect()]
    if new:
        places = file_inventory(spark, root).select(place_in_lake(F.col("path")).alias("place"), "stream")
        rows = rows.unionByName(_summaries_of(spark, root, new).join(places, "place"), allowMissingColumns=True)
    distinct = lambda name: F.coalesce(
        F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0).cast("bigint")
    )
    return rows.groupBy(*(["stream"] if by_stream else [])).agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
        distinct("processes").alias("unique_processes"),
        distinct("sources").alias("unique_sources"),
        distinct("levels").alias("unique_levels"),
    )


def _files(spark: SparkSession, root: str, known: bool) -> DataFrame:
    """The files that count: those with a summary, together with it, or those without."""
    place = place_in_lake(F.col("path")).alias("place")
    files = file_inventory(spark, root).select("path", "stream", place)
    folder = f"{root}/{SUMMARIES}"
    if path_exists(spark, folder):
        kept = spark.read.schema(_SCHEMA).parquet(folder)
    else:
        kept = spark.createDataFrame([], _SCHEMA)
    if known:
        return files.join(kept.dropDuplicates(["place"]), "place")
    return files.join(kept, "place", "left_anti")


def _summaries_of(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """One row for each file; a file without rows has none."""
    # Sketches pass over empty texts, which are values here.
    marked = lambda column, name: F.concat(F.lit("="), column).alias(name)
    rows = read_files(spark, root, paths).select(
        place_in_lake(metadata_path()).alias("place"),
        "ts",
        marked(F.coalesce("process", F.lit("")), "process"),
        marked(F.col("source"), "source"),
        marked(F.col("level"), "level"),
    )
    return rows.groupBy("place").agg(
        F.count("*").alias("records"),
        F.min("ts").alias("oldest"),
        F.max("ts").alias("newest"),
        F.hll_sketch_agg("process", LG_REGISTERS).alias("processes"),
        F.hll_sketch_agg("source", LG_REGISTERS).alias("sources"),
        F.hll_sketch_agg("level", LG_REGISTERS).alias("levels"),
    )

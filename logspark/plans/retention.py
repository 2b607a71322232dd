"""Retention: which files to delete, and deleting them.

An inventory has stream, path, length and mtime. Files are taken oldest first,
ties by path.
"""

from __future__ import annotations

import datetime as dt
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.times import to_utc
from logspark.operators.filters import timestamp_literal
from logspark.plans.compaction import GRACE
from logspark.plans.ranking import running_totals
from logspark.runtime import cut_lineage
from logspark.schema import PARTITION_COLUMNS
from logspark.sources.files import file_system, in_parallel, path_exists, path_of
from logspark.sources.folders import only_run, refuse_sink
from logspark.sources.inventory import file_inventory, stored_files
from logspark.sources.lake import read_files, reachable_folders, write_sorted
from logspark.sources.publication import (
    STAGING,
    finish_runs,
    folder_in_lake,
    metadata_path,
    place_in_lake,
    replace_files,
)

# Partition folders on their way out, below the lake.
_DROPPED = "_dropped"


@dataclass(frozen=True)
class RetentionPolicy:
    """Defaults: 30 days, at least 10 files and 10 GB per stream."""

    days: int = 30
    keep_min: int = 10
    max_bytes: int = 10 * 1024**3


def retention_plan(inventory: DataFrame, now: Column, policy: RetentionPolicy) -> DataFrame:
    """The inventory with ``by_age`` and ``by_size``: why a file goes, if it goes.

    By age: older than the limit while more than ``keep_min`` files remain. By
    size: when a stream exceeds the byte limit, its further oldest files until
    the excess is covered, again keeping ``keep_min``; bytes freed by age do not
    count towards the excess.
    """
    ranked = running_totals(
        inventory, "stream", ["mtime", "path"], {"files": "CAST(1 AS bigint)", "bytes": "length"}
    )
    cutoff = now - F.expr(f"INTERVAL {policy.days} DAYS")
    left = F.col("files_total") - F.col("files")
    by_age = (left > policy.keep_min) & (F.col("mtime") < cutoff)
    aged = ranked.withColumn("by_age", by_age)
    if policy.max_bytes <= 0:
        return aged.select(*inventory.columns, "by_age", F.lit(False).alias("by_size"))
    # Age takes the oldest files, so the others keep their order.
    taken = aged.groupBy("stream").agg(
        F.sum(F.when(F.col("by_age"), F.col("length")).otherwise(0)).alias("aged_bytes")
    )
    excess = F.col("bytes_total") - F.lit(policy.max_bytes)
    by_size = (
        ~F.col("by_age")
        & (excess > 0)
        & (F.col("bytes") - F.col("aged_bytes") < excess)
        & (left - 1 >= policy.keep_min)
    )
    same = F.col("f.stream").eqNullSafe(F.col("t.stream"))
    both = aged.alias("f").join(taken.alias("t"), same).select("f.*", "aged_bytes")
    return both.select(*inventory.columns, "by_age", by_size.alias("by_size"))


def doomed(plan: DataFrame) -> DataFrame:
    return plan.where("by_age OR by_size")


def kept(plan: DataFrame) -> DataFrame:
    return plan.where("NOT (by_age OR by_size)")


def retention_totals(plan: DataFrame) -> DataFrame:
    """Per stream: files scanned and deleted, bytes deleted."""
    goes = F.col("by_age") | F.col("by_size")
    return plan.groupBy("stream").agg(
        F.count("*").alias("files_scanned"),
        F.count_if(goes).alias("files_deleted"),
        F.sum(F.when(goes, F.col("length")).otherwise(0)).alias("bytes_deleted"),
    )


def force_clean_plan(inventory: DataFrame, now: Column, age: dt.timedelta) -> DataFrame:
    """Every file older than ``age``, whatever remains."""
    seconds = int(age.total_seconds())
    return inventory.where(F.col("mtime") < now - F.expr(f"INTERVAL {seconds} SECONDS"))


def row_retention(logs: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    """Rows young enough to stay; older day partitions are not read."""
    oldest = now - dt.timedelta(days=days)
    young = F.col("ts") >= timestamp_literal(logs, oldest)
    if "dt" in logs.columns:
        young = young & (F.col("dt") >= F.lit(oldest.date()))
    return logs.where(young)


def delete_files(spark: SparkSession, root: str, files: DataFrame, dry_run: bool = False) -> int:
    """Delete a lake's files of a plan; returns how many there were.

    A partition whose files on disk all go is dropped as a folder; the rest go file by file, many at a
    time, and the driver holds a few thousand paths. Deleting again what is already
    gone is harmless, so a failed run can simply be repeated. One run at a time.
    """
    refuse_sink(spark, root, "clean")
    if dry_run:
        return files.count()
    if not path_exists(spark, root):
        return 0
    _finish_drops(spark, root)
    place = folder_in_lake(F.col("path")).alias("folder")
    name = F.element_at(F.split("path", "/"), -1)
    mark = [F.count("*").alias("files"), F.sum(F.crc32(name)).alias("mark")]
    going = files.select("path", place)
    stored = stored_files(spark, [root]).groupBy(place).agg(*mark)
    # Both uses must see the same files, whatever is deleted in between.
    whole = cut_lineage(going.groupBy("folder").agg(*mark).join(stored, ["folder", "files", "mark"], "left_semi"))
    rest = cut_lineage(going.join(whole, "folder", "left_anti").select("path"))
    gone = []
    in_parallel(lambda row: gone.append(_drop(spark, root, row["folder"], row["mark"])), whole.toLocalIterator())
    system = file_system(spark, root)
    paths = (row["path"] for row in rest.toLocalIterator())
    return sum(gone) + in_parallel(lambda path: system.delete(path_of(spark, path), False), paths)


def _drop(spark: SparkSession, root: str, folder: str, mark: int) -> int:
    """Drop a partition folder that should hold the files of ``mark``; returns how many went.

    The folder is put aside first, so a file that comes in meanwhile lands in a new one. If
    it holds other files than planned, one has come in since: all go back, for a later run.
    """
    aside = f"{root}/{_DROPPED}/{uuid.uuid4().hex}-{mark}/{folder}"
    system = file_system(spark, root)
    system.mkdirs(path_of(spark, aside).getParent())
    if not system.rename(path_of(spark, f"{root}/{folder}"), path_of(spark, aside)):
        return 0
    return _settle(spark, root, aside)


def _settle(spark: SparkSession, root: str, aside: str) -> int:
    """Delete a folder that was put aside, or bring its files back."""
    system = file_system(spark, root)
    run, *place = aside.rsplit("/", 3)
    found = [status.getPath() for status in system.listStatus(path_of(spark, aside))]
    found = [path for path in found if path.getName().endswith(".parquet")]
    planned = sum(zlib.crc32(path.getName().encode()) for path in found) == int(run.rsplit("-", 1)[1])
    if not planned:
        back = "/".join([root, *place])
        system.mkdirs(path_of(spark, back))
        for path in found:
            if not system.rename(path, path_of(spark, f"{back}/{path.getName()}")):
                raise OSError(f"could not put {path} back")
    system.delete(path_of(spark, run), True)
    return len(found) if planned else 0


def _finish_drops(spark: SparkSession, root: str) -> None:
    """Take up folders that a run which died had put aside."""
    system = file_system(spark, root)
    top = path_of(spark, f"{root}/{_DROPPED}")
    if not system.exists(top):
        return
    for run in system.listStatus(top):
        place = run.getPath().toString()
        inside = system.globStatus(path_of(spark, f"{place}/" + "/".join(f"{name}=*" for name in PARTITION_COLUMNS)))
        for status in inside or []:
            _settle(spark, root, status.getPath().toString())
        system.delete(run.getPath(), True)


def apply_row_retention(
    spark: SparkSession,
    root: str,
    now: dt.datetime,
    days: int = 30,
    takeover: bool = False,
    grace: dt.timedelta = GRACE,
) -> None:
    """Leave only the rows of a lake that ``row_retention`` keeps.

    Hours that are too old as a whole are dropped as folders, unread. Of all others only the one that
    holds both old and young rows is rewritten, in every stream, and published in one
    step as compaction does it; the marker of maintenance runs keeps both apart.
    """
    refuse_sink(spark, root, "clean")
    if not path_exists(spark, root):
        return
    oldest = to_utc(now) - dt.timedelta(days=days)
    border = oldest.replace(minute=0, second=0, microsecond=0)
    with only_run(spark, f"{root}/{STAGING}/_running", takeover):
        finish_runs(spark, root, grace.total_seconds())
        hour = F.struct("dt", "hour")
        at = F.struct(F.lit(border.date()).alias("dt"), F.lit(border.hour).alias("hour"))
        files = file_inventory(spark, root)
        delete_files(spark, root, files.where(hour < at))
        if oldest == border:
            return
        mixed = cut_lineage(
            file_inventory(spark, root, start=border, end=border).where(hour == at).select("path")
        )
        if mixed.isEmpty():
            return
        places = mixed.select(place_in_lake(F.col("path")).alias("_place"))

        def write(folder: str) -> None:
            rows = read_files(spark, root, reachable_folders(spark, root, border, border))
            rows = rows.withColumn("_place", place_in_lake(metadata_path()))
            rows = rows.join(places, "_place", "left_semi").drop("_place")
            young = rows.where(F.col("ts") >= timestamp_literal(rows, oldest))
            write_sorted(young.hint("rebalance", *PARTITION_COLUMNS), folder)

        replace_files(spark, root, uuid.uuid4().hex, mixed, write)
        finish_runs(spark, root, grace.total_seconds())

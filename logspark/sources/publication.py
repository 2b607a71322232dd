"""Which files of a lake count while a maintenance run replaces some by others.

A run has a folder below ``_compaction`` from before its first file comes into the lake until
after the last file it replaces is gone; the folder lists the replaced files. The run's own
files bear its name. Until the run is committed they do not count; from then on the replaced
ones do not. Committing creates one empty file, so a reader sees the old files or the new ones
of all partitions of a run and never both. Replaced files stay for a while after that,
for readers that planned before; when they are gone the folder goes, and nothing is left to look up.

A reader looks the runs up, lists files, and looks the runs up again: if they changed in
between, it lists anew.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.schema import PARTITION_COLUMNS
from logspark.sources.files import file_system, in_parallel, path_of

STAGING = "_compaction"
PREFIX = "compacted_"
_COMMITTED = "_committed"
# Replaced files named in a filter, which prunes them from the scan; more are left out by a join.
LITERALS = 500
_TRIES = 20


@dataclass(frozen=True)
class Runs:
    pending: frozenset[str]
    committed: frozenset[str]


def run_folder(root: str, run: str) -> str:
    return f"{root}/{STAGING}/{run}"


def runs_of(spark: SparkSession, root: str) -> Runs:
    """The runs whose files or whose replaced files must be left out."""
    files, staging = file_system(spark, root), path_of(spark, f"{root}/{STAGING}")
    pending, committed = set(), set()
    if files.exists(staging):
        for status in files.listStatus(staging):
            run = status.getPath().getName()
            if status.isDirectory() and run[0] not in "._":
                done = files.exists(path_of(spark, f"{run_folder(root, run)}/{_COMMITTED}"))
                (committed if done else pending).add(run)
    return Runs(frozenset(pending), frozenset(committed))


def place_in_lake(path: Column) -> Column:
    """Partition folders and file name, out of any path of a file of a lake."""
    return F.regexp_extract(path, r"([^/]+/[^/]+/[^/]+/[^/]+)$", 1)


def folder_in_lake(path: Column) -> Column:
    """Partition folders out of any path of a file of a lake."""
    return F.regexp_extract(path, r"([^/]+/[^/]+/[^/]+)/[^/]+$", 1)


def metadata_path() -> Column:
    """The path that a scan reports, without its escapes; a plus sign is one."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def replaced_files(spark: SparkSession, root: str, run: str) -> DataFrame:
    return spark.read.schema("place string").parquet(f"{run_folder(root, run)}/replaced")


def live_files(spark: SparkSession, root: str, listed: Callable[[], DataFrame], path: Callable[[], Column]) -> DataFrame:
    """The rows of those files that count; ``listed`` makes a frame whose files are listed on the spot."""
    before = runs_of(spark, root)
    for _ in range(_TRIES):
        frame = listed()
        after = runs_of(spark, root)
        if after == before:
            return _only_live(frame, root, after, path)
        before = after
    raise RuntimeError(f"maintenance runs of {root} change too fast to list its files")


def _only_live(frame: DataFrame, root: str, runs: Runs, path: Callable[[], Column]) -> DataFrame:
    place = place_in_lake(path())
    name = F.element_at(F.split(place, "/"), -1)
    for run in sorted(runs.pending):
        frame = frame.where(~name.startswith(f"{PREFIX}{run}_"))
    for run in sorted(runs.committed):
        gone = replaced_files(frame.sparkSession, root, run)
        few = [row["place"] for row in gone.limit(LITERALS + 1).collect()]
        if len(few) <= LITERALS:
            frame = frame.where(~place.isin(few))
        else:
            columns = frame.columns
            frame = frame.withColumn("_place", place).join(gone.toDF("_place"), "_place", "left_anti").select(*columns)
    return frame


def replace_files(
    spark: SparkSession, root: str, run: str, replaced: DataFrame, write: Callable[[str], None]
) -> int:
    """Replace files (column ``path``) by those that ``write`` makes below a folder; returns how many went.

    ``write`` lays its files out as the lake does. A failure at any point is taken up
    by ``finish_runs``: staged completely, the run is published, else dropped.
    """
    folder = run_folder(root, run)
    replaced.select(place_in_lake(F.col("path")).alias("place")).write.parquet(f"{folder}/replaced")
    write(f"{folder}/data")
    publish(spark, root, run)
    return replaced_files(spark, root, run).count()


def publish(spark: SparkSession, root: str, run: str) -> None:
    """Move a run's staged files to their places and commit it; repeatable."""
    files, folder = file_system(spark, root), run_folder(root, run)
    base = files.makeQualified(path_of(spark, f"{folder}/data")).toString()

    def move(source: str) -> None:
        place, name = source[len(base) :].rsplit("/", 1)
        target = path_of(spark, f"{root}{place}/{PREFIX}{run}_{name}")
        files.mkdirs(target.getParent())
        if not files.rename(path_of(spark, source), target):
            raise OSError(f"could not move {source} to {target}")

    pattern = "/".join(f"{name}=*" for name in PARTITION_COLUMNS)
    found = files.globStatus(path_of(spark, f"{folder}/data/{pattern}/part-*")) or []
    in_parallel(move, [status.getPath().toString() for status in found])
    files.create(path_of(spark, f"{folder}/{_COMMITTED}"), False).close()


def finish_runs(spark: SparkSession, root: str, grace_seconds: float = 0.0) -> None:
    """Publish runs that were staged completely, drop others; clean up those committed some time ago."""
    files = file_system(spark, root)
    runs = runs_of(spark, root)
    committed = set(runs.committed)
    for run in sorted(runs.pending):
        if files.exists(path_of(spark, f"{run_folder(root, run)}/data/_SUCCESS")):
            publish(spark, root, run)
            committed.add(run)
        else:
            _forget(spark, root, run)
    for run in sorted(committed):
        marker = files.getFileStatus(path_of(spark, f"{run_folder(root, run)}/{_COMMITTED}"))
        if time.time() - marker.getModificationTime() / 1000 >= grace_seconds:
            places = (row["place"] for row in replaced_files(spark, root, run).toLocalIterator())
            in_parallel(lambda place: files.delete(path_of(spark, f"{root}/{place}"), False), places)
            _forget(spark, root, run)


def _forget(spark: SparkSession, root: str, run: str) -> None:
    """Remove a run's folder; the rename comes first, since deleting takes more than one step."""
    files = file_system(spark, root)
    aside = path_of(spark, f"{root}/{STAGING}/.{run}")
    if not files.rename(path_of(spark, run_folder(root, run)), aside):
        raise OSError(f"could not put {run} aside")
    files.delete(aside, True)


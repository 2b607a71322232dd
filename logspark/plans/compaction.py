"""Compaction: merge the small files of an hour partition.

An inventory has stream, dt, hour, path (or name), length and mtime.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from logspark.runtime import cut_lineage
from logspark.schema import PARTITION_COLUMNS
from logspark.sources.files import path_exists
from logspark.sources.folders import only_run, refuse_sink
from logspark.sources.inventory import file_inventory
from logspark.sources.lake import partition_folder, read_files, write_sorted
from logspark.sources.publication import (
    PREFIX,
    STAGING,
    finish_runs,
    metadata_path,
    place_in_lake,
    replace_files,
)

# How long replaced files are kept for searches that planned before.
GRACE = dt.timedelta(hours=1)
# Bytes rewritten by one Spark job; a larger plan takes several jobs.
BYTES_PER_JOB = 1 << 40


@dataclass(frozen=True)
class CompactionPolicy:
    min_files: int = 5
    min_age: dt.timedelta = dt.timedelta(hours=2)
    compacted_age: dt.timedelta = dt.timedelta(hours=24)
    max_file_bytes: int = 100 * 1024**2


def _older(now: Column, age: dt.timedelta) -> Column:
    return F.col("mtime") <= now - F.expr(f"INTERVAL {int(age.total_seconds())} SECONDS")


def is_compacted(path: Column) -> Column:
    return F.contains(F.element_at(F.split(path, "/"), -1), F.lit(PREFIX))


def with_eligibility(
    inventory: DataFrame, now: Column, policy: CompactionPolicy, path: str = "path"
) -> DataFrame:
    """Add ``is_compacted``, ``eligible`` (old enough) and ``in_rewrite`` (merged
    when its partition is: eligible, and not a young compacted file)."""
    compacted = is_compacted(F.col(path))
    eligible = _older(now, policy.min_age)
    return inventory.withColumns(
        {
            "is_compacted": compacted,
            "eligible": eligible,
            "in_rewrite": eligible & (~compacted | _older(now, policy.compacted_age)),
        }
    )


def compaction_plan(
    inventory: DataFrame,
    now: Column,
    policy: CompactionPolicy = CompactionPolicy(),
    path: str = "path",
    keys: tuple[str, ...] = PARTITION_COLUMNS,
) -> DataFrame:
    """One row per partition with at least ``min_files`` files.

    ``needs_compaction``: enough eligible files that are not compacted yet;
    ``merged_files``, ``merged_bytes`` and ``output_files`` describe the rewrite.
    """
    files = with_eligibility(inventory, now, policy, path)
    fresh = F.col("eligible") & ~F.col("is_compacted")
    plan = files.groupBy(*keys).agg(
        F.count("*").alias("files"),
        F.count_if("eligible").alias("eligible_files"),
        F.sum(F.when(F.col("eligible"), F.col("length")).otherwise(0)).alias("eligible_bytes"),
        F.count_if(fresh).alias("fresh_files"),
        F.count_if("in_rewrite").alias("merged_files"),
        F.sum(F.when(F.col("in_rewrite"), F.col("length")).otherwise(0)).alias("merged_bytes"),
    )
    needs = (F.col("fresh_files") >= policy.min_files) & (F.col("merged_files") >= 2)
    outputs = F.ceil(F.col("merged_bytes") / F.lit(policy.max_file_bytes)).cast("bigint")
    return plan.where(F.col("files") >= policy.min_files).select(
        *keys,
        "files",
        "eligible_files",
        "eligible_bytes",
        needs.alias("needs_compaction"),
        "merged_files",
        "merged_bytes",
        F.greatest(outputs, F.lit(1).cast("bigint")).alias("output_files"),
    )


def compaction_totals(plan: DataFrame, ran_at: Column) -> DataFrame:
    """One row: partitions to compact, files they merge, and when."""
    return plan.where("needs_compaction").agg(
        F.count("*").alias("total_compactions"),
        F.coalesce(F.sum("merged_files"), F.lit(0)).alias("total_files_merged"),
        F.max(ran_at).alias("last_compaction"),
    )


def rewrite_set(
    inventory: DataFrame, now: Column, policy: CompactionPolicy, path: str = "path",
    keys: tuple[str, ...] = PARTITION_COLUMNS,
) -> DataFrame:
    """The files that get merged, with the number of output files of their
    partition. The plan side has one row per partition, so it shuffles little;
    Spark broadcasts it when it measures it small."""
    chosen = compaction_plan(inventory, now, policy, path, keys).where("needs_compaction")
    files = with_eligibility(inventory, now, policy, path).where("in_rewrite")
    return files.join(chosen.select(*keys, "output_files"), list(keys))


def merge_rows(rows: DataFrame, outputs: DataFrame, total: int) -> DataFrame:
    """Rows placed for the rewrite, one task per output file.

    ``outputs`` has the partition columns, output_files and ``first``, the number
    of the partition's first output file out of ``total``. The files of a large
    hour hold slices of its time with like row counts, cut at whole seconds, so a
    search within the hour skips files.
    """
    keys = list(PARTITION_COLUMNS)
    second = F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(3600))
    placed = rows.join(outputs, keys).withColumn("_second", second)
    large = placed.where("output_files > 1").groupBy(*keys, "_second", "output_files").count()
    hour = Window.partitionBy(*keys)
    before = F.sum("count").over(hour.orderBy("_second").rowsBetween(Window.unboundedPreceding, -1))
    share = F.coalesce(before, F.lit(0)) * F.col("output_files") / F.sum("count").over(hour)
    slices = large.select(*keys, "_second", F.floor(share).alias("_slice"))
    sliced = placed.join(slices, [*keys, "_second"], "left")
    number = (F.col("first") + F.coalesce("_slice", F.lit(0))).cast("int")
    return sliced.repartitionById(total, number).drop("output_files", "first", "_second", "_slice")


def compact_lake(
    spark: SparkSession,
    root: str,
    now: Column,
    policy: CompactionPolicy = CompactionPolicy(),
    bytes_per_job: int = BYTES_PER_JOB,
    takeover: bool = False,
    grace: dt.timedelta = GRACE,
) -> int:
    """Rewrite every settled partition the plan names; returns the files merged.

    A partition is settled when all its files are old enough; others wait for a
    later run. Jobs take whole partitions, up to ``bytes_per_job`` but always at
    least one, so the result does not depend on the job size. Each job is published
    in one step: ``read_lake`` sees its old files until then and its new ones after. The
    old files stay on disk for ``grace``, which should cover the longest search, and go in a later run (or
    in this one if it is zero). A run that dies leaves its folder; the next run, which must take
    over the marker, finishes what was staged completely and drops the rest. Readers other
    than ``read_lake`` see old and new files until the old ones are gone.
    """
    refuse_sink(spark, root, "compact")
    if not path_exists(spark, root):
        return 0
    with only_run(spark, f"{root}/{STAGING}/_running", takeover):
        finish_runs(spark, root, grace.total_seconds())
        files = cut_lineage(with_eligibility(file_inventory(spark, root), now, policy))
        settled = files.groupBy(*PARTITION_COLUMNS).agg(F.bool_and("eligible").alias("settled")).where("settled")
        plan = compaction_plan(files, now, policy).where("needs_compaction")
        chosen = plan.join(settled, list(PARTITION_COLUMNS), "left_semi")
        merged = 0
        for job in _jobs(chosen, bytes_per_job):
            merged += _rewrite(spark, root, files, job)
            finish_runs(spark, root, grace.total_seconds())
    return merged


def _jobs(chosen: DataFrame, most_bytes: int) -> Iterator[list[Row]]:
    """Whole partitions in order, up to some bytes at a time; the driver holds one job's partitions."""
    job, size = [], 0
    for row in chosen.orderBy(*PARTITION_COLUMNS).toLocalIterator():
        if job and size + row["merged_bytes"] > most_bytes:
            yield job
            job, size = [], 0
        job.append(row)
        size += row["merged_bytes"]
    if job:
        yield job


def _rewrite(spark: SparkSession, root: str, files: DataFrame, job: list[Row]) -> int:
    kinds = [f"{name} {files.schema[name].dataType.simpleString()}" for name in PARTITION_COLUMNS]
    numbered, total = [], 0
    for row in job:
        numbered.append((*[row[name] for name in PARTITION_COLUMNS], row["output_files"], total))
        total += row["output_files"]
    schema = ", ".join([*kinds, "output_files bigint", "first bigint"])
    outputs = spark.createDataFrame(numbered, schema)
    folders = [partition_folder(spark, row) for row in job]
    # All listed files of the partitions are read, young compacted ones too, and no others.
    listed = cut_lineage(files.join(outputs.select(*PARTITION_COLUMNS), list(PARTITION_COLUMNS)).select("path"))
    places = listed.select(place_in_lake(F.col("path")).alias("_place"))

    def write(folder: str) -> None:
        rows = read_files(spark, root, [f"{root}/{name}" for name in folders])
        rows = rows.withColumn("_place", place_in_lake(metadata_path()))
        rows = rows.join(places, "_place", "left_semi").drop("_place")
        write_sorted(merge_rows(rows, outputs, total), folder)

    return replace_files(spark, root, uuid.uuid4().hex, listed, write)

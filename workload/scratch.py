"""Folders for queries that write: under the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from logspark.runtime import ensure_checkpoint_dir, own_checkpoint_dir
from logspark.schema import PARTITION_COLUMNS
from logspark.sources.lake import lake_rows, write_lake, write_sorted
from workload import fixtures


def new_folder(spark: SparkSession) -> str:
    own_checkpoint_dir(spark)
    return f"{ensure_checkpoint_dir(spark)}/logspark-{uuid.uuid4().hex}"


def lake_of_logs(spark: SparkSession, sf_dir: str, fast: bool = True) -> str:
    """A fresh lake that holds the logs table, all its streams and hours.

    In real event time most hours have a row or two, and opening their thousands of
    files takes all the time: they are dealt to all cores.
    """
    root = f"{new_folder(spark)}/lake"
    rows = fixtures.logs(spark, sf_dir, fast)
    if fast:
        write_lake(rows, root)
    else:
        cores = spark.sparkContext.defaultParallelism
        write_sorted(lake_rows(rows).repartition(cores, *PARTITION_COLUMNS), root)
    return root

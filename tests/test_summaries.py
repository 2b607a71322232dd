import glob

import pytest
from pyspark.sql import functions as F

from logspark.operators.stats import lake_stats
from logspark.plans import compaction, retention, summaries
from logspark.sources.inventory import file_inventory
from logspark.sources.lake import read_lake, write_lake
from workload import fixtures


@pytest.fixture(scope="module")
def logs(spark, sf_dir):
    return fixtures.logs(spark, sf_dir, fast=True).where("event_id < 400").cache()


def same(spark, root):
    assert summaries.kept_stats(spark, root).first() == lake_stats(read_lake(spark, root)).first()


def test_new_files_are_summarised_once(spark, logs, tmp_path):
    root = str(tmp_path / "lake")
    write_lake(logs.where("event_id % 2 = 0"), root)
    same(spark, root)
    files = file_inventory(spark, root).count()
    assert summaries.summarise_lake(spark, root) == files
    assert summaries.summarise_lake(spark, root) == 0
    write_lake(logs.where("event_id % 2 = 1"), root)
    same(spark, root)
    assert summaries.summarise_lake(spark, root) == file_inventory(spark, root).count() - files
    same(spark, root)


def test_log_rows_are_not_read(spark, logs, tmp_path):
    root = str(tmp_path / "lake")
    write_lake(logs, root)
    wanted = lake_stats(read_lake(spark, root)).first()
    summaries.summarise_lake(spark, root)
    for path in glob.glob(f"{root}/stream=*/*/*/*.parquet"):
        with open(path, "w") as file:
            file.write("nothing to read here")
    assert summaries.kept_stats(spark, root).first() == wanted


def test_compaction_and_retention_leave_stale_rows_that_do_not_count(spark, logs, tmp_path):
    root = str(tmp_path / "lake")
    for part in range(2):
        write_lake(logs.where(F.col("event_id") % 2 == part), root)
    summaries.summarise_lake(spark, root)
    now = F.current_timestamp() + F.expr("INTERVAL 3 HOURS")
    compaction.compact_lake(spark, root, now, compaction.CompactionPolicy(min_files=2))
    same(spark, root)
    assert summaries.summarise_lake(spark, root) > 0
    files = file_inventory(spark, root)
    retention.delete_files(spark, root, files.where("stream = 'svc-1'"))
    same(spark, root)


def test_rows_repeated_by_two_runs_count_once(spark, logs, tmp_path):
    root = str(tmp_path / "lake")
    write_lake(logs, root)
    paths = [row["path"] for row in file_inventory(spark, root).collect()]
    for _ in range(2):
        summaries._summaries_of(spark, root, paths).write.mode("append").parquet(f"{root}/{summaries.SUMMARIES}")
    same(spark, root)


def test_missing_lake_and_streams_with_odd_names(spark, logs, tmp_path):
    root = str(tmp_path / "lake")
    assert summaries.summarise_lake(spark, root) == 0
    assert summaries.kept_stats(spark, root).first() == lake_stats(read_lake(spark, root)).first()
    assert summaries.kept_stats(spark, root, by_stream=True).count() == 0
    named = logs.withColumn("stream", F.when(F.col("event_id") % 2 == 0, "a+b %20:c").otherwise("é/x"))
    write_lake(named.withColumn("level", F.lit(None).cast("string")), root)
    summaries.summarise_lake(spark, root)
    assert summaries.summarise_lake(spark, root) == 0
    same(spark, root)
    found = {row["stream"]: row["total_records"] for row in summaries.kept_stats(spark, root, by_stream=True).collect()}
    assert found == {row["stream"]: row["count"] for row in named.groupBy("stream").count().collect()}

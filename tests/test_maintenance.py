import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logspark.plans import compaction, ranking, retention
from logspark.sources import inventory, lake, publication
from tests.plans import physical

SCHEMA = "stream string, path string, length bigint, mtime timestamp_ntz"
NOW = dt.datetime(2024, 3, 1)


def aged(row, now, days):
    return row["mtime"] < now - dt.timedelta(days=days)


FILE = st.tuples(st.sampled_from(["a", "b", None]), st.integers(1, 100), st.integers(0, 60))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(files=st.lists(FILE, min_size=1, max_size=60), keep=st.integers(0, 8), cap=st.integers(1, 1500))
def test_retention_properties(spark, files, keep, cap):
    """Oldest first, the minimum kept, and the excess covered by not one file more than needed."""
    rows = [
        (stream, f"f{at}", size, NOW - dt.timedelta(days=age))
        for at, (stream, size, age) in enumerate(files)
    ]
    policy = retention.RetentionPolicy(days=30, keep_min=keep, max_bytes=cap)
    now = F.lit(str(NOW)).cast("timestamp_ntz")
    found = retention.retention_plan(spark.createDataFrame(rows, SCHEMA), now, policy).collect()
    assert sorted(row["path"] for row in found) == sorted(row[1] for row in rows)
    for stream in {row[0] for row in rows}:
        plan = sorted((r for r in found if r["stream"] == stream), key=lambda r: (r["mtime"], r["path"]))
        old = [r for r in plan if r["by_age"]]
        large = [r for r in plan if r["by_size"]]
        left = plan[len(old) + len(large) :]
        # the oldest files go, those by age before those by size
        assert plan == old + large + left
        assert len(left) >= min(keep, len(plan))
        # by age: only old files, and all of them unless the minimum stops it
        assert all(aged(r, NOW, 30) for r in old)
        rest = plan[len(old) :]
        assert len(rest) <= keep or not aged(rest[0], NOW, 30)
        # by size: age bytes do not count, the excess is covered unless the minimum stops it
        excess = sum(r["length"] for r in plan) - cap
        freed = sum(r["length"] for r in large)
        assert freed >= excess or len(left) <= keep
        assert not large or freed - large[-1]["length"] < excess


def test_running_totals_of_a_hot_group(spark):
    rows = spark.range(5000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 50) END AS g", "id % 97 AS o", "id AS tie", "id % 11 AS v"
    )
    found = ranking.running_totals(rows, "g", ["o", "tie"], {"before": "v", "rank": "CAST(1 AS bigint)"}).collect()
    assert len(found) == 5000
    groups = {}
    for row in rows.collect():
        groups.setdefault(row["g"], []).append(row)
    expected = {}
    for name, members in groups.items():
        total = 0
        for at, row in enumerate(sorted(members, key=lambda row: (row["o"], row["tie"]))):
            expected[row["tie"]] = (total, at, sum(m["v"] for m in members), len(members))
            total += row["v"]
    assert {r["tie"]: (r["before"], r["rank"], r["before_total"], r["rank_total"]) for r in found} == expected


@pytest.fixture
def small_files(spark, tmp_path):
    """A lake with two hours of many files and one with few."""
    root = str(tmp_path / "lake")
    rows = spark.range(600).selectExpr(
        "timestamp'2024-01-01 10:00:00' + make_dt_interval(0, CASE WHEN id < 20 THEN 2 ELSE id % 2 END, 0, id % 3000) AS ts",
        "'app' AS source", "'INFO' AS level", "concat('message ', id) AS message", "cast(id AS string) AS id",
    )
    lake.write_sorted(lake.lake_rows(rows.where("id < 20")).coalesce(1), root)
    lake.write_sorted(lake.lake_rows(rows.where("id >= 20")).repartition(7, "id"), root)
    return root


def contents(spark, root):
    return sorted(tuple(row) for row in lake.read_lake(spark, root).collect())


LATER = "INTERVAL 3 HOURS"


def test_compaction_keeps_rows_and_merges_files(spark, small_files):
    before = contents(spark, small_files)
    assert compaction.compact_lake(spark, small_files, F.current_timestamp()) == 0
    now = F.current_timestamp() + F.expr(LATER)
    assert compaction.compact_lake(spark, small_files, now) == 14
    assert contents(spark, small_files) == before
    after = inventory.file_inventory(spark, small_files)
    assert {(row["hour"], row["count"]) for row in after.groupBy("hour").count().collect()} == {(10, 1), (11, 1), (12, 1)}
    assert after.where(compaction.is_compacted(F.col("path"))).count() == 2
    # nothing is left to do
    assert compaction.compact_lake(spark, small_files, now) == 0


def test_compaction_splits_large_partitions_and_batches(spark, small_files):
    before = contents(spark, small_files)
    policy = compaction.CompactionPolicy(max_file_bytes=8_000)
    now = F.current_timestamp() + F.expr(LATER)
    assert compaction.compact_lake(spark, small_files, now, policy, bytes_per_job=1) == 14
    assert contents(spark, small_files) == before
    merged = inventory.file_inventory(spark, small_files).where(compaction.is_compacted(F.col("path")))
    assert merged.groupBy("hour").count().where("count > 1").count() == 2
    # each file of a large hour holds a slice of its time
    spans = (
        lake.read_lake(spark, small_files).where("hour = 10").groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last")).orderBy("first").collect()
    )
    assert all(one["last"] < two["first"] for one, two in zip(spans, spans[1:]))


@pytest.mark.parametrize("most", [1, 9_000, 1 << 40])
def test_job_size_does_not_change_the_files(spark, small_files, most):
    now = F.current_timestamp() + F.expr(LATER)
    assert compaction.compact_lake(spark, small_files, now, bytes_per_job=most) == 14
    assert inventory.file_inventory(spark, small_files).count() == 3


def test_files_that_come_in_during_a_swap_stay(spark, small_files, monkeypatch):
    before = contents(spark, small_files)
    now = F.current_timestamp() + F.expr(LATER)
    extra = lake.read_lake(spark, small_files).where("hour = 10").limit(3).withColumn("id", F.lit("late"))
    late = extra.checkpoint()
    publish = publication.publish

    def meanwhile(*args):
        lake.write_sorted(late.select(*lake.LAKE_SCHEMA.fieldNames()), small_files)
        publish(*args)

    monkeypatch.setattr(publication, "publish", meanwhile)
    assert compaction.compact_lake(spark, small_files, now) == 14
    found = contents(spark, small_files)
    assert len(found) == len(before) + 3 and set(before) <= set(found)


def test_a_second_run_is_refused(spark, small_files):
    now = F.current_timestamp() + F.expr(LATER)
    with compaction.only_run(spark, f"{small_files}/{publication.STAGING}/_running", False):
        with pytest.raises(RuntimeError):
            compaction.compact_lake(spark, small_files, now)
        assert compaction.compact_lake(spark, small_files, now, takeover=True) == 14


def test_broken_compaction_is_finished_by_the_next(spark, small_files, monkeypatch):
    before = contents(spark, small_files)
    now = F.current_timestamp() + F.expr(LATER)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(publication, "publish", die)
        with pytest.raises(RuntimeError):
            compaction.compact_lake(spark, small_files, now)
    assert contents(spark, small_files) == before
    assert inventory.file_inventory(spark, small_files).count() == 15
    assert compaction.compact_lake(spark, small_files, now) == 0
    assert contents(spark, small_files) == before
    assert inventory.file_inventory(spark, small_files).count() == 3


def test_incomplete_staging_is_dropped(spark, small_files, monkeypatch):
    before = contents(spark, small_files)
    now = F.current_timestamp() + F.expr(LATER)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(compaction, "write_sorted", die)
        with pytest.raises(RuntimeError):
            compaction.compact_lake(spark, small_files, now)
    publication.finish_runs(spark, small_files)
    assert contents(spark, small_files) == before
    assert compaction.compact_lake(spark, small_files, now) == 14
    assert contents(spark, small_files) == before


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", range(5))
def test_readers_see_old_or_new_files_wherever_a_run_stops(spark, small_files, monkeypatch, step):
    """Stopped while staging, between two moves, before and after the commit, and while old files are deleted."""
    before = contents(spark, small_files)
    planned = lake.read_lake(spark, small_files)
    now = F.current_timestamp() + F.expr(LATER)
    grace = dt.timedelta(0) if step == 4 else dt.timedelta(hours=1)
    moved = []

    def some(call, paths):
        for at, path in enumerate(list(paths)):
            if at == 1:
                raise Stopped
            moved.append(call(path))

    def stop(*_):
        raise Stopped

    finish, in_parallel = publication.finish_runs, publication.in_parallel
    with monkeypatch.context() as patch:
        if step == 0:
            patch.setattr(compaction, "merge_rows", stop)
        elif step == 1:
            patch.setattr(publication, "in_parallel", some)
        elif step == 2:
            patch.setattr(publication, "in_parallel", lambda *args: (in_parallel(*args), stop()))
        elif step == 3:
            patch.setattr(compaction, "finish_runs", lambda *args: finish(*args) if not publication.runs_of(spark, small_files).committed else stop())
        else:
            calls = []
            patch.setattr(publication, "in_parallel", lambda *args: (in_parallel if not calls.append(1) and len(calls) == 1 else some)(*args))
        with pytest.raises(Stopped):
            compaction.compact_lake(spark, small_files, now, grace=grace)
    live = inventory.file_inventory(spark, small_files)
    assert contents(spark, small_files) == before
    assert live.count() == (15 if step < 3 else 3)
    if step < 4:
        assert sorted(tuple(row) for row in planned.collect()) == before
    # The next run finishes or drops it, and the one after that has no more to do.
    done = compaction.compact_lake(spark, small_files, now, grace=dt.timedelta(0))
    assert done == (14 if step == 0 else 0) and contents(spark, small_files) == before
    assert spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(small_files).count() == 3
    assert publication.runs_of(spark, small_files) == publication.Runs(frozenset(), frozenset())


def test_old_files_stay_for_readers_that_planned_before(spark, small_files):
    planned, before = lake.read_lake(spark, small_files), contents(spark, small_files)
    now = F.current_timestamp() + F.expr(LATER)
    assert compaction.compact_lake(spark, small_files, now, grace=dt.timedelta(hours=1)) == 14
    assert sorted(tuple(row) for row in planned.collect()) == before == contents(spark, small_files)
    assert len(publication.runs_of(spark, small_files).committed) == 1
    # Replaced files are not merged again; later they go.
    assert compaction.compact_lake(spark, small_files, now, grace=dt.timedelta(hours=1)) == 0
    publication.finish_runs(spark, small_files)
    assert contents(spark, small_files) == before and not publication.runs_of(spark, small_files).committed


@pytest.mark.parametrize("literals", [0, 500])
def test_many_replaced_files_and_odd_stream_names(spark, tmp_path, monkeypatch, literals):
    monkeypatch.setattr(publication, "LITERALS", literals)
    root = str(tmp_path / "lake")
    rows = spark.range(60).selectExpr(
        "timestamp'2024-01-01 10:00:00' AS ts", "element_at(array('a b', 'c+d', 'e%20f', 'g:h', 'ü=1'), cast(id % 5 + 1 AS int)) AS source",
        "'INFO' AS level", "concat('message ', id) AS message", "cast(id AS string) AS id",
    )
    lake.write_sorted(lake.lake_rows(rows).repartition(6, "id"), root)
    before = contents(spark, root)
    now = F.current_timestamp() + F.expr(LATER)
    merged = compaction.compact_lake(spark, root, now, compaction.CompactionPolicy(min_files=2), grace=dt.timedelta(hours=1))
    assert merged > 10 and contents(spark, root) == before and len(before) == 60
    assert inventory.file_inventory(spark, root).count() == 5
    publication.finish_runs(spark, root)
    assert contents(spark, root) == before


def test_a_run_that_begins_or_ends_while_files_are_listed(spark, small_files, monkeypatch):
    listings = []

    def listed():
        listings.append(1)
        if len(listings) == 1:
            folder = publication.path_of(spark, f"{small_files}/_compaction/abc/replaced")
            publication.file_system(spark, small_files).mkdirs(folder)
        return lake.read_files(spark, small_files, [small_files])

    found = publication.live_files(spark, small_files, listed, publication.metadata_path)
    assert found.count() == 600 and len(listings) == 2


def test_streaming_sink_folder_is_refused(spark, tmp_path):
    (tmp_path / "_spark_metadata").mkdir()
    with pytest.raises(ValueError):
        compaction.compact_lake(spark, str(tmp_path), F.current_timestamp())
    with pytest.raises(ValueError):
        retention.delete_files(spark, str(tmp_path), spark.createDataFrame([], "path string"))


def test_retention_deletes_planned_files(spark, small_files):
    files = inventory.file_inventory(spark, small_files)
    now = F.current_timestamp() + F.expr("INTERVAL 40 DAYS")
    plan = retention.retention_plan(files, now, retention.RetentionPolicy(keep_min=4)).checkpoint()
    doomed = retention.doomed(plan)
    assert retention.delete_files(spark, small_files, doomed, dry_run=True) == 11
    assert inventory.file_inventory(spark, small_files).count() == 15
    assert retention.delete_files(spark, small_files, doomed) == 11
    left = {row["path"] for row in inventory.file_inventory(spark, small_files).collect()}
    assert left == {row["path"] for row in retention.kept(plan).collect()}
    assert retention.delete_files(spark, small_files, doomed) == 11  # again: nothing happens


def test_row_retention_prunes_days(spark, small_files):
    rows = retention.row_retention(lake.read_lake(spark, small_files), dt.datetime(2024, 1, 31, 11), 30)
    assert "PartitionFilters: [isnotnull(dt" in physical(rows)
    assert rows.count() == lake.read_lake(spark, small_files).where("hour >= 11").count()


def test_partitions_go_as_folders(spark, small_files, monkeypatch):
    files = inventory.file_inventory(spark, small_files)
    calls = []
    plain = retention.in_parallel
    monkeypatch.setattr(retention, "in_parallel", lambda call, what: plain(lambda x: (calls.append(x), call(x)), what))
    one_left = files.where("hour = 10").orderBy("path").limit(2)
    assert retention.delete_files(spark, small_files, files.where("hour = 11").unionByName(one_left)) == 9
    assert len(calls) == 3  # seven files of an hour at once, and two files
    left = {(row["hour"], row["count"]) for row in inventory.file_inventory(spark, small_files).groupBy("hour").count().collect()}
    assert left == {(10, 5), (12, 1)}


def test_a_file_that_comes_in_before_the_drop_stays(spark, small_files, monkeypatch):
    files = inventory.file_inventory(spark, small_files).where("hour = 11")
    late = spark.createDataFrame([(dt.datetime(2024, 1, 1, 11, 59), "app", "INFO", "late", "late")], "ts timestamp, source string, level string, message string, id string")
    plain = retention._drop

    def drop(*args):
        lake.write_lake(late, small_files)
        return plain(*args)

    monkeypatch.setattr(retention, "_drop", drop)
    assert retention.delete_files(spark, small_files, files) == 0
    assert lake.read_lake(spark, small_files).where("id = 'late'").count() == 1
    assert inventory.file_inventory(spark, small_files).where("hour = 11").count() == 8


def test_a_drop_that_died_is_finished(spark, small_files, monkeypatch):
    files = inventory.file_inventory(spark, small_files).where("hour = 11")
    with monkeypatch.context() as broken, pytest.raises(InterruptedError):
        broken.setattr(retention, "_settle", lambda *_: (_ for _ in ()).throw(InterruptedError))
        retention.delete_files(spark, small_files, files)
    assert lake.read_lake(spark, small_files).where("hour = 11").count() == 0
    nothing = inventory.file_inventory(spark, small_files).where("false")
    assert retention.delete_files(spark, small_files, nothing) == 0
    assert not [path for path in (spark.sparkContext._jvm.java.io.File(f"{small_files}/_dropped").list() or [])]


@pytest.mark.parametrize("minute", [0, 20, 59])
def test_row_retention_is_applied(spark, small_files, minute):
    now = dt.datetime(2024, 1, 31, 11, minute)
    kept = sorted(tuple(row) for row in retention.row_retention(lake.read_lake(spark, small_files), now, 30).collect())
    untouched = {row["path"] for row in inventory.file_inventory(spark, small_files).where("hour = 12").collect()}
    retention.apply_row_retention(spark, small_files, now, 30)
    assert contents(spark, small_files) == kept
    retention.apply_row_retention(spark, small_files, now, 30, grace=dt.timedelta(0))
    assert contents(spark, small_files) == kept
    assert untouched <= {row["path"] for row in inventory.file_inventory(spark, small_files).collect()}

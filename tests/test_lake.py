import datetime as dt
import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logspark.operators import entries, filters, search, sessions, stats
from logspark.operators.parse import parse_lines
from logspark.plans import newest
from logspark.schema import LAKE_SCHEMA, LOG_COLUMNS
from logspark.sources import inventory, lake, lines, session_files
from tests.plans import physical, scan_line
from workload import fixtures


@pytest.fixture(scope="module")
def root(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lake") / "root")
    logs = fixtures.logs(spark, sf_dir).where("event_id < 200")
    lake.write_lake(logs, folder)
    return folder


def test_missing_lake_is_empty(spark, tmp_path):
    empty = lake.read_lake(spark, str(tmp_path / "none"))
    assert empty.schema == LAKE_SCHEMA and empty.count() == 0
    assert inventory.file_inventory(spark, str(tmp_path / "none")).count() == 0
    wanted = filters.QueryFilter(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), limit=5)
    assert search.search(empty, wanted).count() == 0


def test_search_prunes_partitions(spark, root):
    stored = lake.read_lake(spark, root)
    wanted = filters.QueryFilter(
        dt.datetime(2024, 1, 1, 3, 30), dt.datetime(2024, 1, 1, 5, 10), process="svc-3", limit=5
    )
    scan = scan_line(search.search(stored, wanted))
    pruning = scan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert "stream" in pruning and "dt" in pruning and "hour" in pruning
    assert "GreaterThanOrEqual(ts" in scan and "LessThanOrEqual(ts" in scan
    assert "component" not in scan.split("ReadSchema")[1]


def test_partition_bounds_keep_every_row(spark, root):
    stored = lake.read_lake(spark, root)
    for start, end in (
        (dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 3, 59, 59, 999999)),
        (dt.datetime(2024, 1, 1, 22), dt.datetime(2024, 1, 3, 1)),
        (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)),
    ):
        wanted = filters.QueryFilter(start, end)
        plain = stored.drop("dt", "hour")
        assert search.matching(stored, wanted).count() == search.matching(plain, wanted).count()


def test_zoned_bounds_are_converted(spark, root):
    stored = lake.read_lake(spark, root)
    zone = dt.timezone(dt.timedelta(hours=2))
    plain = filters.QueryFilter(dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 6))
    zoned = filters.QueryFilter(
        dt.datetime(2024, 1, 1, 5, tzinfo=zone), dt.datetime(2024, 1, 1, 8, tzinfo=zone)
    )
    assert search.matching(stored, plain).count() == search.matching(stored, zoned).count() > 0


def test_files_hold_millisecond_statistics(spark, root):
    path = inventory.file_inventory(spark, root).first()["path"].replace("file:", "")
    column = pq.ParquetFile(path).metadata.row_group(0).column(0)
    assert column.path_in_schema == "ts" and column.compression == "ZSTD"
    assert column.is_stats_set and "Milli" in str(pq.ParquetFile(path).schema.column(0).logical_type) or \
        "milliseconds" in str(pq.ParquetFile(path).schema.column(0).logical_type)


def test_files_scanned_counts_files_in_reach(spark, root):
    everything = filters.QueryFilter(dt.datetime(2023, 1, 1), dt.datetime(2025, 1, 1))
    files = inventory.file_inventory(spark, root)
    assert search.files_scanned(spark, root, everything).first()[0] == files.count()
    one = filters.QueryFilter(dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 3, 59), process="svc-3")
    scanned = search.files_scanned(spark, root, one).first()[0]
    assert scanned == files.where("stream = 'svc-3' AND dt = '2024-01-01' AND hour = 3").count()


def test_inventory_reads_names_back(spark, tmp_path):
    rows = spark.sql(
        "SELECT timestamp'2024-01-01 10:00:00' AS ts, explode(array('a b', 'x=y', 'p%q', 'c:d+e')) AS source,"
        " 'INFO' AS level, 'm' AS message"
    )
    folder = str(tmp_path / "names")
    lake.write_lake(rows, folder)
    found = {row["stream"] for row in inventory.file_inventory(spark, folder).collect()}
    assert found == {"a b", "x=y", "p%q", "c:d+e"}
    assert {row["stream"] for row in stats.stream_list(lake.read_lake(spark, folder)).collect()} == found


def test_foreign_layout(spark, sf_dir, tmp_path):
    logs = fixtures.logs(spark, sf_dir).where("event_id < 50").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "foreign")
    for stream in ("svc-1", "svc-2"):
        one = logs.where(F.col("stream") == stream)
        one.select(*LOG_COLUMNS).coalesce(1).write.parquet(f"{folder}/{stream}/year=2024/month=01/day=02/hour=07")
    found = lake.read_foreign_lake(spark, folder)
    assert found.select("stream", "dt", "hour").distinct().count() == 2
    assert found.where("stream = 'svc-1'").count() == logs.where("stream = 'svc-1'").count()
    assert found.where("dt = '2024-01-02' AND hour = 7").count() == found.count()
    files = inventory.file_inventory(spark, folder, foreign=True)
    assert {row["stream"] for row in files.collect()} == {"svc-1", "svc-2"}


def test_line_source(spark, tmp_path):
    long = "x" * 3_000_000
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo\rhalf\n" + long.encode() + b"\nlast")
    found = [row["value"] for row in lines.read_lines(spark, str(tmp_path)).collect()]
    assert sorted(found) == ["last", "one", "two\rhalf", long]


def test_only_reachable_folders_are_listed(spark, root):
    every = lake.read_lake(spark, root)
    for start, end, stream in (
        (dt.datetime(2024, 1, 1, 3, 30), dt.datetime(2024, 1, 1, 5, 10), "svc-3"),
        (dt.datetime(2024, 1, 1, 22), dt.datetime(2024, 1, 3, 1), ""),
        (dt.datetime(2023, 11, 1), dt.datetime(2024, 3, 1), "svc-1"),
        (dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1), ""),
        (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1), ""),
    ):
        wanted = filters.QueryFilter(start, end, process=stream)
        near = lake.read_lake(spark, root, start, end, stream)
        assert search.matching(near, wanted).count() == search.matching(every, wanted).count()
    day = lake.reachable_folders(spark, root, dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 4))
    assert day and all("/dt=2024-01-01/hour=" in folder for folder in day)
    listed = lake.read_lake(spark, root, dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 4)).inputFiles()
    assert listed and all("hour=3/" in path or "hour=4/" in path for path in listed)


def test_partitions_are_utc_in_any_zone(spark, sf_dir, tmp_path):
    logs = fixtures.logs(spark, sf_dir).where("event_id < 24")
    rows = logs.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.checkpoint()
    folder = str(tmp_path / "zoned")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        lake.write_lake(rows, folder)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    found = search.matching(lake.read_lake(spark, folder), filters.QueryFilter(first, last))
    assert found.count() == 24
    assert found.where("dt = to_date(ts) AND hour = hour(ts)").count() == 24


def test_rows_that_read_alike_with_separators_stay_apart(spark):
    rows = spark.createDataFrame(
        [("x|5", "1970-01-01 00:00:07", "s"), ("x", "1970-01-01 00:00:05", "7|s"), ("x", "1970-01-01 00:00:05", "7|s")],
        "message string, at string, source string",
    ).select("message", F.col("at").cast("timestamp").alias("ts"), "source")
    assert entries.dedup(rows, ("message",)).count() == 2
    assert rows.select(entries.exact_key()).distinct().count() == 2


def test_container_lines(spark, tmp_path):
    for name, stream, text in (("web", "stdout", " hello \n\n"), ("web", "stderr", "bad\n"), ("db", "stdout", "x\n")):
        os.makedirs(tmp_path / name, exist_ok=True)
        (tmp_path / name / f"{stream}.log").write_text(text)
    read = lines.read_container_lines(spark, str(tmp_path))
    containers = spark.createDataFrame(
        [("web", True, "", ""), ("db", False, "", "")],
        "container string, enabled boolean, project string, component string",
    )
    rows = entries.from_containers(parse_lines(read), containers).collect()
    assert {(row["source"], row["message"]) for row in rows} == {("web", "hello"), ("web[stderr]", "bad")}


def test_session_files(spark, tmp_path):
    now = "2024-01-01 12:00:00"
    process = {"name": "web", "start_time": "2024-01-01T10:00:00Z", "log_count": 0,
               "last_seen": "2024-01-01T10:00:00Z", "error_count": 0, "warning_count": 0}
    for name, active, update in (("fresh", True, "11:30:00"), ("stale", True, "10:59:59"), ("stopped", False, "11:59:00")):
        (tmp_path / f"{name}.json").write_text(json.dumps(
            {"id": name * 3, "name": name, "start_time": "2024-01-01T10:00:00Z", "active": active,
             "processes": {"web": process, f"{name}-db": process}, "last_update": f"2024-01-01T{update}Z"}, indent=2))
    (tmp_path / "broken.json").write_text('{"id": "x", ')
    (tmp_path / "note.txt").write_text("{}")
    found = session_files.read_sessions(spark, str(tmp_path), F.lit(now).cast("timestamp"))
    assert {row["session"]: row["active"] for row in found.collect()} == {"fresh": True, "stale": False, "stopped": False}
    members = session_files.session_members(found)
    assert members.where("session = 'fresh'").count() == 2
    stay = sessions.cleanup_sessions(found, F.lit(now).cast("timestamp"))
    assert {row["session"] for row in stay.collect()} == {"fresh", "stopped"}


def test_top_rows_of_a_hot_stream(spark):
    rows = spark.range(20_000).selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 977) AS ts",
        "CASE WHEN id % 10 < 7 THEN 'hot' ELSE concat('s', id % 7) END AS stream",
        "lpad(cast(id AS string), 8, '0') AS id", "'m' AS message",
    )
    found = sessions.newest_per_stream(rows, 50)
    assert "WindowGroupLimit" in physical(found)
    data = {}
    for row in rows.collect():
        data.setdefault(row["stream"], []).append(row)
    expected = set()
    for stream, members in data.items():
        members.sort(key=lambda row: (-row["ts"].timestamp(), row["id"]))
        expected |= {(stream, row["id"]) for row in members[:50]}
    assert {(row["stream"], row["id"]) for row in found.collect()} == expected


def test_ids(spark, sf_dir):
    logs = fixtures.logs(spark, sf_dir)
    ids = entries.with_random_id(logs).select("id")
    assert ids.distinct().count() == logs.count()
    assert entries.with_content_id(logs).select("id").collect() == entries.with_content_id(logs).select("id").collect()


def test_untimed_rows_are_not_deduplicated(spark):
    texts = ["same text", "same text", "[2025-01-01 00:00:00] [INFO] x", "[2025-01-01 00:00:00] [INFO] x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, value string")
    rows = entries.from_pipe(parse_lines(frame, ingest_ts=F.lit("2025-01-01 00:00:00")), "stdin")
    assert entries.dedup(rows, ("n",)).select("n").orderBy("n").collect() == [(0,), (1,), (2,)]


def test_tail_json_leaves_out_empty_members(spark):
    row = spark.sql(
        "SELECT 'i' AS id, timestamp'2024-01-01 10:00:00.5' AS ts, 's' AS source, 'INFO' AS level, 'm\"q' AS message,"
        " '' AS trace_id, NULL AS process, 'c' AS component, '' AS thread, '' AS user_id, '' AS request_id,"
        " CAST(array() AS array<string>) AS tags"
    )
    text = entries.tail_json(row.withColumn("process", F.col("process").cast("string"))).first()["value"]
    assert json.loads(text) == {"id": "i", "ts": "2024-01-01T10:00:00.5Z", "source": "s", "level": "INFO",
                                "message": 'm"q', "component": "c"}


def test_newest_rows_without_reading_the_lake(spark, tmp_path):
    """Two hundred hours of three streams: one dense, one with a row in every ninth hour, one of few rows."""
    rows = spark.range(20_000).selectExpr(
        "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 36) AS ts",
        "CASE WHEN id % 900 = 0 THEN 'thin' WHEN id < 5 THEN 'old' ELSE 'dense' END AS stream",
        "'s' AS source", "'INFO' AS level", "concat('m', id % 3) AS message", "lpad(cast(id AS string), 8, '0') AS id",
    )
    root = str(tmp_path / "lake")
    lake.write_lake(rows, root)
    stored = lake.read_lake(spark, root)
    wanted = lambda frame: {(row["stream"], row["id"]) for row in frame.collect()}
    found = newest.newest_in_lake(spark, root, 10)
    assert wanted(found) == wanted(sessions.newest_per_stream(stored, 10))
    # the dense stream needs an hour, the thin one its ten newest, the old one its only one
    assert len(found.inputFiles()) <= 1 + 2 * 10 + 1
    start, end = dt.datetime(2024, 1, 2, 3, 20), dt.datetime(2024, 1, 5, 0, 10)
    inside = stored.where(filters.time_between(stored, start, end)).where("message = 'm1'")
    found = newest.newest_in_lake(spark, root, 40, start, end, F.col("message") == "m1")
    assert wanted(found) == wanted(sessions.newest_per_stream(inside, 40))
    assert newest.newest_in_lake(spark, str(tmp_path / "none")).count() == 0

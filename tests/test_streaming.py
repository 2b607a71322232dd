import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from logspark.operators import entries
from logspark.operators.parse import parse_lines
from logspark.schema import LAKE_SCHEMA
from logspark.sources import inventory, lake, lines
from logspark.streaming import counters, ingest, live, progress
from workload import fixtures

INGEST = "2024-06-01 00:00:00"


def _write_lines(spark, folder, texts):
    spark.createDataFrame([(text,) for text in texts], "value string").coalesce(1).write.mode("append").text(folder)


def _texts(count, second=0):
    return [f"[2025-01-01 00:00:{second:02d}] [INFO] message {at}" for at in range(count)]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    mixed = fixtures.mixed_lines(spark, sf_dir).where("id < 'evt-00000150'")
    mixed.select("value").unionByName(mixed.select("value")).repartition(3).write.text(source)
    rows = ingest.pipe_rows(lines.stream_lines(spark, source), "stdin", ingest_ts=F.lit(INGEST))
    query = ingest.write_stream(ingest.dedup_stream(rows), root, str(tmp_path / "cp"), interval=None)
    query.awaitTermination()
    landed = lake.read_lake(spark, root)
    assert landed.schema == LAKE_SCHEMA
    batch = entries.from_pipe(
        parse_lines(lines.read_lines(spark, source), ingest_ts=F.lit(INGEST)), "stdin"
    ).withColumn("id", F.lit(""))
    expected = lake.lake_rows(entries.dedup(batch, ("ts", "message", "trace_id")))
    columns = [name for name in LAKE_SCHEMA.fieldNames() if name != "id"]
    assert landed.select(*columns).exceptAll(expected.select(*columns)).count() == 0
    assert expected.select(*columns).exceptAll(landed.select(*columns)).count() == 0
    assert landed.select("id").distinct().count() == landed.count()
    metrics = progress.query_progress(spark, query)
    assert metrics.agg(F.sum("entries")).first()[0] > 0


def test_repeats_are_dropped_across_batches_and_late_rows_kept(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / name) for name in ("in", "lake", "cp"))

    def run():
        rows = ingest.pipe_rows(
            lines.stream_lines(spark, source, max_files_per_trigger=1), "stdin", ingest_ts=F.lit(INGEST)
        )
        ingest.write_stream(ingest.dedup_stream(rows), root, checkpoint, interval=None).awaitTermination()
        return lake.read_lake(spark, root)

    _write_lines(spark, source, _texts(5) + ["untimed"] * 2)
    assert run().count() == 7
    # the same lines again, a row far in the future, then rows far in the past
    _write_lines(spark, source, _texts(5) + ["[2035-01-01 00:00:00] [INFO] future", "untimed"])
    assert run().count() == 9
    _write_lines(spark, source, ["[2015-01-01 00:00:00] [INFO] past"] * 3)
    found = run()
    assert found.count() == 10
    assert found.where("message = 'past'").count() == 1


def test_running_counters(spark, tmp_path):
    source = str(tmp_path / "in")
    _write_lines(spark, source, _texts(3) + ["[2025-01-01 00:00:09] [ERROR] x", "[2025-01-01 00:00:01] [WARN] y"])
    rows = ingest.pipe_rows(lines.stream_lines(spark, source), "app", ingest_ts=F.lit(INGEST))
    seen = []
    query = (
        counters.running_counters(rows)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, _: seen.extend(batch.collect()))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    row = [row for row in seen if row["stream"] == "app"][-1]
    assert (row["log_count"], row["error_count"], row["warning_count"]) == (5, 1, 1)
    assert row["last_seen"] == dt.datetime(2025, 1, 1, 0, 0, 9)


def test_live_view_and_tail(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    _write_lines(spark, source, _texts(4) + ["[2025-01-01 00:00:59] [ERROR] broken"])
    stored = entries.from_pipe(parse_lines(lines.read_lines(spark, source)), "app")
    lake.write_lake(stored, root)
    rows = ingest.pipe_rows(lines.stream_lines(spark, source), "app", ingest_ts=F.lit(INGEST))
    members = spark.createDataFrame([("s", "app")], "session string, stream string")
    shown = []
    live.live_view(
        rows, root, members, "s", lambda frame: shown.append(frame.collect()), str(tmp_path / "cp1"),
        view="errors", now=lambda: dt.datetime(2025, 1, 1, 0, 30), interval=None,
    ).awaitTermination()
    assert [row["message"] for row in shown[-1]] == ["broken"]
    tail = entries.with_random_id(rows)
    live.tail_stream(tail, str(tmp_path / "tail"), str(tmp_path / "cp2"), interval=None).awaitTermination()
    assert spark.read.json(str(tmp_path / "tail")).count() == 5


def test_container_stream(spark, tmp_path):
    folder = tmp_path / "in" / "web"
    folder.mkdir(parents=True)
    (folder / "stderr.log").write_text("[2025-01-01 00:00:00] [ERROR] x\n  \n[2025-01-01 00:00:00] [ERROR] x\n")
    containers = spark.createDataFrame(
        [("web", True, "", "front")], "container string, enabled boolean, project string, component string"
    )
    rows = ingest.container_rows(lines.stream_container_lines(spark, str(tmp_path / "in")), containers)
    root = str(tmp_path / "lake")
    ingest.write_stream(rows, root, str(tmp_path / "cp"), interval=None).awaitTermination()
    found = lake.read_lake(spark, root).collect()
    assert len(found) == 2  # containers are not de-duplicated
    assert (found[0]["source"], found[0]["component"], found[0]["process"]) == ("web[stderr]", "front", "web")


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path, monkeypatch):
    root, checkpoint = str(tmp_path / "lake"), str(tmp_path / "cp")
    rows = spark.sql(
        "SELECT timestamp'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts, 'INFO' AS level,"
        " concat('s', id % 3) AS source, 'm' AS message, cast(id AS string) AS id FROM range(60)"
    )
    ingest.append_batch(rows, root, checkpoint, 0)
    ingest.append_batch(rows, root, checkpoint, 0)
    assert lake.read_lake(spark, root).count() == 60
    # the run dies after it has moved some files
    moved = []

    def part(call, paths):
        for path in list(paths)[:1]:
            moved.append(call(path))
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(ingest, "in_parallel", part)
        with pytest.raises(RuntimeError):
            ingest.append_batch(rows, root, checkpoint, 1)
    ingest.append_batch(rows, root, checkpoint, 1)
    assert len(moved) == 1 and lake.read_lake(spark, root).count() == 120


def test_grown_files_are_found(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("a", "b"):
        (source / f"{name}.log").write_text("[2025-01-01 00:00:00] [INFO] x\n")
    checkpoint = str(tmp_path / "cp")
    rows = ingest.pipe_rows(lines.stream_lines(spark, str(source)), "stdin", ingest_ts=F.lit(INGEST))
    ingest.write_stream(rows, str(tmp_path / "lake"), checkpoint, interval=None).awaitTermination()
    assert lines.grown_files(spark, str(source), checkpoint).count() == 0
    os.utime(source / "a.log", (2_000_000_000, 2_000_000_000))
    assert [row["path"].rsplit("/", 1)[1] for row in lines.grown_files(spark, str(source), checkpoint).collect()] == ["a.log"]


def test_export_metrics_outlive_the_job(spark, tmp_path, monkeypatch):
    source, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "lake"), str(tmp_path / "cp")
    assert progress.export_metrics(spark, checkpoint).count() == 0
    for at in range(3):
        _write_lines(spark, source, _texts(2, at))
    rows = ingest.pipe_rows(lines.stream_lines(spark, source, 1), "stdin", ingest_ts=F.lit(INGEST))
    run = lambda: ingest.write_stream(rows, root, checkpoint, interval=None).awaitTermination()
    with monkeypatch.context() as broken, pytest.raises(Exception, match="lost"):
        broken.setattr(ingest, "in_parallel", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        run()
    run()
    found = progress.export_metrics(spark, checkpoint)
    batches = found.where("error IS NULL").orderBy("batch_id").collect()
    assert [(row["batch_id"], row["entries"]) for row in batches] == [(0, 2), (1, 2), (2, 2)]
    files = inventory.file_inventory(spark, root).agg(F.count("*"), F.sum("length")).first()
    assert (sum(row["files"] for row in batches), sum(row["bytes"] for row in batches)) == tuple(files)
    totals = progress.export_totals(found).first()
    assert (totals["exports"], totals["entries"], totals["failures"]) == (3, 6, 1)
    assert [row["error"] for row in found.where("error IS NOT NULL").collect()] == ["OSError: lost"]


def test_a_batch_without_rows_is_closed(spark, tmp_path):
    root, checkpoint = str(tmp_path / "lake"), str(tmp_path / "cp")
    empty = spark.createDataFrame([], "ts timestamp, level string, source string, message string, id string")
    for at, rows in enumerate((empty, spark.range(9).selectExpr("timestamp'2025-01-01' AS ts", "'INFO' AS level", "'s' AS source", "'m' AS message", "'i' AS id").where("rand() > 2"))):
        ingest.append_batch(rows, root, checkpoint, at)
    assert [row["entries"] for row in progress.export_metrics(spark, checkpoint).collect()] == [0, 0]


def test_keys_are_forgotten_after_their_time(spark, tmp_path):
    """By a test clock: repeats within the time go, the same line after it is kept again."""
    source, root, checkpoint = (str(tmp_path / name) for name in ("in", "lake", "cp"))

    def arrive(clock, texts):
        rows = [(text, dt.datetime.fromisoformat(f"2024-06-01 {clock}+00:00")) for text in texts]
        spark.createDataFrame(rows, "value string, arrived timestamp").coalesce(1).write.mode("append").parquet(source)
        found = spark.readStream.schema("value string, arrived timestamp").parquet(source)
        parsed = ingest.pipe_rows(found.withColumn("ingest_ts", F.lit(INGEST)), "stdin")
        unique = ingest.dedup_stream(parsed, "1 minute", arrival=F.col("arrived"))
        ingest.write_stream(unique, root, checkpoint, interval=None).awaitTermination()
        counts = lake.read_lake(spark, root).groupBy("message").count().collect()
        return {row["message"]: row["count"] for row in counts}

    line, other = _texts(2)
    assert arrive("00:00:00", [line] * 3 + ["untimed"] * 2) == {"message 0": 1, "untimed": 2}
    assert arrive("00:00:59", [line, "untimed"]) == {"message 0": 1, "untimed": 3}
    # Its time is counted from the first row, not from the repeat.
    assert arrive("00:02:30", [other])["message 0"] == 1
    assert arrive("00:02:31", [line, line])["message 0"] == 2


def test_repeats_thin_out_before_the_shuffle(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id AS string) END AS k", "id").coalesce(1)
    found = ingest.first_in_batches(rows, "k").collect()
    hot = [row["id"] for row in found if row["k"] == "hot"]
    assert 0 in hot and len(hot) <= 3 and len(found) - len(hot) == 13_333
    assert ingest.first_in_batches(rows.where("id < 0"), "k").count() == 0


def test_one_pass_over_the_input(spark, tmp_path):
    source = str(tmp_path / "in")
    _write_lines(spark, source, _texts(3))
    batch = entries.from_pipe(parse_lines(lines.read_lines(spark, source), ingest_ts=F.lit(INGEST)), "stdin")
    plan = entries.dedup(batch, ("ts", "message"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Union" not in plan and "WindowGroupLimit" in plan
    stream = ingest.dedup_stream(ingest.pipe_rows(lines.stream_lines(spark, source), "stdin"))
    logical = stream._jdf.queryExecution().analyzed().toString()
    assert logical.count("StreamingRelation") == 1 and logical.count("DeduplicateWithinWatermark") == 1


def test_a_batch_has_one_file_for_each_small_partition(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    texts = [f"[2025-01-01 {at % 5:02d}:00:00] [INFO] message {at}" for at in range(400)]
    spark.createDataFrame([(text,) for text in texts], "value string").repartition(8).write.text(source)
    rows = ingest.pipe_rows(lines.stream_lines(spark, source), "stdin", ingest_ts=F.lit(INGEST))
    ingest.write_stream(ingest.dedup_stream(rows), root, str(tmp_path / "cp"), interval=None).awaitTermination()
    assert inventory.file_inventory(spark, root).count() == 5

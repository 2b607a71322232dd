import datetime as dt

import pytest
from pyspark.sql import functions as F

from logspark.functions import times
from logspark.functions.text import duration_text
from logspark.operators import filters, membership, search, stats
from tests.plans import physical
from workload import fixtures

NOW = dt.datetime(2024, 1, 30, 15, 4, 5)


def test_bounds_are_required():
    with pytest.raises(ValueError):
        filters.QueryFilter(None, NOW)
    with pytest.raises(ValueError):
        filters.QueryFilter(NOW, "2024-01-01")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05.250Z", dt.datetime(2024, 1, 2, 3, 4, 5, 250000)),
        ("2024-01-02", dt.datetime(2024, 1, 2)),
        ("2024-01-02T03:04", dt.datetime(2024, 1, 2, 3, 4)),
    ],
)
def test_time_bounds(text, expected):
    assert times.parse_bound(text) == expected


def test_unreadable_bounds_raise():
    for text in ("yesterday", "2024-13-01", "", "2024-01-02T03:04:05+01:00"):
        with pytest.raises(ValueError):
            times.parse_bound(text)
    assert times.parse_rfc3339("2024-01-02T03:04:05+01:00") == dt.datetime(2024, 1, 2, 2, 4, 5)
    with pytest.raises(ValueError):
        times.parse_rfc3339("2024-01-02 03:04:05")


@pytest.mark.parametrize(
    "text, seconds",
    [("1h", 3600), ("24h", 86400), ("7d", 604800), ("30d", 2592000), ("1h30m", 5400),
     ("250ms", 0.25), ("1.5h", 5400), ("-2m", -120), ("0", 0)],
)
def test_durations(text, seconds):
    assert times.parse_duration(text).total_seconds() == seconds


def test_bad_durations():
    for text in ("", "5", "3d", "1x", "h1", "1h "):
        with pytest.raises(ValueError):
            times.parse_duration(text)


def test_entry_point_defaults():
    api = filters.for_api(NOW)
    assert (api.start, api.end, api.limit) == (NOW - dt.timedelta(hours=24), NOW, 100)
    for wrong in ({"limit": 5000}, {"limit": 0}, {"offset": -3}):
        with pytest.raises(ValueError):
            filters.for_api(NOW, **wrong)
    assert filters.for_api(NOW, limit=7).limit == 7
    assert filters.for_cli_filter(NOW).limit == 100
    today = filters.for_cli_search(NOW)
    assert (today.start, today.limit) == (dt.datetime(2024, 1, 30), 1000)
    assert filters.for_last("7d", NOW).start == NOW - dt.timedelta(days=7)


def test_distinct_columns_are_checked(spark, sf_dir):
    with pytest.raises(ValueError):
        stats.distinct_values(fixtures.logs(spark, sf_dir), "message", 10)


def _messages(spark, texts):
    return spark.createDataFrame([(text,) for text in texts], "message string")


def _matched(spark, texts, wanted):
    rows = _messages(spark, texts).where(filters.message_matches(wanted)).collect()
    return [row["message"] for row in rows]


def test_message_search(spark):
    texts = ["Timeout 100% full", "a_b", "axb", "back\\slash", "Kelvin", "straſe", "x.y"]
    assert _matched(spark, texts, "TIMEOUT") == ["Timeout 100% full"]
    assert _matched(spark, texts, "a_b") == ["a_b", "axb"]
    assert _matched(spark, texts, "0% f") == ["Timeout 100% full"]
    assert _matched(spark, texts, "\\\\s") == ["back\\slash"]
    assert _matched(spark, texts, "kelvin") == ["Kelvin"]
    assert _matched(spark, texts, "strase") == ["straſe"]
    assert _matched(spark, texts, "^[a-b]") == ["a_b", "axb", "back\\slash"]


def test_bad_regex_fails_early(spark, sf_dir):
    wanted = filters.QueryFilter(NOW, NOW, message_search="(unclosed")
    with pytest.raises(ValueError):
        search.search(fixtures.logs(spark, sf_dir), wanted)


def test_tags_are_matched_untrimmed(spark):
    rows = spark.createDataFrame([("web, slow",), ("web",), ("",), (None,)], "tags string")
    assert rows.where(filters.has_tag("web")).count() == 2
    assert rows.where(filters.has_tag(" slow")).count() == 1
    assert rows.where(filters.has_tag("slow")).count() == 0


def test_search_plan(spark, sf_dir):
    logs = fixtures.logs(spark, sf_dir)
    wanted = filters.QueryFilter(dt.datetime(2024, 1, 1), NOW, limit=10, offset=5)
    plan = physical(search.search(logs, wanted))
    assert "TakeOrderedAndProject(limit=15" in plan
    assert "Exchange" not in plan and "Python" not in plan


def test_keyset_pages_equal_offset_pages(spark, sf_dir):
    logs = fixtures.logs(spark, sf_dir).withColumn("ts", F.date_trunc("DAY", "ts").cast("timestamp_ntz"))
    wanted = filters.QueryFilter(dt.datetime(2024, 1, 1), NOW, limit=37)
    page = search.search(logs, wanted).collect()
    for number in (2, 3, 4):
        page = search.search_after(logs, wanted, page[-1]["ts"], page[-1]["id"]).collect()
        assert page == search.search(logs, wanted.with_page(number, 37)).collect()


def test_run_search(spark, sf_dir):
    logs = fixtures.logs(spark, sf_dir)
    wanted = filters.QueryFilter(dt.datetime(2024, 1, 1), NOW, levels=["ERROR"], limit=5)
    result = search.run_search(logs, wanted)
    assert result.returned == 5
    assert result.total == logs.where("level = 'ERROR'").where(filters.time_between(logs, wanted.start, NOW)).count()
    assert result.entries[0]["ts"] >= result.entries[1]["ts"]


def test_membership_ways_agree(spark, sf_dir, monkeypatch):
    logs = fixtures.logs(spark, sf_dir)
    keys = logs.where("level = 'FATAL'").select("trace_id")
    joined = membership.keep_members(logs, keys, "trace_id").select("id")
    listed = membership.keep_listed(logs, keys, "trace_id").select("id")
    assert "Join" not in physical(listed)
    monkeypatch.setattr(membership, "MAX_LITERAL_KEYS", 3)
    longer = membership.keep_listed(logs, keys, "trace_id").select("id")
    assert "Join" in physical(longer)
    assert sorted(joined.collect()) == sorted(listed.collect()) == sorted(longer.collect()) != []


def test_search_envelope_is_one_pass(spark, sf_dir):
    logs = fixtures.logs(spark, sf_dir)
    wanted = filters.QueryFilter(dt.datetime(2024, 1, 1), NOW, limit=5, offset=3)
    row = search.search_envelope(logs, wanted).first()
    assert row["total"] == search.count_matches(logs, wanted).first()["total"]
    assert [entry["id"] for entry in row["entries"]] == [r["id"] for r in search.search(logs, wanted).collect()]
    assert (row["returned"], row["limit"], row["offset"], row["files_scanned"]) == (5, 5, 3, None)


def test_lake_stats(spark, sf_dir):
    logs = fixtures.logs(spark, sf_dir)
    exact, rough = stats.lake_stats(logs).first(), stats.lake_stats(logs, exact=False).first()
    assert exact["total_records"] == rough["total_records"]
    assert abs(exact["unique_sources"] - rough["unique_sources"]) <= 1
    empty = stats.lake_stats(logs.limit(0)).first()
    assert empty["total_records"] == 0 and empty["oldest"] is None


def test_unknown_stream_is_an_error(spark, sf_dir):
    files = fixtures.retention_inventory(spark, sf_dir).withColumn("dt", F.to_date("mtime"))
    with pytest.raises(ValueError):
        stats.stream_folder_info(files, "nobody")
    assert stats.stream_folder_info(files, "svc-1").count() == 1


def test_duration_text(spark):
    cases = {0.5: "0s", 1.5: "2s", 59.4: "59s", 60.0: "1m", 90.0: "2m", 150.0: "2m", 3600.0: "1.0h",
             3780.0: "1.1h", 7380.0: "2.0h", 4500.0: "1.2h", 6300.0: "1.8h", 360000.0: "100.0h"}
    rows = spark.createDataFrame([(key,) for key in cases], "s double")
    found = {row["s"]: row["t"] for row in rows.select("s", duration_text(F.col("s")).alias("t")).collect()}
    assert found == cases

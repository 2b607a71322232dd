"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import contextlib
import datetime as dt
import os
from collections.abc import Callable
from functools import partial
from unittest import mock

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.levels import normalize_level
from logspark.functions.text import duration_text
from logspark.functions.times import parse_bound, parse_rfc3339
from logspark.operators import entries, filters, render, search, sessions, stats
from logspark.operators.parse import parse_lines
from logspark.operators.patterns import DEFAULTS, Pattern
from logspark.plans import compaction, newest, retention, summaries
from logspark.schema import DISTINCT_COLUMNS
from logspark.sources import growing, inventory, publication
from logspark.sources.files import file_system, in_parallel, path_of
from logspark.sources.lake import lake_rows, read_lake, write_lake, write_sorted
from logspark.sources.lines import (
    read_container_lines,
    read_lines,
    spread,
    stream_lines,
    trim_lines,
)
from logspark.sources.session_files import read_sessions, session_members
from logspark.streaming import live, progress
from logspark.streaming.counters import running_counters
from logspark.streaming.ingest import dedup_stream, pipe_rows, write_stream
from workload import fixtures
from workload.scratch import lake_of_logs, new_folder

DAY_START = dt.datetime(2024, 1, 10)
DAY_END = dt.datetime(2024, 1, 11)
LAKE_START = dt.datetime(2024, 1, 1, 5, 30)
SPAN_END = dt.datetime(2024, 1, 9, 2, 15)
LAKE_END = dt.datetime(2024, 1, 2, 2, 15)
ROWS_FROM = dt.datetime(2024, 1, 1, 17, 20)
MONTH_START = dt.datetime(2024, 1, 1)
MONTH_END = dt.datetime(2024, 2, 1)
INGEST = "2024-06-01 12:30:45"
RETENTION_BYTES_SHARE = 4

Query = Callable[[SparkSession, str], DataFrame]


def _plain(rows: DataFrame) -> DataFrame:
    """Results with the tag array as text, so that engines can be compared."""
    return rows.withColumn("tags", F.coalesce(F.array_join("tags", ","), F.lit("")))


def _ntz(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _ntz_range(rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("oldest", "newest")})


def _newest(logs: DataFrame) -> dt.datetime:
    return logs.agg(F.max("ts")).first()[0]


# --- search -------------------------------------------------------------


def _search(spark, sf_dir, **fields) -> DataFrame:
    wanted = filters.QueryFilter(**{"start": MONTH_START, "end": MONTH_END, "limit": 100, **fields})
    return _plain(search.search(fixtures.logs(spark, sf_dir), wanted))


COMBINED = {
    "start": DAY_START,
    "end": dt.datetime(2024, 1, 20),
    "process": "svc-3",
    "message_search": "operation",
    "sources": ["svc-3", "svc-4"],
    "levels": ["ERROR", "FATAL", "WARN"],
    "tags": ["web"],
}


def flagship(spark, sf_dir) -> DataFrame:
    """Errors containing 'timeout' on one day, newest first."""
    return _search(
        spark,
        sf_dir,
        start=DAY_START,
        end=DAY_END,
        levels=["ERROR", "FATAL"],
        message_search="timeout",
    )


def search_keyset(spark, sf_dir) -> DataFrame:
    """The third page of 50, reached by the last row of the page before."""
    logs = fixtures.logs(spark, sf_dir)
    wanted = filters.QueryFilter(MONTH_START, MONTH_END, levels=["ERROR"], limit=50)
    rows = search.search(logs, wanted)
    for _ in range(2):
        last = rows.agg(F.max_by(F.struct("ts", "id"), F.struct(-F.unix_micros(F.col("ts").cast("timestamp")), "id"))).first()[0]
        rows = search.search_after(logs, wanted, last["ts"], last["id"])
    return _plain(rows)


def search_trace_table(spark, sf_dir) -> DataFrame:
    """Rows of the traces that hold an error, all rows of each trace."""
    logs = fixtures.logs(spark, sf_dir)
    broken = logs.where("level IN ('ERROR', 'FATAL') AND trace_id IS NOT NULL").select("trace_id")
    wanted = filters.QueryFilter(MONTH_START, MONTH_END)
    return _plain(search.search_traces(logs, wanted, broken))


def search_relative(spark, sf_dir, factory) -> DataFrame:
    logs = fixtures.logs(spark, sf_dir)
    return _plain(search.search(logs, factory(_newest(logs))))


def search_bounds(spark, sf_dir) -> DataFrame:
    """Bounds and limit as a request gives them: a day, a time with a zone, a checked number."""
    return _search(
        spark,
        sf_dir,
        start=parse_bound("2024-01-10"),
        end=parse_rfc3339("2024-01-12T20:30:00+02:00"),
        levels=["WARN"],
        limit=filters.checked_limit(40),
    )


def search_lake(spark, sf_dir) -> DataFrame:
    """Some days' errors of one stream, out of the folders of the lake they can be in."""
    root = lake_of_logs(spark, sf_dir, fast=False)
    wanted = filters.QueryFilter(
        LAKE_START, SPAN_END, process="svc-3", levels=["ERROR", "FATAL"], message_search="Timeout|full"
    )
    lake = read_lake(spark, root, wanted.start, wanted.end, wanted.process)
    return _plain(_ntz(search.search(lake, wanted)))


def page_info(spark, sf_dir) -> DataFrame:
    wanted = filters.QueryFilter(MONTH_START, MONTH_END, levels=["ERROR"]).with_page(3, 50)
    return search.page_info(fixtures.logs(spark, sf_dir), wanted)


def count_matches(spark, sf_dir) -> DataFrame:
    return search.count_matches(fixtures.logs(spark, sf_dir), filters.QueryFilter(**COMBINED))


def files_scanned(spark, sf_dir) -> DataFrame:
    """Hours of the range that hold rows of any stream: the lake keeps one file for each here."""
    root = lake_of_logs(spark, sf_dir, fast=False)
    return search.files_scanned(spark, root, filters.QueryFilter(LAKE_START, LAKE_END))


def search_envelope(spark, sf_dir) -> DataFrame:
    """Page and envelope in one row; the page is told by its ids."""
    wanted = filters.QueryFilter(MONTH_START, MONTH_END, levels=["ERROR"], limit=20, offset=40)
    found = search.search_envelope(fixtures.logs(spark, sf_dir), wanted)
    ids = F.array_join(F.transform("entries", lambda entry: entry["id"]), ",")
    return found.select(ids.alias("ids"), "total", "returned", "limit", "offset")


# --- statistics ---------------------------------------------------------


def distinct(spark, sf_dir, column) -> DataFrame:
    return stats.distinct_values(fixtures.logs(spark, sf_dir), column, 50)


def _inventory(spark, sf_dir) -> DataFrame:
    return fixtures.retention_inventory(spark, sf_dir).withColumn("dt", F.to_date("mtime"))


def folder_info(spark, sf_dir) -> DataFrame:
    info = stats.folder_info(_inventory(spark, sf_dir), fixtures.logs(spark, sf_dir))
    per_year = F.transform(
        F.array_sort(F.map_entries("files_per_year")),
        lambda entry: F.concat_ws(":", entry["key"].cast("string"), entry["value"].cast("string")),
    )
    return info.withColumn("files_per_year", F.array_join(per_year, ",")).withColumn(
        "years", F.array_join(F.transform("years", lambda year: year.cast("string")), ",")
    )


# --- sessions -----------------------------------------------------------


def session_view(spark, sf_dir, view, text="") -> DataFrame:
    logs = fixtures.logs(spark, sf_dir)
    shown = sessions.session_view(
        logs,
        fixtures.members(spark),
        "checkout",
        _newest(logs),
        view,
        text,
        window=dt.timedelta(days=10),
        per_stream=200,
    )
    return _plain(shown)


def newest_per_stream(spark, sf_dir) -> DataFrame:
    newest = sessions.newest_per_stream(fixtures.logs(spark, sf_dir), 25)
    return newest.select("stream", "ts", "id", "level", "message")


def newest_in_lake(spark, sf_dir) -> DataFrame:
    """The newest rows of every stream before a time inside an hour, from as few hours as hold them."""
    root = lake_of_logs(spark, sf_dir)
    rows = newest.newest_in_lake(spark, root, 25, LAKE_START, LAKE_END)
    return _ntz(rows.select("stream", "ts", "id", "level", "message"))


def process_counts(spark, sf_dir) -> DataFrame:
    return sessions.process_counts(fixtures.logs(spark, sf_dir), fixtures.members(spark))


def session_totals(spark, sf_dir) -> DataFrame:
    return sessions.session_totals(process_counts(spark, sf_dir))


def session_listing(spark, sf_dir) -> DataFrame:
    """Nation sessions with their nation's customers as processes, orders as logs."""
    known = fixtures.sessions(spark, sf_dir)
    now = F.lit(_latest(known, "last_update")).cast("timestamp_ntz")
    orders = fixtures.table(spark, sf_dir, "orders")
    customers = fixtures.table(spark, sf_dir, "customer")
    counted = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("log_count"))
    attached = customers.join(counted, "c_custkey", "left").select(
        F.concat(F.lit("session-"), F.col("c_nationkey").cast("string")).alias("session"),
        F.coalesce("log_count", F.lit(0).cast("bigint")).alias("log_count"),
        F.lit(0).cast("bigint").alias("error_count"),
        F.lit(0).cast("bigint").alias("warning_count"),
        F.lit(None).cast("timestamp_ntz").alias("last_seen"),
    )
    return sessions.session_listing(known, sessions.session_totals(attached), now)


def _latest(frame: DataFrame, column: str) -> str:
    return str(frame.agg(F.max(column)).first()[0])


def session_states(spark, sf_dir) -> DataFrame:
    """Stale sessions switched off, then the idle inactive ones removed."""
    known = fixtures.sessions(spark, sf_dir)
    now = F.lit(_latest(known, "last_update")).cast("timestamp_ntz")
    return sessions.deactivate_stale(known, now)


def session_cleanup(spark, sf_dir) -> DataFrame:
    known = fixtures.sessions(spark, sf_dir)
    now = F.lit(_latest(known, "last_update")).cast("timestamp_ntz")
    return sessions.cleanup_sessions(known, now, dt.timedelta(minutes=5))


# --- parsing and entries ------------------------------------------------


def normalize_levels(spark, sf_dir) -> DataFrame:
    """Every spelling a log level may take, and words that are none."""
    spelled = fixtures.logs(spark, sf_dir).selectExpr(
        "id",
        "CASE event_id % 6 WHEN 0 THEN lower(level) WHEN 1 THEN concat(' ', level, ' ')"
        " WHEN 2 THEN substr(level, 1, 3) WHEN 3 THEN concat(level, 'ING')"
        " WHEN 4 THEN component ELSE level END AS spelling",
    )
    return spelled.selectExpr("id", "spelling", f"{normalize_level('spelling')} AS level")


PARSE_COLUMNS = (
    "id", "ts", "level", "message", "service", "component", "trace_id", "request_id", "user_id",
    "thread", "timed",
)


def _parse(lines: DataFrame) -> DataFrame:
    return _ntz(parse_lines(lines, ingest_ts=F.lit(INGEST)))


def fields_text(column: str = "fields"):
    """A map as sorted key=value lines."""
    pairs = F.transform(
        F.array_sort(F.map_keys(column)), lambda key: F.concat(key, F.lit("="), F.col(column)[key])
    )
    return F.array_join(pairs, "\n")


def parse_shape(spark, sf_dir, shape) -> DataFrame:
    parsed = _parse(fixtures.lines(spark, sf_dir, shape))
    return parsed.select(*PARSE_COLUMNS, fields_text().alias("fields"))


def parse_mixed(spark, sf_dir) -> DataFrame:
    parsed = _parse(fixtures.mixed_lines(spark, sf_dir))
    return parsed.select("id", "ts", "level", "message", "service", "trace_id", "timed")


def parse_documents(spark, sf_dir) -> DataFrame:
    """Every line of every document: prose, so mostly nothing to recognise."""
    documents = spread(fixtures.table(spark, sf_dir, "documents"))
    lines = documents.select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "value")
    )
    parsed = _parse(lines)
    return parsed.select(
        "doc_id", "line_no", "level", "message", "ts", fields_text().alias("fields")
    )


def parse_pages(spark, sf_dir) -> DataFrame:
    """Whole pages as one text each: markup attributes are key=value pairs."""
    pages = spread(fixtures.table(spark, sf_dir, "pages"))
    return _parse(pages.select("page_id", F.col("html").alias("value"))).select("page_id", "level", fields_text().alias("fields"))


def entries_pipe(spark, sf_dir) -> DataFrame:
    parsed = _parse(fixtures.mixed_lines(spark, sf_dir))
    rows = entries.from_pipe(parsed, "stdin")
    return rows.select("id", "ts", "level", "source", "process", "stream", "message", "trace_id")


def entries_containers(spark, sf_dir) -> DataFrame:
    lines = spread(fixtures.logs(spark, sf_dir)).selectExpr(
        "id",
        "stream AS container",
        "CASE WHEN level IN ('ERROR', 'FATAL') THEN 'stderr' ELSE 'stdout' END AS stream_type",
        "concat('  ', level, ' ', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', component, ': ', message, '\t') AS value",
    )
    rows = entries.from_containers(_parse(trim_lines(lines)), fixtures.containers(spark, sf_dir))
    return rows.select("id", "ts", "level", "source", "process", "component", "stream", "message")


def _repeated(spark, sf_dir) -> DataFrame:
    """Every line three times, numbered by arrival."""
    lines = fixtures.lines(spark, sf_dir, "json_prefix").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(2)))
    )
    return lines


def dedup_lines(spark, sf_dir) -> DataFrame:
    rows = entries.from_pipe(_parse(_repeated(spark, sf_dir)), "stdin")
    rows = rows.select("id", "copy", "ts", "source", "message", "timed")
    kept = entries.dedup(rows, ("copy", "id"))
    return kept.select("id", "copy", "ts", "source", "message", entries.dedup_key().alias("dedup_key"))


_SEPARATORS = """SELECT concat('k', event_id % 50, '|5') AS message, {second} 00:00:07' AS ts, 's' AS source, event_id FROM {events}
UNION ALL SELECT concat('k', event_id % 50) AS message, {second} 00:00:05' AS ts, '7|s' AS source, event_id FROM {events}"""


def dedup_separators(spark, sf_dir) -> DataFrame:
    """Messages and sources that hold the separator: read together they look alike."""
    events = fixtures.table(spark, sf_dir, "events")
    text = _SEPARATORS.format(second="timestamp_ntz'1970-01-01", events="{events}")
    rows = spark.sql(text, events=events)
    return entries.dedup(rows, ("event_id",))


def separators_sql() -> str:
    return _SEPARATORS.format(second="TIMESTAMP '1970-01-01", events="events")


LONG_LINE = 1_200_000
# Bytes of long lines that lie on disk at a time: so many, or this part of all of them if that is more.
LINES_AT_ONCE, LINES_ROUNDS = 256 << 20, 64


def lines_long(spark, sf_dir) -> DataFrame:
    """Lines as long as the whole text of a document, each tenth of them over a mebibyte.

    The files of lines are many times as large as the documents, so they are not kept: in each round a
    share of the lines is written, read and deleted. Shares are dealt by a row's place, whatever its key is.
    """
    docs = spread(fixtures.table(spark, sf_dir, "documents").where("text <> ''"))
    lines = docs.selectExpr("doc_id % 10 = 0 AS long", "concat(doc_id, ': ', replace(replace(text, '\n', ' '), '\r', ' ')) AS line")
    times = f"cast(CASE WHEN long THEN {LONG_LINE} div length(line) + 1 ELSE 1 END AS int)"
    lines = lines.selectExpr("line", f"{times} AS times")
    total = lines.agg(F.expr("sum(octet_length(line) * bigint(times))")).first()[0] or 0
    rounds = max(1, min(LINES_ROUNDS, -(-total // LINES_AT_ONCE)))
    folder = new_folder(spark)
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(rounds)).cast("int")
    lines.withColumn("share", share).write.partitionBy("share").option("compression", "zstd").parquet(f"{folder}/shares")
    dealt = spark.read.schema("line string, times int, share int").parquet(f"{folder}/shares")
    files = file_system(spark, folder)
    for at in range(rounds):
        part = f"{folder}/lines-{at}"
        dealt.where(F.col("share") == at).selectExpr("repeat(line, times) AS value").write.text(part)
        read = read_lines(spark, part).selectExpr("length(value) AS size", "md5(value) AS digest")
        read.write.mode("append").parquet(f"{folder}/found")
        files.delete(path_of(spark, part), True)
    files.delete(path_of(spark, f"{folder}/shares"), True)
    return spark.read.parquet(f"{folder}/found")


def parse_syslog_new_year(spark, sf_dir) -> DataFrame:
    """Syslog lines without a year, taken in at the turn of the year."""
    lines = fixtures.lines(spark, sf_dir, "syslog")
    ends = lines.withColumn("value", F.regexp_replace("value", "^Jan (\\d\\d)", "Dec $1"))
    both = lines.withColumn("month", F.lit(1)).unionByName(ends.withColumn("month", F.lit(12)))
    parsed = parse_lines(both, ingest_ts=F.lit("2025-01-15 12:00:00"))
    return _ntz(parsed).select("id", "month", "ts")


def parse_kv(spark, sf_dir) -> DataFrame:
    """Pairs with quotes, dashes and repeats; the last of a repeated name counts."""
    lines = spread(fixtures.logs(spark, sf_dir)).selectExpr(
        "id",
        "concat('note a=', event_id, ' b=\"two words ', user_id, '\" a=', event_id + 1, ' user=', user_id, ' c=', level, ', end') AS value",
    )
    return _parse(lines).select("id", "user_id", fields_text().alias("fields"))


def parse_custom_pattern(spark, sf_dir) -> DataFrame:
    """A user's own format after the standard ones."""
    own = Pattern(
        name="Tildes",
        regex=r"~(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)~(\w+)~([^~]+)~(.*)",
        time_layout="yyyy-MM-dd HH:mm:ss",
        time_group=1,
        level_group=2,
        message_group=4,
        fields={"thread": 3},
    )
    lines = spread(fixtures.logs(spark, sf_dir)).selectExpr(
        "id", "concat('~', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '~', lower(level), '~', thread, '~', component, ' done') AS value"
    )
    parsed = _ntz(parse_lines(lines, ingest_ts=F.lit(INGEST), patterns=(*DEFAULTS, own)))
    return parsed.select("id", "ts", "level", "thread", "message")


def parse_fallthrough(spark, sf_dir) -> DataFrame:
    """An early format takes the line but says neither level nor time; a later one has the level."""
    lines = spread(fixtures.logs(spark, sf_dir)).selectExpr(
        "id", "concat('[', stream, '] [main] [', level, '] ', component) AS value"
    )
    return _parse(lines).select("id", "level", "message", "timed")


def parse_embedded_json(spark, sf_dir) -> DataFrame:
    """A JSON object as the message of a line, without a message of its own."""
    lines = spread(fixtures.logs(spark, sf_dir)).selectExpr(
        "id",
        "concat('[', date_format(ts, 'HH:mm:ss.SSS'), '] ', level, ' (', source, '): {\"operation\":\"', component,"
        " '\",\"entity\":\"', thread, '\",\"service\":\"other\"}') AS value",
    )
    return _parse(lines).select("id", "level", "service", "message", fields_text().alias("fields"))


def read_containers(spark, sf_dir) -> DataFrame:
    """Container logs out of their folders, one file for each container and stream."""
    folder = new_folder(spark)
    kind = F.when(F.col("level").isin("ERROR", "FATAL"), "stderr").otherwise("stdout")
    lines = fixtures.logs(spark, sf_dir).select(
        F.concat(F.lit("  "), "id", F.lit(" "), "message").alias("value"), F.col("stream").alias("container"), kind.alias("kind")
    )
    lines.repartition("container", "kind").write.partitionBy("container", "kind").text(f"{folder}/staged")
    _move_files(spark, f"{folder}/staged/container=*/kind=*/*.txt", _container_file(f"{folder}/logs"))
    return read_container_lines(spark, f"{folder}/logs").select("container", "stream_type", "value")


def _container_file(folder: str):
    def target(path: str) -> str:
        container, kind, name = path.split("/")[-3:]
        return f"{folder}/{container.split('=')[1]}/{kind.split('=')[1]}-{name}.log"

    return target


def _move_files(spark: SparkSession, pattern: str, target: Callable[[str], str]) -> None:
    files = file_system(spark, pattern.split("*")[0])
    found = [status.getPath().toString() for status in files.globStatus(path_of(spark, pattern))]

    def move(path: str) -> None:
        place = path_of(spark, target(path))
        files.mkdirs(place.getParent())
        files.rename(path_of(spark, path), place)

    in_parallel(move, found)


def session_files(spark, sf_dir) -> DataFrame:
    """Session definitions, one JSON file each, and the streams attached to them."""
    folder = new_folder(spark)
    time = lambda name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    process = F.struct(
        F.lit("web").alias("name"), time("start_time").alias("start_time"), F.lit(0).alias("log_count"),
        time("start_time").alias("last_seen"), F.lit(0).alias("error_count"), F.lit(0).alias("warning_count"),
    )
    known = fixtures.sessions(spark, sf_dir)
    file = F.struct(
        "id", F.col("session").alias("name"), time("start_time").alias("start_time"),
        F.create_map(F.concat("session", F.lit("-web")), process).alias("processes"), "active",
        time("last_update").alias("last_update"),
    )
    rows = known.select(F.to_json(file).alias("value"), F.col("session").alias("of"))
    rows.write.partitionBy("of").text(f"{folder}/staged")
    _move_files(spark, f"{folder}/staged/of=*/*.txt", lambda path: f"{folder}/all/{path.split('/')[-2][3:]}.json")
    now = F.lit(_latest(known, "last_update")).cast("timestamp")
    read = read_sessions(spark, f"{folder}/all", now)
    members = session_members(read).drop("start_time")
    joined = read.join(members, "session")
    naive = lambda name: F.col(name).cast("timestamp_ntz").alias(name)
    return joined.select("session", "stream", "id", naive("start_time"), naive("last_update"), "active")


def storage_normalize(spark, sf_dir) -> DataFrame:
    events = fixtures.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("raw_ts"))
    logs = fixtures.logs(spark, sf_dir).join(events, "event_id")
    rows = logs.select(
        F.col("raw_ts").alias("ts"),
        "id",
        "source",
        "level",
        "message",
        F.coalesce("trace_id", F.lit("")).alias("trace_id"),
        F.coalesce("process", F.lit("")).alias("process"),
        F.split(F.coalesce("tags", F.lit("")), ",").alias("tags"),
    )
    return entries.storage_rows(rows).select(
        "id", "ts", "source", "level", "message", "trace_id", "process", "tags", "component"
    )


def content_ids(spark, sf_dir) -> DataFrame:
    rows = entries.with_content_id(fixtures.logs(spark, sf_dir))
    return rows.select("id", "event_id")


def tail_json(spark, sf_dir) -> DataFrame:
    return entries.tail_json(fixtures.logs(spark, sf_dir))


# --- lake and maintenance ----------------------------------------------

STORED = ("ts", "source", "level", "message", "id", "trace_id", "process", "component",
          "thread", "user_id", "request_id", "tags")


def lake_roundtrip(spark, sf_dir) -> DataFrame:
    lake = read_lake(spark, lake_of_logs(spark, sf_dir))
    return _ntz(lake.select(*STORED, "stream", "dt", "hour"))


def _now(inventory: DataFrame):
    return F.lit(_latest(inventory, "mtime")).cast("timestamp_ntz")


COMPACTION_KEYS = ("stream", "dt")


def compaction_plan(spark, sf_dir) -> DataFrame:
    files = fixtures.compaction_inventory(spark, sf_dir)
    policy = compaction.CompactionPolicy(max_file_bytes=200_000)
    return compaction.compaction_plan(files, _now(files), policy, "name", COMPACTION_KEYS)


def compaction_totals(spark, sf_dir) -> DataFrame:
    ran_at = _now(fixtures.compaction_inventory(spark, sf_dir))
    return compaction.compaction_totals(compaction_plan(spark, sf_dir), ran_at)


def compaction_files(spark, sf_dir) -> DataFrame:
    files = fixtures.compaction_inventory(spark, sf_dir)
    policy = compaction.CompactionPolicy(max_file_bytes=200_000)
    chosen = compaction.rewrite_set(files, _now(files), policy, "name", COMPACTION_KEYS)
    return chosen.select("stream", "dt", "name", "length", "output_files")


def compaction_rewrite(spark, sf_dir) -> DataFrame:
    """A lake of small files in every stream and hour, compacted: the rows must stay the same."""
    root = f"{new_folder(spark)}/lake"
    rows = lake_rows(fixtures.logs(spark, sf_dir, fast=True))
    write_sorted(rows.repartition(6, "id"), root)
    now = F.current_timestamp() + F.expr("INTERVAL 3 HOURS")
    compaction.compact_lake(spark, root, now)
    return _stored(read_lake(spark, root))


def kept_stats(spark, sf_dir) -> DataFrame:
    """Statistics of each stream out of kept summaries.

    Two batches come in, one of them is summarised; after a compaction replaced the files of both, the new ones
    are; a third batch has no summaries yet.
    """
    root = f"{new_folder(spark)}/lake"
    rows = fixtures.logs(spark, sf_dir, fast=True)
    batch = lambda at: write_lake(rows.where(F.col("event_id") % 3 == at), root)
    batch(0)
    summaries.summarise_lake(spark, root)
    batch(1)
    now = F.current_timestamp() + F.expr("INTERVAL 3 HOURS")
    compaction.compact_lake(spark, root, now, compaction.CompactionPolicy(min_files=2))
    summaries.summarise_lake(spark, root)
    batch(2)
    return _ntz_range(summaries.kept_stats(spark, root, by_stream=True))


def search_during_compaction(spark, sf_dir) -> DataFrame:
    """A search at every step of a compaction that is stopped between two moves, taken up and cleaned up.

    Each step reads the lake anew; ``held`` is a search planned before, run after the new files count.
    """
    folder = new_folder(spark)
    root, found = f"{folder}/lake", f"{folder}/found"
    write_sorted(lake_rows(fixtures.logs(spark, sf_dir, fast=True)).repartition(6, "id"), root)
    wanted = filters.QueryFilter(LAKE_START, LAKE_END, levels=["ERROR", "FATAL"], limit=0)
    searched = lambda: _ntz(search.search(read_lake(spark, root, LAKE_START, LAKE_END), wanted)).select("id", "ts", "message")
    keep = lambda step, rows: rows.withColumn("step", F.lit(step)).write.mode("append").parquet(found)
    now = F.current_timestamp() + F.expr("INTERVAL 3 HOURS")

    def stopped(call, paths):
        in_parallel(call, list(paths)[::2])
        raise InterruptedError

    held = searched()
    keep("before", searched())
    with mock.patch.object(publication, "in_parallel", stopped), contextlib.suppress(InterruptedError):
        compaction.compact_lake(spark, root, now)
    keep("half moved", searched())
    publication.finish_runs(spark, root, grace_seconds=3600)
    keep("published", searched())
    keep("held", held)
    publication.finish_runs(spark, root)
    keep("cleaned up", searched())
    return spark.read.parquet(found)


def _stored(lake: DataFrame) -> DataFrame:
    return _ntz(lake.select("id", "ts", "level", "source", "message", "trace_id", "stream", "dt", "hour"))


def retention_apply(spark, sf_dir) -> DataFrame:
    """The rows left when the files of the first day are deleted."""
    root = lake_of_logs(spark, sf_dir)
    files = inventory.file_inventory(spark, root)
    retention.delete_files(spark, root, files.where(F.col("dt") < F.lit(LAKE_END.date())))
    return _stored(read_lake(spark, root))


def row_retention_apply(spark, sf_dir) -> DataFrame:
    """A lake after row retention whose oldest time lies inside an hour; only that hour is rewritten."""
    root = lake_of_logs(spark, sf_dir)
    retention.apply_row_retention(spark, root, ROWS_FROM + dt.timedelta(days=30))
    return _stored(read_lake(spark, root))


def _retention(spark, sf_dir) -> DataFrame:
    files = fixtures.retention_inventory(spark, sf_dir)
    total = files.agg(F.sum("length")).first()[0]
    policy = retention.RetentionPolicy(max_bytes=total // (8 * RETENTION_BYTES_SHARE) * 3)
    return retention.retention_plan(files, _now(files) - F.expr("INTERVAL 2000 DAYS"), policy)


def retention_plan(spark, sf_dir) -> DataFrame:
    return _retention(spark, sf_dir)


def retention_totals(spark, sf_dir) -> DataFrame:
    return retention.retention_totals(_retention(spark, sf_dir))


def retention_keep(spark, sf_dir) -> DataFrame:
    return retention.kept(_retention(spark, sf_dir)).select("stream", "path", "length")


def force_clean(spark, sf_dir) -> DataFrame:
    files = fixtures.retention_inventory(spark, sf_dir)
    return retention.force_clean_plan(files, _now(files), dt.timedelta(days=365))


def row_retention(spark, sf_dir) -> DataFrame:
    logs = fixtures.logs(spark, sf_dir)
    return retention.row_retention(logs, _newest(logs), 7).select("id", "ts", "level")


# --- rendering ----------------------------------------------------------


def render_cli(spark, sf_dir) -> DataFrame:
    logs = fixtures.logs(spark, sf_dir)
    return render.cli_rows(logs.select(*search.result_columns()))


def duration_texts(spark, sf_dir) -> DataFrame:
    orders = fixtures.table(spark, sf_dir, "orders")
    seconds = (F.col("o_orderkey") % 100_000).cast("double")
    return orders.select("o_orderkey", duration_text(seconds).alias("duration"))


# --- streaming ----------------------------------------------------------


def _text_files(lines: DataFrame) -> str:
    folder = f"{new_folder(lines.sparkSession)}/lines"
    lines.select("value").repartition(8).write.text(folder)
    return folder


def _ingested(rows: DataFrame) -> str:
    """Run a stream over what is there; returns the lake it made."""
    folder = new_folder(rows.sparkSession)
    query = write_stream(rows, f"{folder}/lake", f"{folder}/checkpoint", interval=None, with_ids=False)
    query.awaitTermination()
    return f"{folder}/lake"


def _landed(lake: DataFrame) -> DataFrame:
    return _ntz(lake.select("ts", "level", "source", "message", "trace_id", "stream", "dt", "hour"))


def stream_ingest(spark, sf_dir) -> DataFrame:
    """Mixed lines through the streaming job: files -> parse -> dedup -> lake."""
    folder = _text_files(fixtures.mixed_lines(spark, sf_dir, fast=True))
    rows = pipe_rows(stream_lines(spark, folder), "stdin", ingest_ts=F.lit(INGEST))
    return _landed(read_lake(spark, _ingested(dedup_stream(rows))))


def _grow(lines: DataFrame, folder: str, share: float) -> None:
    """Bring a file of each task to a share of its bytes, its last line feed left out; repeatable.

    Lines are written as they come, and the file is then cut to its share.
    """

    def write(batches):
        feed = ""
        with open(f"{folder}/{TaskContext.get().partitionId()}.log", "wb") as file:
            for batch in batches:
                if len(batch):
                    file.write((feed + "\n".join(batch.column("value").to_pylist())).encode())
                    feed = "\n"
            file.truncate(int(file.tell() * share))
        yield from ()

    lines.mapInArrow(write, "value string").count()


def stream_growing(spark, sf_dir) -> DataFrame:
    """Lines of files that grow between batches, and end in half a line each time."""
    lines = fixtures.lines(spark, sf_dir, "structured").repartition(8, "id").sortWithinPartitions("id").select("value")
    folder = new_folder(spark)
    _, logs = growing.open_folder(f"{folder}/logs")
    os.makedirs(logs)
    for share, settle in ((0.35, 3600), (0.8, 3600), (1, 0)):
        _grow(lines, logs, share)
        rows = growing.follow_lines(spark, logs, "*.log", settle_seconds=settle)
        sink = rows.select("value").writeStream.format("parquet").option("path", f"{folder}/rows")
        sink.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def stream_dedup(spark, sf_dir) -> DataFrame:
    lines = fixtures.lines(spark, sf_dir, "json_prefix", fast=True)
    folder = _text_files(lines.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2)))))
    rows = pipe_rows(stream_lines(spark, folder), "stdin", ingest_ts=F.lit(INGEST))
    landed = read_lake(spark, _ingested(dedup_stream(rows)))
    return _ntz(landed.select("ts", "source", "message", "stream", "dt", "hour"))


def stream_evict(spark, sf_dir) -> DataFrame:
    """Lines that come again: within their time they are repeats, after it they are new.

    Arrival is a test clock. The lines come at once, again half a minute later, and once more
    ten minutes later, after a line of that time has moved the watermark.
    """
    folder = new_folder(spark)
    lines = fixtures.lines(spark, sf_dir, "json_prefix", fast=True).select("value")
    moved = spark.createDataFrame([('{"timestamp":"2030-01-01T00:00:00Z","level":"INFO","service":"clock"} moved',)], "value string")
    for arrived, part in (("00:00:00", lines), ("00:00:30", lines), ("00:10:00", moved), ("00:10:01", lines)):
        clock = F.lit(f"2024-06-01 {arrived}").cast("timestamp")
        part.withColumn("arrived", clock).repartition(4).write.mode("append").parquet(f"{folder}/lines")
        found = spark.readStream.schema("value string, arrived timestamp").parquet(f"{folder}/lines")
        rows = pipe_rows(found.withColumn("ingest_ts", F.lit(INGEST)), "stdin")
        rows = dedup_stream(rows, arrival=F.col("arrived"))
        write_stream(rows, f"{folder}/lake", f"{folder}/checkpoint", interval=None, with_ids=False).awaitTermination()
    return _ntz(read_lake(spark, f"{folder}/lake").select("ts", "source", "message"))


def stream_late(spark, sf_dir) -> DataFrame:
    """Rows that arrive latest first, in batches, every row twice: none is too late."""
    logs = fixtures.logs(spark, sf_dir, fast=True)
    newest = logs.agg(F.max("ts")).first()[0]
    lines = fixtures.lines(spark, sf_dir, "json_prefix", fast=True).join(logs.select("id", "ts"), "id")
    folder = new_folder(spark)
    for at, hours in enumerate((range(0, 10), range(10, 20), range(20, 40))):
        from_, to = (newest - dt.timedelta(hours=h) for h in (hours.stop, hours.start))
        part = lines.where((F.col("ts") > F.lit(from_)) & (F.col("ts") <= F.lit(to))).select("value")
        part.unionByName(part).coalesce(2).write.mode("append").text(f"{folder}/lines")
    rows = pipe_rows(stream_lines(spark, f"{folder}/lines", 2), "stdin", ingest_ts=F.lit(INGEST))
    landed = read_lake(spark, _ingested(dedup_stream(rows)))
    return _ntz(landed.select("ts", "source", "message", "stream", "dt", "hour"))


def live_view(spark, sf_dir) -> DataFrame:
    """The list a live view shows after its last tick: the newest hour of the lake."""
    root = lake_of_logs(spark, sf_dir)
    newest = _newest(fixtures.logs(spark, sf_dir, fast=True))
    ticks = spark.readStream.schema("value string").text(_text_files(fixtures.lines(spark, sf_dir, "json").limit(8)))
    shown: list[DataFrame] = []
    query = live.live_view(
        ticks, root, fixtures.members(spark), "checkout", shown.append, f"{new_folder(spark)}/checkpoint",
        view="errors", now=lambda: newest, interval=None,
    )
    query.awaitTermination()
    return _plain(_ntz(shown[-1]))


def _batches(spark, sf_dir) -> DataFrame:
    """Structured lines as a stream of several micro-batches."""
    folder = _text_files(fixtures.lines(spark, sf_dir, "structured", fast=True))
    lines = stream_lines(spark, folder, max_files_per_trigger=3)
    return pipe_rows(lines, "stdin", ingest_ts=F.lit(INGEST))


def stream_compact(spark, sf_dir) -> DataFrame:
    """A streamed lake after compaction: the rows of its batch twin."""
    root = _ingested(_batches(spark, sf_dir))
    policy = compaction.CompactionPolicy(min_files=2)
    compaction.compact_lake(spark, root, F.current_timestamp() + F.expr("INTERVAL 3 HOURS"), policy)
    return _landed(read_lake(spark, root))


def export_metrics(spark, sf_dir) -> DataFrame:
    """What the batches of a stream recorded, read after its lake was compacted.

    ``same_files`` says whether their files and bytes were those of the lake before.
    """
    root = _ingested(_batches(spark, sf_dir))
    stored = inventory.file_inventory(spark, root).agg(F.count("*"), F.sum("length")).first()
    policy = compaction.CompactionPolicy(min_files=2)
    compaction.compact_lake(spark, root, F.current_timestamp() + F.expr("INTERVAL 3 HOURS"), policy)
    totals = progress.export_totals(progress.export_metrics(spark, f"{root.rsplit('/', 1)[0]}/checkpoint"))
    same = (F.col("files") == stored[0]) & (F.col("bytes") == stored[1])
    return totals.select("exports", "entries", "failures", same.alias("same_files"))


def stream_retain(spark, sf_dir) -> DataFrame:
    """A streamed lake after the files of its first day are deleted."""
    root = _ingested(_batches(spark, sf_dir))
    files = inventory.file_inventory(spark, root)
    retention.delete_files(spark, root, files.where(F.col("dt") < F.lit(LAKE_END.date())))
    return _landed(read_lake(spark, root))


def stream_counters(spark, sf_dir) -> DataFrame:
    """Counters kept by a stream, read after the last micro-batch."""
    folder = new_folder(spark)
    fixtures.logs(spark, sf_dir).select("ts", "stream", "level").write.parquet(f"{folder}/rows")
    rows = (
        spark.readStream.schema("ts timestamp_ntz, stream string, level string")
        .option("maxFilesPerTrigger", 2)
        .parquet(f"{folder}/rows")
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counters/batch={batch_id}")

    query = (
        running_counters(rows)
        .writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    counted = spark.read.parquet(f"{folder}/counters")
    latest = counted.agg(F.max("batch")).first()[0]
    return counted.where(F.col("batch") == latest).drop("batch")


def queries() -> dict[str, Query]:
    logs = fixtures.logs
    found: dict[str, Query] = {
        "flagship_errors": flagship,
        "search_time_range": partial(_search, start=DAY_START, end=DAY_END),
        "search_levels": partial(_search, levels=["ERROR", "FATAL"]),
        "search_sources": partial(_search, sources=["svc-1", "svc-2"]),
        "search_trace_ids": partial(_search, trace_ids=["trace-0", "trace-30", "trace-300"]),
        "search_message_text": partial(_search, message_search="TIMEOUT 100% f"),
        "search_message_wildcard": partial(_search, message_search="error%user__ T"),
        "search_message_regex": partial(_search, message_search="k=(1|2)[0-9] by user_1\\d$"),
        "search_message_backslash": partial(_search, message_search="user\\_1"),
        "search_tags_all": partial(_search, tags=["web", " slow"]),
        "search_tags_trimmed_miss": partial(_search, tags=["slow"]),
        "search_stream": partial(_search, process="svc-5"),
        "search_combined": partial(_search, **COMBINED),
        "search_page_offset": partial(_search, levels=["ERROR"], limit=50, offset=100),
        "search_all_rows": partial(_search, levels=["FATAL"], limit=0, offset=7),
        "search_reversed_bounds": partial(_search, start=DAY_END, end=DAY_START),
        "search_keyset": search_keyset,
        "search_trace_table": search_trace_table,
        "search_last_24h": partial(search_relative, factory=partial(filters.for_last, "24h")),
        "search_api_default": partial(search_relative, factory=filters.for_api),
        "search_cli_default": partial(search_relative, factory=filters.for_cli_filter),
        "search_since_start_of_day": partial(search_relative, factory=filters.for_cli_search),
        "search_bounds": search_bounds,
        "search_lake": search_lake,
        "page_info": page_info,
        "count_matches": count_matches,
        "files_scanned": files_scanned,
        "time_range": lambda spark, sf_dir: stats.time_range(logs(spark, sf_dir)),
        "stream_time_range": lambda spark, sf_dir: stats.stream_time_range(logs(spark, sf_dir)),
        "lake_stats": lambda spark, sf_dir: stats.lake_stats(logs(spark, sf_dir)),
        "kept_stats": kept_stats,
        "stream_list": lambda spark, sf_dir: stats.stream_list(logs(spark, sf_dir)),
        "lake_size": lambda spark, sf_dir: stats.lake_size(_inventory(spark, sf_dir)),
        "folder_info": folder_info,
        "quick_search": lambda spark, sf_dir: logs(spark, sf_dir)
        .where(filters.quick_match("SVC-1"))
        .select("id", "message"),
        "view_all": partial(session_view, view="all"),
        "view_errors": partial(session_view, view="errors"),
        "view_warnings": partial(session_view, view="warnings"),
        "view_traces": partial(session_view, view="traces"),
        "view_search": partial(session_view, view="all", text="PURCHASE"),
        "newest_per_stream": newest_per_stream,
        "session_process_counts": process_counts,
        "session_totals": session_totals,
        "session_listing": session_listing,
        "sessions_active": lambda spark, sf_dir: sessions.active_sessions(
            fixtures.sessions(spark, sf_dir)
        ),
        "session_lookup": lambda spark, sf_dir: sessions.active_sessions(
            fixtures.sessions(spark, sf_dir), "session-4"
        ),
        "session_states": session_states,
        "session_cleanup": session_cleanup,
        "normalize_levels": normalize_levels,
        "parse_mixed": parse_mixed,
        "parse_documents": parse_documents,
        "parse_pages": parse_pages,
        "entries_pipe": entries_pipe,
        "entries_containers": entries_containers,
        "dedup_lines": dedup_lines,
        "content_ids": content_ids,
        "storage_normalize": storage_normalize,
        "tail_json": tail_json,
        "lake_roundtrip": lake_roundtrip,
        "compaction_plan": compaction_plan,
        "compaction_totals": compaction_totals,
        "compaction_files": compaction_files,
        "compaction_rewrite": compaction_rewrite,
        "search_during_compaction": search_during_compaction,
        "retention_plan": retention_plan,
        "retention_totals": retention_totals,
        "retention_keep": retention_keep,
        "force_clean": force_clean,
        "row_retention": row_retention,
        "render_list": lambda spark, sf_dir: render.list_rows(logs(spark, sf_dir)),
        "render_cli": render_cli,
        "render_detail": lambda spark, sf_dir: render.detail_rows(logs(spark, sf_dir)),
        "render_search": lambda spark, sf_dir: render.search_rows(logs(spark, sf_dir)),
        "duration_text": duration_texts,
        "dedup_separators": dedup_separators,
        "lines_long": lines_long,
        "parse_syslog_new_year": parse_syslog_new_year,
        "parse_kv": parse_kv,
        "parse_custom_pattern": parse_custom_pattern,
        "parse_fallthrough": parse_fallthrough,
        "parse_embedded_json": parse_embedded_json,
        "read_containers": read_containers,
        "session_files": session_files,
        "live_view": live_view,
        "stream_late": stream_late,
        "search_envelope": search_envelope,
        "retention_apply": retention_apply,
        "newest_in_lake": newest_in_lake,
        "export_metrics": export_metrics,
        "row_retention_apply": row_retention_apply,
        "stream_compact": stream_compact,
        "stream_retain": stream_retain,
        "stream_ingest": stream_ingest,
        "stream_dedup": stream_dedup,
        "stream_evict": stream_evict,
        "stream_growing": stream_growing,
        "stream_counters": stream_counters,
    }
    found |= {f"distinct_{name}": partial(distinct, column=name) for name in sorted(DISTINCT_COLUMNS)}
    found |= {f"parse_{shape}": partial(parse_shape, shape=shape) for shape in fixtures.SHAPES}
    return found

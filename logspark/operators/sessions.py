"""Sessions: named groups of streams, their views and counters.

``members`` has (session, stream); ``sessions`` has session, id, start_time,
active and last_update. Spark broadcasts what it measures to be small.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions.text import duration_text, null_to_blank
from logspark.operators.filters import quick_match, time_between, view_levels
from logspark.operators.membership import keep_listed
from logspark.operators.search import newest_first, page_of, result_columns
from logspark.schema import ERROR_LEVELS, WARNING_LEVELS

PER_STREAM = 1000
SHOWN = 100
_PARTS = 64


def session_logs(logs: DataFrame, members: DataFrame, session: str) -> DataFrame:
    """Rows of the streams attached to ``session``."""
    streams = members.where(F.col("session") == session).select("stream")
    return keep_listed(logs, streams, "stream")


def newest_per_stream(logs: DataFrame, count: int = PER_STREAM) -> DataFrame:
    """The ``count`` newest rows of every stream, newest first, then by id.

    A first ranking over 64 parts of each stream leaves at most 64 * count rows
    per stream for the second one, however many rows a stream has. A task's rows
    are all of one part, so it keeps ``count`` rows per stream before the shuffle.
    """
    order = [F.col("ts").desc(), null_to_blank(F.col("id")).asc()]
    part = F.pmod(F.spark_partition_id(), F.lit(_PARTS))
    parts = logs.withColumn("_part", part)
    within_part = Window.partitionBy("stream", "_part").orderBy(*order)
    candidates = parts.withColumn("_rank", F.row_number().over(within_part)).where(
        F.col("_rank") <= count
    )
    within_stream = Window.partitionBy("stream").orderBy(*order)
    ranked = candidates.withColumn("_rank", F.row_number().over(within_stream))
    return ranked.where(F.col("_rank") <= count).drop("_rank", "_part")


def session_view(
    logs: DataFrame,
    members: DataFrame,
    session: str,
    now: dt.datetime,
    view: str = "all",
    text: str = "",
    window: dt.timedelta = dt.timedelta(hours=1),
    per_stream: int = PER_STREAM,
    shown: int = SHOWN,
    search_shown_only: bool = False,
) -> DataFrame:
    """The live list of a session: of the newest matching rows of each stream, the newest.

    View and text select before rows are cut to ``per_stream`` and ``shown``. With
    ``search_shown_only`` the traces view selects among the newest rows per stream, and
    the text among the rows shown, as a screen does that filters what it has.
    """
    rows = session_logs(logs, members, session).where(time_between(logs, now - window, now))
    levels = view_levels(view)
    if levels:
        rows = rows.where(F.col("level").isin(*levels))
    has_trace, found = F.col("trace_id") != "", quick_match(text)
    if not search_shown_only:
        rows = rows.where(has_trace) if view == "traces" else rows
        rows = rows.where(found) if text else rows
    newest = newest_per_stream(rows, per_stream).select(*result_columns(), "stream")
    if not search_shown_only:
        return page_of(newest, shown)
    listed = page_of(newest.where(has_trace) if view == "traces" else newest, shown)
    return newest_first(listed.where(found)) if text else listed


def counters() -> list[Column]:
    """Log, error and warning counts and the last time, for any grouping."""
    return [
        F.count("*").alias("log_count"),
        F.count_if(F.col("level").isin(*ERROR_LEVELS)).alias("error_count"),
        F.count_if(F.col("level").isin(*WARNING_LEVELS)).alias("warning_count"),
        F.max("ts").alias("last_seen"),
    ]


def process_counts(logs: DataFrame, members: DataFrame) -> DataFrame:
    """Counters per session and stream; a stream without logs counts zero.

    Logs are reduced to one row per stream before they meet the members.
    """
    streams = members.select("stream").distinct()
    per_stream = logs.join(streams, "stream", "left_semi").groupBy("stream").agg(*counters())
    joined = members.join(per_stream, "stream", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "session",
        "stream",
        *[F.coalesce(name, zero).alias(name) for name in ("log_count", "error_count", "warning_count")],
        "last_seen",
    )


def session_totals(process_counts: DataFrame) -> DataFrame:
    """Sums over the streams of each session."""
    return process_counts.groupBy("session").agg(
        F.count("*").alias("process_count"),
        F.sum("log_count").alias("total_logs"),
        F.sum("error_count").alias("error_count"),
        F.sum("warning_count").alias("warning_count"),
        F.max("last_seen").alias("last_activity"),
    )


def session_listing(sessions: DataFrame, totals: DataFrame, now: Column) -> DataFrame:
    """Active sessions: name, short id, duration, processes, logs, last update."""
    seconds = F.timestamp_diff("SECOND", F.col("start_time"), now).cast("double")
    joined = sessions.where("active").join(totals, "session", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        F.col("session").alias("name"),
        F.concat(F.substring("id", 1, 8), F.lit("...")).alias("id"),
        duration_text(seconds).alias("duration"),
        F.coalesce("process_count", zero).alias("processes"),
        F.coalesce("total_logs", zero).alias("logs"),
        F.date_format("last_update", "HH:mm:ss").alias("last_update"),
    )


def active_sessions(sessions: DataFrame, name: str | None = None) -> DataFrame:
    chosen = sessions.where("active")
    return chosen if name is None else chosen.where(F.col("session") == name)


def deactivate_stale(sessions: DataFrame, now: Column) -> DataFrame:
    """A session not updated for over an hour is inactive."""
    idle = F.timestamp_diff("MICROSECOND", F.col("last_update"), now)
    return sessions.withColumn("active", F.col("active") & (idle <= F.lit(3_600_000_000)))


def cleanup_sessions(
    sessions: DataFrame, now: Column, max_age: dt.timedelta = dt.timedelta(minutes=5)
) -> DataFrame:
    """Sessions that stay: all but inactive ones idle for more than ``max_age``."""
    idle = F.timestamp_diff("MICROSECOND", F.col("last_update"), now)
    limit = int(max_age.total_seconds() * 1_000_000)
    return sessions.where(~(~F.col("active") & (idle > F.lit(limit))))

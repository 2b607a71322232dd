"""The search filter: a request turned into one predicate."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.times import parse_duration, to_utc
from logspark.schema import DISTINCT_COLUMNS, ERROR_LEVELS, WARNING_VIEW_LEVELS

DEFAULT_LIMIT = 1000
API_LIMIT = 100
CLI_LIMIT = 100
MAX_API_LIMIT = 1000
API_DISTINCT_LIMIT = 50
CLI_DISTINCT_LIMIT = 100

# A character no one searches for, so that a backslash is a plain character.
_NO_ESCAPE = "\x01"
# Texts whose regex form is the text itself.
_PLAIN = re.compile(r"[A-Za-z0-9 :/@#&=,;'\"!~<>%_-]*")


@dataclass(frozen=True)
class QueryFilter:
    """Which rows to find; empty fields do not filter.

    Both time bounds are inclusive and required. ``limit <= 0`` means all rows,
    and then ``offset`` is ignored.
    """

    start: dt.datetime
    end: dt.datetime
    process: str = ""
    message_search: str = ""
    sources: Sequence[str] = ()
    levels: Sequence[str] = ()
    trace_ids: Sequence[str] = ()
    tags: Sequence[str] = ()
    limit: int = 0
    offset: int = 0

    def __post_init__(self) -> None:
        if not isinstance(self.start, dt.datetime) or not isinstance(self.end, dt.datetime):
            raise ValueError("start and end are required")

    def with_page(self, page: int, size: int) -> QueryFilter:
        """The filter for 1-based ``page`` of ``size`` rows."""
        if page < 1 or size < 1:
            raise ValueError("page and size start at 1")
        return replace(self, limit=size, offset=(page - 1) * size)


def for_range(start: dt.datetime, end: dt.datetime, **fields) -> QueryFilter:
    return QueryFilter(**{"start": start, "end": end, "limit": DEFAULT_LIMIT, **fields})


def for_last(duration: str, now: dt.datetime, **fields) -> QueryFilter:
    """The last ``1h``, ``24h``, ``7d``, ``30d`` or unit parts such as ``90m``."""
    return for_range(now - parse_duration(duration), now, **fields)


def for_api(now: dt.datetime, **fields) -> QueryFilter:
    """Last 24 hours; a limit outside 1..1000 or a negative offset raises."""
    limit, offset = fields.pop("limit", API_LIMIT), fields.pop("offset", 0)
    if offset < 0:
        raise ValueError(f"offset {offset} is negative")
    return for_last("24h", now, limit=checked_limit(limit), offset=offset, **fields)


def for_cli_filter(now: dt.datetime, **fields) -> QueryFilter:
    return for_last("24h", now, **{"limit": CLI_LIMIT, **fields})


def for_cli_search(now: dt.datetime, **fields) -> QueryFilter:
    """From the start of the day of ``now``."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return for_range(midnight, now, **fields)


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_API_LIMIT:
        raise ValueError(f"limit {limit} is not between 1 and {MAX_API_LIMIT}")
    return limit


# --- predicates ---------------------------------------------------------


def predicate(logs: DataFrame, wanted: QueryFilter) -> Column:
    """Conjunction of the supplied conditions; cheap ones come first."""
    parts = [time_between(logs, wanted.start, wanted.end)]
    if wanted.process:
        parts.append(F.col("stream") == wanted.process)
    for column, values in (
        ("source", wanted.sources),
        ("level", wanted.levels),
        ("trace_id", wanted.trace_ids),
    ):
        if values:
            parts.append(F.col(column).isin(list(values)))
    parts += [has_tag(tag) for tag in wanted.tags]
    if wanted.message_search:
        check_regex(logs.sparkSession, wanted.message_search)
        parts.append(message_matches(wanted.message_search))
    return reduce(and_, parts)


def timestamp_literal(logs: DataFrame, value: dt.datetime) -> Column:
    """A constant of the type of ``ts``, so that the comparison reaches the scan.

    It names UTC where the type has a zone, so the session's zone does not matter.
    """
    text = to_utc(value).isoformat(sep=" ", timespec="microseconds")
    kind = logs.schema["ts"].dataType
    zone = "+00:00" if kind.typeName() == "timestamp" else ""
    return F.lit(text + zone).cast(kind)


def time_between(logs: DataFrame, start: dt.datetime, end: dt.datetime) -> Column:
    """Inclusive bounds on ``ts``, repeated for the partition columns."""
    inside = (F.col("ts") >= timestamp_literal(logs, start)) & (
        F.col("ts") <= timestamp_literal(logs, end)
    )
    return inside & partitions_between(logs, start, end)


def partitions_between(logs: DataFrame, start: dt.datetime, end: dt.datetime) -> Column:
    """The dt/hour partitions that can hold rows of the range; true without them."""
    if not {"dt", "hour"} <= set(logs.columns):
        return F.lit(True)
    first, last = to_utc(start), to_utc(end)
    day, hour = F.col("dt"), F.col("hour")
    first_day, last_day = F.lit(first.date()), F.lit(last.date())
    return ((day > first_day) | ((day == first_day) & (hour >= first.hour))) & (
        (day < last_day) | ((day == last_day) & (hour <= last.hour))
    )


def message_matches(text: str, column: str = "message") -> Column:
    """Case-insensitive LIKE '%text%', or a case-insensitive regex hit.

    For text without regex characters the regex can only add hits in messages
    with non-ASCII letters (case folding), so it is tried only there.
    """
    message = F.col(column)
    like = F.ilike(message, F.lit(f"%{text}%"), F.lit(_NO_ESCAPE))
    regex = message.rlike(f"(?iu){text}")
    if _PLAIN.fullmatch(text):
        regex = (F.octet_length(message) > F.char_length(message)) & regex
    return like | regex


def check_regex(spark: SparkSession, text: str) -> None:
    """Raise before the scan when ``text`` is no valid regular expression."""
    if _PLAIN.fullmatch(text):
        return
    try:
        spark._jvm.java.util.regex.Pattern.compile(f"(?iu){text}")
    except PySparkException as error:
        raise ValueError(f"invalid search expression: {text!r}") from error


def has_tag(tag: str) -> Column:
    """The comma list holds exactly ``tag``; list items are not trimmed."""
    return F.array_contains(F.split("tags", ",", -1), tag)


def non_empty(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def distinct_column(column: str) -> str:
    if column not in DISTINCT_COLUMNS:
        raise ValueError(f"invalid column name: {column}")
    return column


def view_levels(view: str) -> Sequence[str]:
    """Levels a view asks for before ranking; empty means all."""
    return {
        "all": (),
        "errors": ERROR_LEVELS,
        "warnings": WARNING_VIEW_LEVELS,
        "traces": (),
    }[view]


def quick_match(text: str) -> Column:
    """Lower-case substring in message, source, process or level."""
    needle = F.lit(text.lower())
    columns = ("message", "source", "process", "level")
    return reduce(
        or_,
        [F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), needle) for name in columns],
    )

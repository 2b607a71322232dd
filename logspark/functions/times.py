"""Time texts -> UTC timestamps, as expressions and as driver-side values.

Each layout is a shape test followed by one cast, so text in another shape
gives NULL instead of a guess. The session time zone is UTC (runtime.prepare).
"""

from __future__ import annotations

import datetime as dt
import re

from logspark.functions.sqltext import coalesce, literal, literals, when

_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"

# Layout names. Any other name is taken as a Spark datetime pattern.
ZONED = "rfc3339"
SPACED = "yyyy-MM-dd HH:mm:ss"
UNZONED = "yyyy-MM-dd'T'HH:mm:ss"
SYSLOG = "MMM d HH:mm:ss"
CLOCK_MILLIS = "HH:mm:ss.SSS"
CLOCK = "HH:mm:ss"

_SHAPES = {
    ZONED: rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_CLOCK}(?:Z|[+-]\d{{2}}:\d{{2}})\z",
    SPACED: rf"^\d{{4}}-\d{{2}}-\d{{2}} +{_CLOCK}\z",
    UNZONED: rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_CLOCK}\z",
    SYSLOG: rf"^[A-Za-z]{{3}} +\d{{1,2}} +{_CLOCK}\z",
    CLOCK_MILLIS: r"^\d{1,2}:\d{2}:\d{2}\.\d{3}\z",
    CLOCK: rf"^{_CLOCK}\z",
}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def parse_time(text: str, layout: str, ingest_ts: str) -> str:
    """Text in ``layout`` -> TIMESTAMP, or NULL (SQL text in, SQL text out).

    Clock times fall on the ingest day. Syslog times fall in the year that puts them
    last before the day after ingest.
    """
    if layout not in _SHAPES:
        return f"try_to_timestamp({text}, {literal(layout)})"
    dotted = f"replace({text}, ',', '.')"
    if layout in (SPACED, SYSLOG):
        dotted = f"regexp_replace({dotted}, ' +', ' ')"
    if layout == SYSLOG:
        value = _syslog_time(dotted, ingest_ts)
    elif layout in (CLOCK, CLOCK_MILLIS):
        value = f"try_cast(date_format({ingest_ts}, 'yyyy-MM-dd ') || {dotted} AS timestamp)"
    else:
        value = f"try_cast({dotted} AS timestamp)"
    return when(f"{text} RLIKE {literal(_SHAPES[layout])}", value)


def _syslog_time(text: str, ingest_ts: str) -> str:
    month = f"array_position(array({literals(_MONTHS)}), lower(substr({text}, 1, 3)))"
    rest = f"'-' || nullif({month}, 0) || '-' || substr({text}, 5)"
    in_year = lambda years: f"try_cast((year({ingest_ts}) + {years}) || {rest} AS timestamp)"
    latest = f"({ingest_ts} + INTERVAL 1 DAY)"
    candidates = [when(f"{in_year(years)} <= {latest}", in_year(years)) for years in (1, 0)]
    # 29 February is a real date even when neither year has it.
    in_leap_year = f"try_cast('2000' || {rest} AS timestamp)"
    known = when(in_leap_year + " IS NOT NULL", ingest_ts)
    return f"coalesce({', '.join([*candidates, in_year(-1)])}, {known})"


def parse_json_time(text: str, ingest_ts: str) -> str:
    """Layouts allowed inside JSON lines; numeric epochs are not."""
    return coalesce(*[parse_time(text, name, ingest_ts) for name in (ZONED, SPACED, UNZONED)])


# --- driver-side values -------------------------------------------------

# Layouts accepted for a time bound in a request.
_BOUND_FORMATS = (
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%SZ",
    "%Y-%m-%dT%H:%M:%S.%fZ",
    "%Y-%m-%d",
    "%Y-%m-%dT%H:%M",
)
# Units of a duration.
_UNIT_SECONDS = {
    "ns": 1e-9,
    "us": 1e-6,
    "\u00b5s": 1e-6,
    "\u03bcs": 1e-6,
    "ms": 1e-3,
    "s": 1.0,
    "m": 60.0,
    "h": 3600.0,
}
_DURATION_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|\u00b5s|\u03bcs|ms|s|m|h)")


def to_utc(value: dt.datetime) -> dt.datetime:
    """Naive UTC value of a datetime with or without a zone."""
    if value.tzinfo is None:
        return value
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None)


def parse_bound(text: str) -> dt.datetime:
    """A request's time bound; raises on anything unreadable."""
    for layout in _BOUND_FORMATS:
        try:
            return dt.datetime.strptime(text, layout)
        except ValueError:
            continue
    raise ValueError(f"invalid time: {text!r}")


def parse_rfc3339(text: str) -> dt.datetime:
    if not re.match(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$", text):
        raise ValueError(f"invalid RFC 3339 time: {text!r}")
    return to_utc(dt.datetime.fromisoformat(text))


def parse_duration(text: str) -> dt.timedelta:
    """``7d`` and ``30d``, or unit parts such as ``1h30m`` and ``250ms``."""
    if text in ("7d", "30d"):
        return dt.timedelta(days=int(text[:-1]))
    body = text[1:] if text[:1] in "+-" else text
    sign = -1 if text[:1] == "-" else 1
    if body == "0":
        return dt.timedelta(0)
    parts = _DURATION_PART.findall(body)
    if not parts or "".join(number + unit for number, unit in parts) != body:
        raise ValueError(f"invalid duration: {text!r}")
    return sign * dt.timedelta(
        seconds=sum(float(number) * _UNIT_SECONDS[unit] for number, unit in parts)
    )

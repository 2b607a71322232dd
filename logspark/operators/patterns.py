"""Line formats the parser knows, in the order they are tried."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from logspark.functions import times


@dataclass(frozen=True)
class Pattern:
    """A regular expression and the meaning of its groups (0 = not captured).

    The expression covers the whole line unless ``anywhere`` is set.
    ``time_layout`` is a name from ``functions.times`` or a Spark datetime
    pattern. ``fields`` maps a field name to its group.
    """

    name: str
    regex: str
    time_layout: str = ""
    time_group: int = 0
    level_group: int = 0
    message_group: int = 0
    fields: Mapping[str, int] = field(default_factory=dict)
    anywhere: bool = False

    @property
    def line_regex(self) -> str:
        # (?d): only a line feed ends a line.
        return f"(?d){self.regex}" if self.anywhere else rf"(?d)\A(?:{self.regex})\z"


_S = r"[\t\n\f\r ]"
_NOT_S = r"[^\t\n\f\r ]"
_LEVELS = r"(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|PANIC)"

# The line formats.
DEFAULTS = (
    Pattern(
        name="Structured KV with Timestamp",
        regex=r"(?i)(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)"
        + rf"{_S}+\[{_LEVELS}\]{_S}+\[([^\]]+)\]{_S}+(.+)",
        time_layout=times.ZONED,
        time_group=1,
        level_group=2,
        message_group=4,
        fields={"service": 3},
    ),
    Pattern(
        name="Syslog",
        regex=rf"(\w{{3}}{_S}+\d{{1,2}}{_S}+\d{{2}}:\d{{2}}:\d{{2}}){_S}+{_NOT_S}+{_S}+"
        + rf"({_NOT_S}+)(?:\[\d+\])?{_S}*:{_S}*(?:\[(\w+)\])?{_S}*(.+)",
        time_layout=times.SYSLOG,
        time_group=1,
        level_group=3,
        message_group=4,
        fields={"service": 2},
    ),
    Pattern(
        name="JSON Prefix",
        regex=r'\{"timestamp":"([^"]+)","level":"(\w+)"(?:,"service":"([^"]+)")?\}'
        + rf"{_S}*(.*)",
        time_layout=times.ZONED,
        time_group=1,
        level_group=2,
        message_group=4,
        fields={"service": 3},
    ),
    Pattern(
        name="Simple Bracketed",
        regex=rf"\[([^\]]+)\]{_S}+\[(\w+)\]{_S}+(.+)",
        time_layout=times.SPACED,
        time_group=1,
        level_group=2,
        message_group=3,
    ),
    Pattern(
        name="Level First",
        regex=rf"(\w+){_S}+(\d{{4}}-\d{{2}}-\d{{2}}{_S}+\d{{2}}:\d{{2}}:\d{{2}})"
        + rf"{_S}+({_NOT_S}+):{_S}+(.+)",
        time_layout=times.SPACED,
        time_group=2,
        level_group=1,
        message_group=4,
        fields={"service": 3},
    ),
    Pattern(
        name="Generic Bracketed Level",
        regex=rf"(?i)\[{_LEVELS}\]",
        level_group=1,
        anywhere=True,
    ),
    Pattern(
        name="Bracketed Time Level Service JSON",
        regex=rf"\[(\d{{2}}:\d{{2}}:\d{{2}}\.\d+)\]{_S}+(\w+){_S}+\(([^)]+)\):{_S}+(.+)",
        time_layout=times.CLOCK_MILLIS,
        time_group=1,
        level_group=2,
        message_group=4,
        fields={"service": 3},
    ),
)


def supported_formats(spark: SparkSession, patterns: tuple[Pattern, ...] = DEFAULTS) -> DataFrame:
    """The formats in the order they are tried."""
    rows = [(at, pattern.name) for at, pattern in enumerate(patterns, start=1)]
    return spark.createDataFrame(rows, "position int, name string")

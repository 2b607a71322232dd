"""Strict JSON-object lines as an array of scalar members.

Spark's JSON reader stops at the end of the first value and ignores what
follows. A line is exactly one object when it parses both inside ``[...]`` and
inside ``{"k":...}``: text left over would have to go on with ``]`` for the
first wrap and with ``}`` or ``,`` for the second, which no text does.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from logspark.functions.sqltext import coalesce, literal, literals, opaque, trim_space, when

_STRICT = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"

# Member names (lower case) and the column each one fills.
MEMBER_ALIASES = {
    "level": ("level", "severity", "loglevel"),
    "message": ("message", "msg", "text"),
    "ts": ("timestamp", "time", "ts", "@timestamp"),
    "service": ("service", "servicename", "svc"),
    "component": ("component", "comp", "logger", "context"),
    "trace_id": ("trace_id", "traceid", "trace"),
    "request_id": ("request_id", "requestid", "req_id"),
    "user_id": ("user_id", "userid", "user"),
    "thread": ("thread", "threadid", "tid"),
}
KNOWN_MEMBERS = tuple(name for names in MEMBER_ALIASES.values() for name in names)


def with_members(
    frame: DataFrame, text: str, wanted: str, out: str, also: Mapping[str, str] | None = None
) -> DataFrame:
    """Add the scalar members of a text that is one JSON object.

    ``{out}_keys``, ``{out}_values`` and ``{out}_aliases`` (lower-case keys) run
    from last to first, so the first hit for a name is its last occurrence.
    They are NULL when the text is not an object. Nested values and nulls are
    left out. ``also`` replaces other columns in the first of the projections.
    """
    # Cheap tests first: a failed parse costs far more than a text check.
    trimmed = trim_space(text)
    tried = (
        f"{wanted} AND contains({text}, '{{') AND startswith({trimmed}, '{{') "
        f"AND endswith({trimmed}, '}}')"
    )
    listed = f"from_json('[' || {text} || ']', 'array<map<string,string>>', {_STRICT})"
    nested = f"from_json('{{\"k\":' || {text} || '}}', 'struct<k:map<string,variant>>', {_STRICT})"
    others = also or {}
    frame = frame.selectExpr(
        *[f"`{name}`" for name in frame.columns if name not in others],
        *[f"{opaque(value)} AS `{name}`" for name, value in others.items()],
        f"{opaque(when(tried, listed))} AS {out}_listed",
        f"{opaque(when(tried, nested))} AS {out}_nested",
    )
    whole = (
        f"size({out}_listed) = 1 AND {out}_listed[0] IS NOT NULL AND {out}_nested.k IS NOT NULL"
    )
    bracketed = "(startswith(e.value, '{') OR startswith(e.value, '['))"
    scalar = f"e.value IS NOT NULL AND (NOT {bracketed} OR schema_of_variant(v) = 'STRING')"
    pairs = (
        f"zip_with(map_entries({out}_listed[0]), map_values({out}_nested.k), (e, v) -> "
        f"named_struct('key', e.key, 'value', e.value, 'scalar', {scalar}))"
    )
    members = f"reverse(filter({pairs}, m -> m.scalar))"
    frame = frame.selectExpr("*", f"{opaque(when(whole, members))} AS {out}").drop(
        f"{out}_listed", f"{out}_nested"
    )
    aliases = f"transform({out}.key, k -> lower(k))"
    return frame.selectExpr(
        "*",
        f"{opaque(out + '.key')} AS {out}_keys",
        f"{opaque(out + '.value')} AS {out}_values",
        f"{opaque(aliases)} AS {out}_aliases",
    ).drop(out)


def member_value(out: str, alias: str) -> str:
    """Value of the last member called ``alias``, or NULL."""
    return f"get({out}_values, int(array_position({out}_aliases, {literal(alias)})) - 1)"


def exact_value(out: str, key: str) -> str:
    """Value of the last member spelled exactly ``key``, or NULL."""
    return f"get({out}_values, int(array_position({out}_keys, {literal(key)})) - 1)"


def member(out: str, target: str) -> str:
    """Value for a known column; with several aliases present the first
    listed one counts."""
    return coalesce(*[member_value(out, alias) for alias in MEMBER_ALIASES[target]])


def is_other(out: str) -> str:
    """Per member: whether it fills no known column."""
    return f"transform({out}_aliases, a -> a NOT IN ({literals(KNOWN_MEMBERS)}))"


def pick_others(out: str, part: str) -> str:
    """Keys or values of the members flagged in ``{out}_is_other``, first to last."""
    return f"reverse(filter({out}_{part}, (x, i) -> {out}_is_other[i]))"

"""key=value pairs inside a message."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logspark.functions.sqltext import literal, literals, opaque, when

# A word, '=', then a quoted text or a run without white space and commas.
# The look-behind and the possessive loops keep long words and long quoted
# texts linear without changing what matches.
PAIR = (
    r"(?<!\w)\w++=(?:"
    r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"'
    r"|[^\t\n\f\r ,]+)"
)

# Keys (lower case) and the column each one fills.
KEY_ALIASES = {
    "trace_id": ("trace_id", "traceid", "trace"),
    "request_id": ("request_id", "requestid", "req_id"),
    "user_id": ("user_id", "userid", "user"),
    "component": ("component", "comp"),
    "thread": ("thread", "tid"),
}
SERVICE_KEYS = ("service", "svc")


def with_pairs(frame: DataFrame, message: str, wanted: str) -> DataFrame:
    """Add ``_keys``, ``_aliases`` (lower-case keys) and ``_values``, all from
    the last pair to the first."""
    tried = f"{wanted} AND contains({message}, '=')"
    found = when(tried, f"reverse(regexp_extract_all({message}, {literal(PAIR)}, 0))")
    frame = frame.selectExpr("*", f"{opaque(found)} AS _found")
    keys = "transform(_found, p -> substring_index(p, '=', 1))"
    aliases = "transform(_found, p -> lower(substring_index(p, '=', 1)))"
    values = "transform(_found, p -> btrim(substr(p, instr(p, '=') + 1), '\"'))"
    return frame.selectExpr(
        "*",
        f"{opaque(keys)} AS _keys",
        f"{opaque(aliases)} AS _aliases",
        f"{opaque(values)} AS _values",
    ).drop("_found")


def last_value(target: str) -> str:
    """Value of the last pair that fills ``target``, or NULL."""
    spots = ", ".join(
        f"nullif(array_position(_aliases, {literal(alias)}), 0)" for alias in KEY_ALIASES[target]
    )
    return f"get(_values, int(least({spots})) - 1)"


def first_service() -> str:
    """First non-empty service value, or NULL."""
    named = (
        f"filter(arrays_zip(_aliases, _values), p -> p._aliases IN ({literals(SERVICE_KEYS)}) "
        "AND p._values != '')"
    )
    return f"try_element_at({named}, -1)._values"


def last_wins_map(keys: str, values: str) -> str:
    """Two arrays -> map; of equal keys the last one stays.

    Both must be columns of the frame, not computed expressions: they are read
    more than once. Unique keys, the usual case, need no sort.
    """
    ordered = (
        f"array_sort(zip_with({keys}, transform({values}, (v, i) -> named_struct('at', i, 'value', v)), "
        "(k, v) -> named_struct('key', k, 'at', v.at, 'value', v.value)))"
    )
    marked = (
        "zip_with(o, slice(o, 2, size(o)), (p, next) -> named_struct("
        "'key', p.key, 'value', p.value, 'last', next.key IS NULL OR next.key != p.key))"
    )
    kept = (
        f"transform(filter({marked}, p -> p.last AND p.key IS NOT NULL), "
        "p -> struct(p.key, p.value))"
    )
    # The one-element array binds the sorted list once for the lambda.
    deduplicated = f"transform(array({ordered}), o -> map_from_entries({kept}))[0]"
    return when(
        f"size(array_distinct({keys})) = size({keys})",
        f"map_from_arrays({keys}, {values})",
        deduplicated,
    )

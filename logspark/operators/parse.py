"""Raw lines -> structured log rows, in native column expressions.

A line is first tried as one JSON object, then against each pattern until one
gives a level or a time. A pattern that matches without giving either still
sets message and service, and the search goes on. Key=value pairs and a JSON
object inside the message then fill the remaining columns.

The patterns are tested in order; from the first match on they are one fold over
the line. The other steps are projections of their own, so every JSON parse is
evaluated at most once per line and only on lines that reach it. There is no
shuffle and no Python in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import jsonline, keyvalue
from logspark.functions.levels import UNKNOWN, normalize_level
from logspark.functions.sqltext import (
    coalesce,
    literal,
    opaque,
    own_stage,
    strip_ansi,
    trim_space,
    when,
)
from logspark.functions.times import parse_json_time, parse_time
from logspark.operators.patterns import DEFAULTS, Pattern
from logspark.runtime import require_utc

PARSED_COLUMNS = (
    "ts",
    "level",
    "message",
    "service",
    "component",
    "trace_id",
    "request_id",
    "user_id",
    "thread",
    "fields",
    "raw_line",
    "timed",
)

# Pattern field names and the column each one fills.
_FIELD_COLUMNS = {
    "service": ("service",),
    "component": ("component",),
    "trace_id": ("trace_id", "traceid"),
    "request_id": ("request_id", "requestid"),
    "user_id": ("user_id", "userid", "user"),
    "thread": ("thread",),
}
_FALLBACK_MESSAGE = "JSON log entry"


def parse_lines(
    lines: DataFrame,
    value: str = "value",
    ingest_ts: Column | None = None,
    patterns: Sequence[Pattern] = DEFAULTS,
) -> DataFrame:
    """Replace the text column ``value`` by the parsed columns.

    ``ingest_ts`` dates lines without a usable time (default: query time).
    ``timed`` tells whether the line carried its own time. Absent texts are
    NULL. Other input columns are kept. Filter on those before parsing: a
    filter on the result is not moved below the parser.
    """
    require_utc(lines.sparkSession)
    ingest = F.current_timestamp() if ingest_ts is None else ingest_ts.cast("timestamp")
    kept = [F.col(name) for name in lines.columns if name != value]
    frame = lines.select(
        *kept, F.expr(f"{strip_ansi(f'`{value}`')} AS _line"), ingest.alias("_ingest")
    )
    frame = _read_json_line(frame, patterns)
    frame = _try_patterns(frame, patterns)
    frame = _read_pairs(frame)
    frame = _read_json_message(frame)
    frame = _collect_fields(frame)
    return frame.select(*kept, *[F.expr(f"{_output(name)} AS {name}") for name in PARSED_COLUMNS])


def _replace(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One projection that adds or replaces ``columns``."""
    same = [f"`{name}`" for name in frame.columns if name not in columns]
    new = [f"{opaque(text)} AS `{name}`" for name, text in columns.items()]
    return frame.selectExpr(*same, *new)


def _read_json_line(frame: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Add ``_j``: what a line that is one JSON object says, else NULL; and
    ``_first``: the first pattern that matches a line that JSON did not explain.
    """
    frame = jsonline.with_members(frame, "_line", "true", "_json")
    found = "_json_keys IS NOT NULL"
    time_aliases = jsonline.MEMBER_ALIASES["ts"]
    picks = [
        f"'{name}', {jsonline.member('_json', name)}"
        for name in jsonline.MEMBER_ALIASES
        if name != "ts"
    ]
    picks += [
        f"'time{at}', {jsonline.member_value('_json', alias)}"
        for at, alias in enumerate(time_aliases)
    ]
    picks.append(f"'action', {_action_text('_json')}")
    frame = _replace(
        frame,
        {
            "_picked": when(found, f"named_struct({', '.join(picks)})"),
            "_json_is_other": jsonline.is_other("_json"),
        },
    )
    read = [parse_json_time(f"_picked.time{at}", "_ingest") for at in range(len(time_aliases))]
    texts = [
        f"'{name}', nullif(_picked.{name}, '')"
        for name in (*jsonline.MEMBER_ALIASES, "action")
        if name not in ("ts", "level")
    ]
    parts = [
        f"'level', {normalize_level("coalesce(_picked.level, '')")}",
        f"'ts', {coalesce(*read)}",
        *texts,
        f"'keys', {jsonline.pick_others('_json', 'keys')}",
        f"'values', {jsonline.pick_others('_json', 'values')}",
    ]
    frame = _replace(frame, {"_j": when(found, f"named_struct({', '.join(parts)})")})
    accepted = (
        f"_j.level != '{UNKNOWN}' OR _j.ts IS NOT NULL OR _j.trace_id IS NOT NULL"
        " OR _j.component IS NOT NULL OR size(_j.keys) > 0"
    )
    accepted = f"coalesce({accepted}, false)"
    matches = " ".join(
        f"WHEN _line RLIKE {literal(pattern.line_regex)} THEN {at}"
        for at, pattern in enumerate(patterns)
    )
    return frame.selectExpr(
        "* EXCEPT (_json_keys, _json_values, _json_aliases, _json_is_other, _picked)",
        f"{opaque(accepted)} AS _accepted",
        f"{opaque(f'CASE WHEN {accepted} THEN NULL {matches} END')} AS _first",
        f"{opaque(_mark())} AS _mark",
    )


def _try_patterns(frame: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Read the first match; if it gives neither level nor time, which is rare,
    fold the later patterns over the line until one does."""
    captures = " ".join(f"WHEN {at} THEN {_capture(pattern)}" for at, pattern in enumerate(patterns))
    frame = _replace(frame, {"_groups": when("_first IS NOT NULL", own_stage(f"CASE _first {captures} END"))})
    frame = _replace(frame, _first_match(patterns))
    last = len(patterns) - 1
    state = [f"'good', false, 'level', '{UNKNOWN}', 'ts', CAST(NULL AS timestamp)"]
    state += ["'message', _hit_message"]
    state += [f"'{target}', coalesce(_hit_{target}, _j.{target}, '')" for target in _FIELD_COLUMNS]
    state += [f"'{part}', _hit_{part}" for part in ("keys", "values")]
    steps = " ".join(f"WHEN {at} THEN {_step(pattern)}" for at, pattern in enumerate(patterns))
    folded = (
        f"reduce(sequence(_first + 1, {last}), named_struct({', '.join(state)}), "
        f"(s, i) -> CASE WHEN s.good THEN s ELSE CASE i {steps} END END)"
    )
    unread = f"_first < {last} AND _hit_level = '{UNKNOWN}' AND _hit_ts IS NULL"
    frame = _replace(frame, {"_p": when(unread, folded)})
    columns = {
        "_level": when(
            "_accepted",
            f"CASE _j.level WHEN '{UNKNOWN}' THEN 'INFO' ELSE _j.level END",
            f"coalesce(_p.level, _hit_level, '{UNKNOWN}')",
        ),
        "_ts": when("_accepted", "_j.ts", "coalesce(_p.ts, _hit_ts)"),
        "_message": when(
            "_accepted",
            _json_text("coalesce(_j.message, _line)"),
            "coalesce(_p.message, _hit_message, _j.message, _line)",
        ),
    }
    columns |= {
        f"_{target}": f"coalesce(_p.{target}, _hit_{target}, _j.{target}, '')"
        for target in _FIELD_COLUMNS
    }
    columns |= {f"_pattern_{part}": f"coalesce(_p.{part}, _hit_{part})" for part in ("keys", "values")}
    used = [name for name in frame.columns if name.startswith("_hit_")]
    return _replace(frame, columns).drop("_mark", "_first", "_groups", "_p", *used)


def _first_match(patterns: Sequence[Pattern]) -> dict[str, str]:
    """Columns read from ``_groups`` of the pattern ``_first``."""

    def by_pattern(texts: dict[int, str]) -> str:
        if not texts:
            return "NULL"
        return f"CASE _first {' '.join(f'WHEN {at} THEN {text}' for at, text in texts.items())} END"

    layouts = dict.fromkeys(pattern.time_layout for pattern in patterns if pattern.time_group)
    times = " ".join(
        f"WHEN _first IN ({', '.join(str(at) for at, pattern in enumerate(patterns) if pattern.time_group and pattern.time_layout == layout)})"
        f" THEN {parse_time('_groups[1]', layout, '_ingest')}"
        for layout in layouts
    )
    with_message = [str(at) for at, pattern in enumerate(patterns) if pattern.message_group]
    message = "coalesce(_j.message, _line)"
    if with_message:
        message = when(f"_first IN ({', '.join(with_message)})", trim_space("_groups[3]"), message)
    columns = {
        "_hit_level": when("_first IS NOT NULL", own_stage(normalize_level("_groups[2]"))),
        "_hit_ts": f"CASE {times} END" if times else "CAST(NULL AS timestamp)",
        "_hit_message": when("_first IS NOT NULL", message),
    }
    for target, names in _FIELD_COLUMNS.items():
        found = {}
        for at, pattern in enumerate(patterns):
            latest = [f"nullif({text}, '')" for name, text in _fields(pattern, "_groups") if name in names]
            if latest:
                found[at] = coalesce(*reversed(latest))
        columns[f"_hit_{target}"] = f"CAST({by_pattern(found)} AS string)"
    for part in ("keys", "values"):
        parts = {
            at: _field_array(pattern, "_groups", part)
            for at, pattern in enumerate(patterns)
            if pattern.fields
        }
        nothing = "CAST(array() AS array<string>)"
        columns[f"_hit_{part}"] = when(
            "_first IS NOT NULL", f"coalesce({by_pattern(parts)}, {nothing})"
        )
    return columns


def _step(pattern: Pattern) -> str:
    """State after one pattern: unchanged ``s`` unless the line matches.

    One-element arrays bind the groups (``g``) and the level and time (``f``).
    """
    level = normalize_level("g[2]") if pattern.level_group else "s.level"
    ts = parse_time("g[1]", pattern.time_layout, "_ingest") if pattern.time_group else "s.ts"
    state = [
        f"'good', f.level != '{UNKNOWN}' OR f.ts IS NOT NULL",
        "'level', f.level",
        "'ts', f.ts",
        f"'message', {trim_space('g[3]') if pattern.message_group else 's.message'}",
    ]
    for target, names in _FIELD_COLUMNS.items():
        latest = [f"nullif({text}, '')" for name, text in _fields(pattern, "g") if name in names]
        state.append(f"'{target}', {coalesce(*reversed(latest), f's.{target}')}")
    for part in ("keys", "values"):
        state.append(f"'{part}', concat(s.{part}, {_field_array(pattern, 'g', part)})")
    found = (
        f"transform(array(named_struct('level', {level}, 'ts', {ts})), "
        f"f -> named_struct({', '.join(state)}))[0]"
    )
    return f"transform(array({_capture(pattern)}), g -> {when('size(g) > 1', found, 's')})[0]"


def _fields(pattern: Pattern, groups: str) -> list[tuple[str, str]]:
    """The pattern's field names with the expressions of their groups."""
    return [(name, f"{groups}[{at}]") for at, name in enumerate(pattern.fields, start=4)]


def _field_array(pattern: Pattern, groups: str, part: str) -> str:
    """Keys or values of the fields a match fills."""
    nothing = "CAST(array() AS array<string>)"
    filled = [
        when(f"{text} != ''", f"array({literal(name) if part == 'keys' else text})", nothing)
        for name, text in _fields(pattern, groups)
    ]
    return f"concat({', '.join(filled)})" if filled else nothing


def _capture(pattern: Pattern) -> str:
    """``['', time, level, message, fields...]``, or one text without a match.

    One replacement marks every group, so the regex runs once however many
    groups it has. ``_mark`` does not occur in the line.
    """
    groups = [pattern.time_group, pattern.level_group, pattern.message_group]
    groups += pattern.fields.values()
    regex = literal(pattern.line_regex)
    if pattern.anywhere:
        texts = ", ".join(
            f"regexp_extract(_line, {regex}, {group})" if group else "''" for group in groups
        )
        return when(f"_line RLIKE {regex}", f"array('', {texts})", "array('')")
    marked = " || ".join(f"_mark || '${group}'" if group else "_mark" for group in groups)
    return f"split(regexp_replace(_line, {regex}, {marked}), _mark, -1)"


def _mark() -> str:
    """A text that does not occur in the line: a control character, or with
    it a digest of the line when the line holds that character."""
    return when("contains(_line, '\\u0001')", "'\\u0001' || sha2(_line, 256)", "'\\u0001'")


def _json_text(message: str) -> str:
    """Message of an accepted JSON line; without one, built from its members."""
    built = f"coalesce(_j.action, '{_FALLBACK_MESSAGE}')"
    return when(f"{message} != _line", message, built)


def _action_text(members: str) -> str:
    """``operation entity`` when both members are there, else NULL."""
    operation = jsonline.exact_value(members, "operation")
    entity = jsonline.exact_value(members, "entity")
    return f"({operation} || ' ' || {entity})"


def _read_pairs(frame: DataFrame) -> DataFrame:
    """Fill columns from pairs, and read a JSON object inside the message."""
    frame = keyvalue.with_pairs(frame, "_message", "NOT _accepted")
    columns = {
        f"_{target}": when(
            "size(_keys) > 0",
            coalesce(keyvalue.last_value(target), f"_{target}"),
            f"_{target}",
        )
        for target in keyvalue.KEY_ALIASES
    }
    columns["_service"] = when(
        "_service = '' AND size(_keys) > 0",
        f"coalesce({keyvalue.first_service()}, '')",
        "_service",
    )
    return jsonline.with_members(frame, "_message", "NOT _accepted", "_inner", also=columns)


def _read_json_message(frame: DataFrame) -> DataFrame:
    columns = {
        f"_{target}": when(
            f"_inner_keys IS NOT NULL AND _{target} = ''",
            f"coalesce({jsonline.member('_inner', target)}, '')",
            f"_{target}",
        )
        for target in ("trace_id", "request_id", "user_id", "component")
    }
    inner_text = f"nullif({jsonline.member('_inner', 'message')}, '')"
    columns["_message"] = when(
        "_inner_keys IS NOT NULL",
        f"coalesce(nullif({inner_text}, _message), {_action_text('_inner')}, _message)",
        "_message",
    )
    columns["_inner_is_other"] = jsonline.is_other("_inner")
    return _replace(frame, columns)


def _collect_fields(frame: DataFrame) -> DataFrame:
    """All extra fields in rising priority."""
    nothing = "CAST(array() AS array<string>)"
    columns = {}
    for part in ("keys", "values"):
        sources = [jsonline.pick_others("_inner", part), f"_pattern_{part}", f"reverse(_{part})"]
        searched = f"concat({', '.join(coalesce(source, nothing) for source in sources)})"
        columns[f"_field_{part}"] = when("_accepted", f"_j.{part}", searched)
    frame = _replace(frame, columns)
    return _replace(
        frame, {"_fields_map": keyvalue.last_wins_map("_field_keys", "_field_values")}
    )


def _output(name: str) -> str:
    return {
        "ts": "coalesce(_ts, _ingest)",
        "timed": "_ts IS NOT NULL",
        "raw_line": "_line",
        "fields": "_fields_map",
        "level": "_level",
        "message": "_message",
    }.get(name, f"nullif(_{name}, '')")

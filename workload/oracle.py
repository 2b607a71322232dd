"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from logspark.schema import DISTINCT_COLUMNS
from workload import fixtures
from workload.spark_queries import INGEST, LONG_LINE, separators_sql

_RESULT = """ts, level, message, coalesce(trace_id, '') AS trace_id, coalesce(source, '') AS source,
 coalesce(replace(tags, ', ', ','), '') AS tags, coalesce(id, '') AS id, coalesce(process, '') AS process"""
_MONTH = "ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-02-01'"
_DAY = "ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-11'"
_NEWEST = "(SELECT max(ts) FROM logs)"
_NL = "chr(10)"


def _logs(query: str, **others: str) -> str:
    parts = {"logs": fixtures.duckdb_logs(), **others}
    named = ", ".join(f"{name} AS ({text})" for name, text in parts.items())
    return f"WITH {named} {query}"


def _fast_logs(query: str) -> str:
    """Over the rows as lakes hold them."""
    return f"WITH logs AS ({fixtures.duckdb_logs(fast=True)}) {query}"


_LAKE = "ts >= TIMESTAMP '2024-01-01 05:30:00' AND ts <= TIMESTAMP '2024-01-02 02:15:00'"
_SPAN = "ts >= TIMESTAMP '2024-01-01 05:30:00' AND ts <= TIMESTAMP '2024-01-09 02:15:00'"
_PLACE = "stream, ts::DATE AS dt, hour(ts)::INTEGER AS hour"


def _search(where: str, limit: int | None = 100, offset: int = 0) -> str:
    page = "" if limit is None else f" LIMIT {limit} OFFSET {offset}"
    return _logs(
        f"SELECT {_RESULT} FROM logs WHERE {where} ORDER BY ts DESC, coalesce(id, '') ASC{page}"
    )


def _text(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"(message ILIKE '%{quoted}%' OR regexp_matches(message, '(?i){quoted}'))"


def _tag(tag: str) -> str:
    return f"list_contains(string_split(tags, ','), '{tag}')"


_COMBINED = (
    "ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND stream = 'svc-3'"
    " AND source IN ('svc-3', 'svc-4') AND level IN ('ERROR', 'FATAL', 'WARN')"
    f" AND {_tag('web')} AND {_text('operation')}"
)


def _view(where: str = "true") -> str:
    members = fixtures.MEMBERS
    return _logs(
        f"""SELECT * FROM (
 SELECT {_RESULT}, stream FROM (
  SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts DESC, coalesce(id, '')) AS rn FROM logs
  WHERE stream IN (SELECT stream FROM members WHERE session = 'checkout')
   AND ts >= {_NEWEST} - INTERVAL 10 DAY AND ts <= {_NEWEST} AND {where})
 WHERE rn <= 200 ORDER BY ts DESC, id LIMIT 100)""",
        members=members,
    )


_COUNTS = """SELECT session, m.stream AS stream, coalesce(log_count, 0) AS log_count,
 coalesce(error_count, 0) AS error_count, coalesce(warning_count, 0) AS warning_count, last_seen
FROM members m LEFT JOIN (
 SELECT stream, count(*) AS log_count, count_if(level IN ('ERROR', 'FATAL'))::BIGINT AS error_count,
  count_if(level IN ('WARN', 'WARNING'))::BIGINT AS warning_count, max(ts) AS last_seen
 FROM logs GROUP BY stream) c ON m.stream = c.stream"""

_DURATION = """CASE WHEN s < 60 THEN printf('%.0fs', s)
 WHEN s < 3600 THEN printf('%.0fm', floor(s / 60) + (s % 60) / 60.0::DOUBLE)
 ELSE printf('%.1fh', floor(s / 3600) + (s % 3600) / 3600.0::DOUBLE) END"""


def _sessions(query: str) -> str:
    return f"WITH sessions AS ({fixtures.duckdb_fixture('sessions')}) {query}"


_LEVEL = """CASE WHEN upper(trim({x}, ' ')) IN ('TRACE', 'TRC') THEN 'TRACE'
 WHEN upper(trim({x}, ' ')) IN ('DEBUG', 'DBG', 'DEBG') THEN 'DEBUG'
 WHEN upper(trim({x}, ' ')) IN ('INFO', 'INF', 'INFORMATION') THEN 'INFO'
 WHEN upper(trim({x}, ' ')) IN ('WARN', 'WRN', 'WARNING') THEN 'WARN'
 WHEN upper(trim({x}, ' ')) IN ('ERROR', 'ERR', 'ERRO') THEN 'ERROR'
 WHEN upper(trim({x}, ' ')) IN ('FATAL', 'FTL', 'CRIT', 'CRITICAL') THEN 'FATAL'
 WHEN upper(trim({x}, ' ')) IN ('PANIC', 'PNC') THEN 'PANIC' ELSE 'UNKNOWN' END"""

_INGEST = f"TIMESTAMP '{INGEST}'"
_SECOND = "date_trunc('second', ts)"
_K = "'k=' || regexp_extract(message, 'k=([0-9]+)', 1)"
_SERVICE = f"{_K} || {_NL} || 'service=' || source"

# What each line format says about the log row it was rendered from.
_STRUCTURED = "'request_id=' || request_id || ' user=' || user_id || ' operation=' || component || ' note=\"' || message || '\"'"
_ANSI = "message || ' status=\"in progress\" trace=' || coalesce(trace_id, 'none')"
_EXPECTED = {
    "structured": {
        "ts": "ts",
        "message": _STRUCTURED,
        "service": "source",
        "request_id": "request_id",
        "user_id": "user_id",
        "fields": f"'note=' || message || {_NL} || 'operation=' || component || {_NL} || 'request_id='"
        f" || request_id || {_NL} || 'service=' || source || {_NL} || 'user=' || user_id",
    },
    "syslog": {"ts": _SECOND, "service": "source", "fields": _SERVICE},
    "json_prefix": {"ts": _SECOND, "service": "source", "fields": _SERVICE},
    "bracketed": {"ts": _SECOND},
    "level_first": {"ts": _SECOND, "service": "source", "fields": _SERVICE},
    "any_bracket": {"ts": None, "message": fixtures.duckdb_line("any_bracket")},
    "time_service": {
        "ts": f"date_trunc('day', {_INGEST}) + (ts - date_trunc('day', ts))",
        "service": "source",
        "component": "component",
        "trace_id": "trace_id",
        "fields": _SERVICE,
    },
    "json": {
        "ts": "ts",
        "service": "source",
        "user_id": "user_id",
        "fields": "'n=' || event_id",
    },
    "ansi": {
        "ts": None,
        "level": "'UNKNOWN'",
        "message": _ANSI,
        "trace_id": "coalesce(trace_id, 'none')",
        "fields": f"{_K} || {_NL} || 'status=in progress' || {_NL} || 'trace=' || coalesce(trace_id, 'none')",
    },
}
_DEFAULTS = {"level": "level", "message": "message", "fields": _K}


def _expected(shape: str, column: str) -> str:
    known = _EXPECTED[shape]
    if column == "ts":
        return known["ts"] or _INGEST
    if column == "timed":
        return "true" if known["ts"] else "false"
    return known.get(column) or _DEFAULTS.get(column) or "CAST(NULL AS VARCHAR)"


def _parse(shape: str) -> str:
    columns = (
        "ts", "level", "message", "service", "component", "trace_id", "request_id", "user_id",
        "thread", "timed", "fields",
    )
    picked = ", ".join(f"{_expected(shape, name)} AS {name}" for name in columns)
    return _logs(f"SELECT id, {picked} FROM logs")


def _mixed(column: str) -> str:
    cases = " ".join(
        f"WHEN {at} THEN {_expected(shape, column)}" for at, shape in enumerate(fixtures.SHAPES)
    )
    return f"CASE event_id % {len(fixtures.SHAPES)} {cases} END"


def _mixed_rows(*columns: str) -> str:
    return ", ".join(f"{_mixed(name)} AS {name}" for name in columns)


_PAIRS = r'(\w+)=("(?:[^"\\]|\\.)*"|[^\s,]+)'


def _pairs(source: str, key: str) -> str:
    """Sorted key=value lines of the texts in ``source`` (``key``, value)."""
    return f"""SELECT {key}, coalesce(string_agg(k || '=' || trim(v, '"'), {_NL} ORDER BY k), '') AS fields
FROM (SELECT {key}, k, v, row_number() OVER (PARTITION BY {key}, k ORDER BY pos DESC) AS rn
 FROM (SELECT {key}, unnest(regexp_extract_all(value, '{_PAIRS}', 1)) AS k,
  unnest(regexp_extract_all(value, '{_PAIRS}', 2)) AS v,
  unnest(range(len(regexp_extract_all(value, '{_PAIRS}', 1)))) AS pos FROM {source}))
WHERE rn = 1 GROUP BY {key}"""


_BRACKET = r"(?i)\[(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|PANIC)\]"

_FILES = f"WITH files AS ({fixtures.duckdb_fixture('retention_inventory')})"
_LATEST = "(SELECT max(mtime) FROM files)"
_RETENTION = f"""{_FILES}, policy AS (
 SELECT sum(length) // 32 * 3 AS cap, max(mtime) - INTERVAL 2000 DAY - INTERVAL 30 DAY AS cutoff FROM files),
ranked AS (
 SELECT *, row_number() OVER (PARTITION BY stream ORDER BY mtime, path) AS rn,
  count(*) OVER (PARTITION BY stream) AS n, sum(length) OVER (PARTITION BY stream) AS total FROM files),
aged AS (SELECT *, n - rn + 1 > 10 AND mtime < (SELECT cutoff FROM policy) AS by_age FROM ranked),
rest AS (
 SELECT *, count_if(by_age) OVER (PARTITION BY stream) AS n_age,
  row_number() OVER (PARTITION BY stream, by_age ORDER BY mtime, path) AS k,
  coalesce(sum(CASE WHEN by_age THEN 0 ELSE length END) OVER (PARTITION BY stream ORDER BY mtime, path
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM aged),
plan AS (
 SELECT stream, path, length, mtime, by_age,
  NOT by_age AND total > (SELECT cap FROM policy) AND prior < total - (SELECT cap FROM policy)
   AND n - (n_age + k) >= 10 AS by_size FROM rest)"""

_COMPACTION = f"""WITH files AS ({fixtures.duckdb_fixture('compaction_inventory')}),
judged AS (
 SELECT *, contains(name, 'compacted_') AS is_compacted,
  mtime <= {_LATEST} - INTERVAL 2 HOUR AS eligible,
  mtime <= {_LATEST} - INTERVAL 24 HOUR AS settled FROM files),
chosen AS (SELECT *, eligible AND (NOT is_compacted OR settled) AS in_rewrite FROM judged),
plan AS (
 SELECT stream, dt, count(*) AS files, count_if(eligible)::BIGINT AS eligible_files,
  sum(CASE WHEN eligible THEN length ELSE 0 END)::BIGINT AS eligible_bytes,
  count_if(eligible AND NOT is_compacted) >= 5 AND count_if(in_rewrite) >= 2 AS needs_compaction,
  count_if(in_rewrite)::BIGINT AS merged_files,
  sum(CASE WHEN in_rewrite THEN length ELSE 0 END)::BIGINT AS merged_bytes,
  greatest(ceil(sum(CASE WHEN in_rewrite THEN length ELSE 0 END) / 200000.0), 1)::BIGINT AS output_files
 FROM chosen GROUP BY stream, dt HAVING count(*) >= 5)"""


def _short(text: str, width: int) -> str:
    return f"CASE WHEN length({text}) > {width} THEN substring({text}, 1, {width - 3}) || '...' ELSE {text} END"


_LAKE_COLUMNS = "id, ts, level, source, message, trace_id"
# Structured lines as a streamed lake holds them.
_STREAMED = f"SELECT ts, level, source, {_STRUCTURED} AS message, CAST(NULL AS VARCHAR) AS trace_id, {_PLACE} FROM logs"


def oracle_sql() -> dict[str, str]:
    stored = (
        "ts, source, level, message, id, trace_id, process, component, thread, user_id, request_id, tags"
    )
    found = {
        "flagship_errors": _search(f"{_DAY} AND level IN ('ERROR', 'FATAL') AND {_text('timeout')}"),
        "search_time_range": _search(_DAY),
        "search_levels": _search(f"{_MONTH} AND level IN ('ERROR', 'FATAL')"),
        "search_bounds": _search(
            "ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12 18:30:00' AND level = 'WARN'", limit=40
        ),
        "search_sources": _search(f"{_MONTH} AND source IN ('svc-1', 'svc-2')"),
        "search_trace_ids": _search(f"{_MONTH} AND trace_id IN ('trace-0', 'trace-30', 'trace-300')"),
        "search_message_text": _search(f"{_MONTH} AND {_text('TIMEOUT 100% f')}"),
        "search_message_wildcard": _search(f"{_MONTH} AND {_text('error%user__ T')}"),
        "search_message_regex": _search(f"{_MONTH} AND {_text(r'k=(1|2)[0-9] by user_1\d$')}"),
        "search_message_backslash": _search(f"{_MONTH} AND {_text(r'user\_1')}"),
        "search_tags_all": _search(f"{_MONTH} AND {_tag('web')} AND {_tag(' slow')}"),
        "search_tags_trimmed_miss": _search(f"{_MONTH} AND {_tag('slow')}"),
        "search_stream": _search(f"{_MONTH} AND stream = 'svc-5'"),
        "search_combined": _search(_COMBINED),
        "search_page_offset": _search(f"{_MONTH} AND level = 'ERROR'", 50, 100),
        "search_all_rows": _search(f"{_MONTH} AND level = 'FATAL'", None),
        "search_reversed_bounds": _search("ts >= TIMESTAMP '2024-01-11' AND ts <= TIMESTAMP '2024-01-10'"),
        "search_keyset": _search(f"{_MONTH} AND level = 'ERROR'", 50, 100),
        "search_trace_table": _search(
            f"{_MONTH} AND trace_id IN (SELECT trace_id FROM logs WHERE level IN ('ERROR', 'FATAL'))", None
        ),
        "search_last_24h": _search(f"ts >= {_NEWEST} - INTERVAL 24 HOUR AND ts <= {_NEWEST}", 1000),
        "search_api_default": _search(f"ts >= {_NEWEST} - INTERVAL 24 HOUR AND ts <= {_NEWEST}"),
        "search_cli_default": _search(f"ts >= {_NEWEST} - INTERVAL 24 HOUR AND ts <= {_NEWEST}"),
        "search_since_start_of_day": _search(
            f"ts >= date_trunc('day', {_NEWEST}) AND ts <= {_NEWEST}", 1000
        ),
        "search_lake": _logs(
            f"SELECT {_RESULT} FROM logs WHERE {_SPAN} AND stream = 'svc-3' AND level IN ('ERROR', 'FATAL')"
            f" AND {_text('Timeout|full')} ORDER BY ts DESC, coalesce(id, '')"
        ),
        "search_envelope": _logs(
            f"""SELECT string_agg(id, ',' ORDER BY ts DESC, id) AS ids, any_value(total) AS total, count(*) AS returned,
 20::BIGINT AS "limit", 40::BIGINT AS "offset"
FROM (SELECT id, ts, count(*) OVER () AS total FROM logs WHERE {_MONTH} AND level = 'ERROR'
 ORDER BY ts DESC, id LIMIT 20 OFFSET 40)"""
        ),
        "page_info": _logs(
            f"""SELECT total, 50::BIGINT AS "limit", 100::BIGINT AS "offset",
 least(greatest(total - 100, 0), 50) AS returned, greatest(ceil(total / 50.0), 1)::BIGINT AS total_pages,
 least(3, greatest(ceil(total / 50.0), 1)::BIGINT) AS page,
 least(3, greatest(ceil(total / 50.0), 1)) > 1 AS has_previous,
 least(3, greatest(ceil(total / 50.0), 1)) < greatest(ceil(total / 50.0), 1) AS has_next
FROM (SELECT count(*) AS total FROM logs WHERE {_MONTH} AND level = 'ERROR')"""
        ),
        "count_matches": _logs(f"SELECT count(*) AS total FROM logs WHERE {_COMBINED}"),
        "files_scanned": _logs(
            "SELECT count(DISTINCT (stream, date_trunc('hour', ts))) AS files_scanned FROM logs"
            " WHERE ts >= TIMESTAMP '2024-01-01 05:00:00' AND ts < TIMESTAMP '2024-01-02 03:00:00'"
        ),
        "time_range": _logs(
            "SELECT min(ts) AS oldest, max(ts) AS newest,"
            " (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM logs"
        ),
        "stream_time_range": _logs(
            "SELECT stream, min(ts) AS oldest, max(ts) AS newest,"
            " (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM logs GROUP BY stream"
        ),
        "lake_stats": _logs(
            "SELECT count(*) AS total_records, min(ts) AS oldest, max(ts) AS newest,"
            " count(DISTINCT coalesce(process, '')) AS unique_processes,"
            " count(DISTINCT source) AS unique_sources, count(DISTINCT level) AS unique_levels FROM logs"
        ),
        "kept_stats": _fast_logs(
            "SELECT stream, count(*) AS total_records, min(ts) AS oldest, max(ts) AS newest,"
            " count(DISTINCT coalesce(process, '')) AS unique_processes,"
            " count(DISTINCT source) AS unique_sources, count(DISTINCT level) AS unique_levels FROM logs GROUP BY stream"
        ),
        "stream_list": _logs("SELECT DISTINCT stream FROM logs WHERE NOT starts_with(stream, '.')"),
        "lake_size": f"{_FILES} SELECT count(*) AS total_files, sum(length)::BIGINT AS total_size_bytes FROM files",
        "folder_info": f"""{_FILES}, logs AS ({fixtures.duckdb_logs()}),
years AS (SELECT stream, year(mtime) AS y, count(*) AS n, sum(length) AS b FROM files GROUP BY ALL)
SELECT y.stream AS stream, sum(n)::BIGINT AS total_files, sum(b)::BIGINT AS total_size_bytes,
 string_agg(y::VARCHAR, ',' ORDER BY y) AS years,
 string_agg(y || ':' || n, ',' ORDER BY y) AS files_per_year,
 any_value(oldest) AS oldest, any_value(newest) AS newest
FROM years y LEFT JOIN (SELECT stream, min(ts) AS oldest, max(ts) AS newest FROM logs GROUP BY stream) r
 ON y.stream = r.stream GROUP BY y.stream""",
        "quick_search": _logs(
            "SELECT id, message FROM logs WHERE contains(lower(message), 'svc-1')"
            " OR contains(lower(source), 'svc-1') OR contains(lower(coalesce(process, '')), 'svc-1')"
            " OR contains(lower(level), 'svc-1')"
        ),
        "view_all": _view(),
        "view_errors": _view("level IN ('ERROR', 'FATAL')"),
        "view_warnings": _view("level IN ('WARN', 'WARNING', 'ERROR', 'FATAL')"),
        "view_traces": _view("trace_id != ''"),
        "view_search": _view(
            "(contains(lower(message), 'purchase') OR contains(lower(source), 'purchase')"
            " OR contains(lower(coalesce(process, '')), 'purchase') OR contains(lower(level), 'purchase'))"
        ),
        "newest_per_stream": _logs(
            "SELECT stream, ts, id, level, message FROM (SELECT *, row_number() OVER"
            " (PARTITION BY stream ORDER BY ts DESC, coalesce(id, '')) AS rn FROM logs) WHERE rn <= 25"
        ),
        "session_process_counts": _logs(_COUNTS, members=fixtures.MEMBERS),
        "session_totals": _logs(
            f"""SELECT session, count(*) AS process_count, sum(log_count)::BIGINT AS total_logs,
 sum(error_count)::BIGINT AS error_count, sum(warning_count)::BIGINT AS warning_count,
 max(last_seen) AS last_activity FROM ({_COUNTS}) GROUP BY session""",
            members=fixtures.MEMBERS,
        ),
        "session_listing": _sessions(
            f""", totals AS (SELECT c_nationkey, count(DISTINCT c_custkey) AS processes, count(o_orderkey) AS logs
 FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey)
SELECT session AS name, substring(id, 1, 8) || '...' AS id, {_DURATION} AS duration, processes, logs,
 strftime(last_update, '%H:%M:%S') AS last_update
FROM (SELECT *, (epoch((SELECT max(last_update) FROM sessions)) - epoch(start_time))::DOUBLE AS s FROM sessions
 WHERE active) JOIN totals ON session = 'session-' || c_nationkey"""
        ),
        "sessions_active": _sessions("SELECT * FROM sessions WHERE active"),
        "session_lookup": _sessions("SELECT * FROM sessions WHERE active AND session = 'session-4'"),
        "session_states": _sessions(
            "SELECT session, id, start_time, last_update, active AND"
            " (SELECT max(last_update) FROM sessions) - last_update <= INTERVAL 1 HOUR AS active FROM sessions"
        ),
        "session_cleanup": _sessions(
            "SELECT * FROM sessions WHERE NOT (NOT active AND"
            " (SELECT max(last_update) FROM sessions) - last_update > INTERVAL 5 MINUTE)"
        ),
        "normalize_levels": _logs(
            f"""SELECT id, spelling, {_LEVEL.format(x='spelling')} AS level FROM (
 SELECT id, CASE event_id % 6 WHEN 0 THEN lower(level) WHEN 1 THEN concat(' ', level, ' ')
  WHEN 2 THEN substr(level, 1, 3) WHEN 3 THEN concat(level, 'ING') WHEN 4 THEN component ELSE level END AS spelling
 FROM logs)"""
        ),
        "parse_mixed": _logs(
            f"SELECT id, {_mixed_rows('ts', 'level', 'message', 'service', 'trace_id', 'timed')} FROM logs"
        ),
        "parse_documents": f"""WITH split AS (
 SELECT doc_id, unnest(string_split(text, {_NL})) AS value, unnest(range(len(string_split(text, {_NL})))) AS line_no
 FROM documents),
lines AS (SELECT doc_id, line_no::INTEGER AS line_no, doc_id || '/' || line_no AS place, value FROM split),
pairs AS ({_pairs('lines', 'place')})
SELECT doc_id, line_no, CASE WHEN regexp_matches(value, '{_BRACKET}')
  THEN {_LEVEL.format(x=f"regexp_extract(value, '{_BRACKET}', 1)")} ELSE 'UNKNOWN' END AS level,
 value AS message, {_INGEST} AS ts, coalesce(fields, '') AS fields
FROM lines LEFT JOIN pairs ON lines.place = pairs.place""",
        "parse_pages": f"""WITH lines AS (SELECT page_id, html AS value FROM pages),
pairs AS ({_pairs('lines', 'page_id')})
SELECT lines.page_id AS page_id, CASE WHEN regexp_matches(value, '{_BRACKET}')
  THEN {_LEVEL.format(x=f"regexp_extract(value, '{_BRACKET}', 1)")} ELSE 'UNKNOWN' END AS level,
 coalesce(fields, '') AS fields FROM lines LEFT JOIN pairs ON lines.page_id = pairs.page_id""",
        "entries_pipe": _logs(
            f"""SELECT id, ts, level, coalesce(service, 'stdin') AS source, coalesce(service, 'stdin') AS process,
 coalesce(service, 'stdin') AS stream, message, trace_id
FROM (SELECT id, {_mixed_rows('ts', 'level', 'message', 'service', 'trace_id')} FROM logs)"""
        ),
        "entries_containers": _logs(
            f"""SELECT id, {_SECOND} AS ts, level, src AS source, stream AS process,
 CASE WHEN c.component != '' THEN c.component ELSE l.component END AS component, src AS stream, message
FROM (SELECT l.*, CASE WHEN project != '' THEN project WHEN level IN ('ERROR', 'FATAL')
  THEN l.stream || '[stderr]' ELSE l.stream END AS src
 FROM logs l JOIN containers c ON l.stream = c.container WHERE enabled) l
JOIN containers c ON l.stream = c.container""",
            containers=fixtures.duckdb_fixture("containers"),
        ),
        "dedup_lines": _logs(
            f"""SELECT id, copy, ts, source, message,
 substring(sha256(message || '|' || epoch(ts)::BIGINT || '|' || source), 1, 16) AS dedup_key
FROM (SELECT id, copy, {_SECOND} AS ts, source, message,
 row_number() OVER (PARTITION BY message, {_SECOND}, source ORDER BY copy, id) AS rn
 FROM logs, (SELECT unnest(range(3))::INTEGER AS copy)) WHERE rn = 1"""
        ),
        "content_ids": _logs(
            """SELECT sha256(length(source) || ':' || source || length(epoch_us(ts)::VARCHAR) || ':' || epoch_us(ts)
 || length(message) || ':' || message) AS id, event_id FROM logs"""
        ),
        "storage_normalize": _logs(
            "SELECT id, ts, source, level, message, trace_id, process, tags, CAST(NULL AS VARCHAR) AS component FROM logs"
        ),
        "tail_json": _logs(
            f"""SELECT '{{"id":"' || id || '","ts":"'
 || regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z","source":"' || source
 || '","level":"' || level || '","message":"' || message || '"'
 || coalesce(',"trace_id":"' || trace_id || '"', '') || coalesce(',"process":"' || process || '"', '')
 || ',"component":"' || component || '","thread":"' || thread || '","user_id":"' || user_id
 || '","request_id":"' || request_id || '"'
 || coalesce(',"tags":["' || replace(tags, ',', '","') || '"]', '') || '}}' AS value FROM logs"""
        ),
        "lake_roundtrip": _fast_logs(f"SELECT {stored}, {_PLACE} FROM logs"),
        "dedup_separators": f"SELECT message, ts, source, min(event_id) AS event_id FROM ({separators_sql()})"
        " GROUP BY message, ts, source",
        "lines_long": f"""SELECT length(value) AS size, md5(value) AS digest FROM (
 SELECT repeat(line, CASE WHEN doc_id % 10 = 0 THEN {LONG_LINE} // length(line) + 1 ELSE 1 END) AS value
 FROM (SELECT doc_id, doc_id || ': ' || translate(text, chr(10) || chr(13), '  ') AS line FROM documents WHERE text != ''))""",
        "parse_syslog_new_year": _logs(
            f"""SELECT id, month, CASE WHEN month = 12 THEN {_SECOND} + INTERVAL 11 MONTH
 WHEN {_SECOND} + INTERVAL 1 YEAR <= TIMESTAMP '2025-01-16 12:00:00' THEN {_SECOND} + INTERVAL 1 YEAR
 ELSE {_SECOND} END AS ts
FROM logs, (SELECT unnest([1, 12])::INTEGER AS month)"""
        ),
        "parse_kv": _logs(
            f"""SELECT id, user_id, 'a=' || (event_id + 1) || {_NL} || 'b=two words ' || user_id
 || {_NL} || 'c=' || level || {_NL} || 'user=' || user_id AS fields FROM logs"""
        ),
        "parse_fallthrough": _logs(
            "SELECT id, level, '[' || level || '] ' || component AS message, false AS timed FROM logs"
        ),
        "parse_embedded_json": _logs(
            f"""SELECT id, level, source AS service, component || ' ' || thread AS message,
 'entity=' || thread || {_NL} || 'operation=' || component || {_NL} || 'service=' || source AS fields FROM logs"""
        ),
        "read_containers": _logs(
            "SELECT stream AS container, CASE WHEN level IN ('ERROR', 'FATAL') THEN 'stderr' ELSE 'stdout' END"
            " AS stream_type, id || ' ' || message AS value FROM logs"
        ),
        "session_files": _sessions(
            "SELECT session, session || '-web' AS stream, id, start_time, last_update, active AND"
            " (SELECT max(last_update) FROM sessions) - last_update <= INTERVAL 1 HOUR AS active FROM sessions"
        ),
        "live_view": f"""WITH logs AS ({fixtures.duckdb_logs(fast=True)}), members AS ({fixtures.MEMBERS})
SELECT {_RESULT}, stream FROM logs WHERE stream IN (SELECT stream FROM members WHERE session = 'checkout')
 AND ts >= {_NEWEST} - INTERVAL 1 HOUR AND level IN ('ERROR', 'FATAL') ORDER BY ts DESC, id LIMIT 100""",
        "stream_late": _fast_logs(f"SELECT DISTINCT {_SECOND} AS ts, source, message, {_PLACE} FROM logs"),
        "parse_custom_pattern": _logs(
            f"SELECT id, {_SECOND} AS ts, level, thread, component || ' done' AS message FROM logs"
        ),
        "compaction_plan": f"{_COMPACTION} SELECT * FROM plan",
        "compaction_totals": f"""{_COMPACTION} SELECT count(*) AS total_compactions,
 coalesce(sum(merged_files), 0)::BIGINT AS total_files_merged, max({_LATEST}) AS last_compaction
FROM plan WHERE needs_compaction""",
        "compaction_files": f"""{_COMPACTION} SELECT c.stream AS stream, c.dt AS dt, name, length, output_files
FROM chosen c JOIN plan p ON c.stream = p.stream AND c.dt = p.dt WHERE needs_compaction AND in_rewrite""",
        "search_during_compaction": _fast_logs(
            f"SELECT step, id, ts, message FROM logs, (SELECT unnest(['before', 'half moved', 'published', 'held', 'cleaned up']) AS step)"
            f" WHERE {_LAKE} AND level IN ('ERROR', 'FATAL')"
        ),
        "compaction_rewrite": _fast_logs(f"SELECT {_LAKE_COLUMNS}, {_PLACE} FROM logs"),
        "retention_apply": _fast_logs(f"SELECT {_LAKE_COLUMNS}, {_PLACE} FROM logs WHERE ts >= TIMESTAMP '2024-01-02'"),
        "newest_in_lake": _fast_logs(
            "SELECT stream, ts, id, level, message FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts DESC, id) AS rn"
            f" FROM logs WHERE {_LAKE}) WHERE rn <= 25"
        ),
        # eight files of lines, three a batch
        "export_metrics": _fast_logs(
            "SELECT 3::BIGINT AS exports, count(*) AS entries, 0::BIGINT AS failures, true AS same_files FROM logs"
        ),
        "row_retention_apply": _fast_logs(f"SELECT {_LAKE_COLUMNS}, {_PLACE} FROM logs WHERE ts >= TIMESTAMP '2024-01-01 17:20:00'"),
        "stream_compact": _fast_logs(_STREAMED),
        "stream_retain": _fast_logs(f"{_STREAMED} WHERE ts >= TIMESTAMP '2024-01-02'"),
        "retention_plan": f"{_RETENTION} SELECT * FROM plan",
        "retention_totals": f"""{_RETENTION} SELECT stream, count(*) AS files_scanned,
 count_if(by_age OR by_size)::BIGINT AS files_deleted,
 sum(CASE WHEN by_age OR by_size THEN length ELSE 0 END)::BIGINT AS bytes_deleted FROM plan GROUP BY stream""",
        "retention_keep": f"{_RETENTION} SELECT stream, path, length FROM plan WHERE NOT (by_age OR by_size)",
        "force_clean": f"{_FILES} SELECT * FROM files WHERE mtime < {_LATEST} - INTERVAL 365 DAY",
        "row_retention": _logs(f"SELECT id, ts, level FROM logs WHERE ts >= {_NEWEST} - INTERVAL 7 DAY"),
        "render_list": _logs(
            f"""SELECT id, strftime(ts, '%H:%M:%S') AS time, level,
 {_short("coalesce(process, source)", 12)} AS process, {_short('source', 15)} AS source,
 {_short("coalesce(trace_id, '')", 10)} AS trace, {_short('message', 50)} AS message FROM logs"""
        ),
        "render_cli": _logs(
            f"""SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, level, source,
 {_short("coalesce(trace_id, '-')", 12)} AS trace_id, {_short('message', 50)} AS message,
 coalesce('[' || replace(tags, ', ', ',') || ']', '') AS tags FROM logs"""
        ),
        "render_detail": _logs(
            "SELECT id, 'Level: ' || level || ' | Process: ' || coalesce(process, '') || ' | Source: ' || source"
            " || coalesce(' | Trace: ' || trace_id, '') AS detail FROM logs"
        ),
        "render_search": _logs(
            "SELECT id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || level || '] ' || message"
            " || coalesce(' [trace:' || trace_id || ']', '') AS line FROM logs"
        ),
        "duration_text": f"SELECT o_orderkey, {_DURATION} AS duration FROM"
        " (SELECT o_orderkey, (o_orderkey % 100000)::DOUBLE AS s FROM orders)",
        "stream_ingest": _fast_logs(
            f"""SELECT *, source AS stream, ts::DATE AS dt, hour(ts)::INTEGER AS hour FROM (
WITH parsed AS (SELECT {_mixed_rows('ts', 'level', 'message', 'service', 'trace_id', 'timed')} FROM logs)
SELECT min(ts) AS ts, min(level) AS level, coalesce(service, 'stdin') AS source, message, min(trace_id) AS trace_id
FROM parsed WHERE timed GROUP BY message, date_trunc('second', ts), coalesce(service, 'stdin')
UNION ALL SELECT ts, level, coalesce(service, 'stdin'), message, trace_id FROM parsed WHERE NOT timed)"""
        ),
        "stream_dedup": _fast_logs(
            f"SELECT DISTINCT {_SECOND} AS ts, source, message, {_PLACE} FROM logs"
        ),
        "stream_evict": _fast_logs(
            f"""SELECT ts, source, message FROM (SELECT DISTINCT {_SECOND} AS ts, source, message FROM logs), range(2)
UNION ALL SELECT TIMESTAMP '2030-01-01', 'clock', 'moved'"""
        ),
        "stream_growing": _logs(f"SELECT {fixtures.duckdb_line('structured')} AS value FROM logs"),
        "stream_counters": _logs(
            """SELECT stream, count(*) AS log_count, count_if(level IN ('ERROR', 'FATAL'))::BIGINT AS error_count,
 count_if(level IN ('WARN', 'WARNING'))::BIGINT AS warning_count, max(ts) AS last_seen FROM logs GROUP BY stream"""
        ),
    }
    found |= {
        f"distinct_{name}": _logs(
            f"SELECT DISTINCT '{name}' AS \"column\", {name} AS value FROM logs"
            f" WHERE {name} IS NOT NULL AND {name} != '' ORDER BY value LIMIT 50"
        )
        for name in sorted(DISTINCT_COLUMNS)
    }
    found |= {f"parse_{shape}": _parse(shape) for shape in fixtures.SHAPES}
    return found

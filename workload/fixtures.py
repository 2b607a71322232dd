"""Log tables derived from the test tables, once for Spark and once for DuckDB.

The two texts differ only where the engines spell a function differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logspark.runtime import own_checkpoint_dir, prepare
from logspark.sources.lines import spread

_LOGS = """
SELECT concat('evt-', lpad(cast(event_id AS varchar(20)), 8, '0')) AS id,
 event_id,
 {ts} AS ts,
 CASE event_type WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'FATAL' ELSE 'ERROR' END
  WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS level,
 concat(event_type, ' operation k=', regexp_extract(props, '([0-9]+)', 1), ' by user_', cast(user_id AS varchar(20)),
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN ' Timeout 100% full' ELSE '' END) AS message,
 concat('svc-', cast(user_id % 8 AS varchar(20))) AS source,
 concat('svc-', cast(user_id % 8 AS varchar(20))) AS stream,
 CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('proc-', cast(user_id % 5 AS varchar(20))) END AS process,
 CASE WHEN event_id % 3 = 0 THEN concat('trace-', cast(event_id - event_id % 30 AS varchar(20))) END AS trace_id,
 event_type AS component, concat('t-', cast(event_id % 4 AS varchar(20))) AS thread,
 concat('user_', cast(user_id AS varchar(20))) AS user_id, concat('req-', cast(event_id AS varchar(20))) AS request_id,
 CASE event_id % 4 WHEN 0 THEN 'web,api' WHEN 1 THEN 'db' WHEN 2 THEN 'web, slow' END AS tags
FROM {events}
"""

MEMBERS = """
SELECT session, stream FROM (VALUES ('checkout','svc-0'),('checkout','svc-1'),('checkout','svc-9'),
                                    ('search','svc-2'),('search','svc-3')) AS v(session, stream)
"""

_CONTAINERS = """
SELECT concat('svc-', cast(n_nationkey AS varchar(20))) AS container, n_nationkey % 2 = 0 AS enabled,
 CASE WHEN n_nationkey IN (0,4) THEN 'shop' ELSE '' END AS project,
 CASE WHEN n_nationkey % 4 = 0 THEN 'api' ELSE '' END AS component FROM {nation}
"""

# One session per customer nation: started at its first order, last seen at its
# last one, active when the nation key is even.
_SESSIONS = """
SELECT concat('session-', cast(c_nationkey AS varchar(20))) AS session,
 concat('id-', lpad(cast(c_nationkey AS varchar(20)), 10, '0')) AS id,
 min(o_orderdate) AS start_time, max(o_orderdate) AS last_update, c_nationkey % 2 = 0 AS active
FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_nationkey
"""

_RETENTION = """
SELECT concat('svc-', cast(o_custkey % 8 AS varchar(20))) AS stream,
 concat('batch_', lpad(cast(o_orderkey AS varchar(20)), 9, '0'), '.parquet') AS path,
 cast(floor(o_totalprice) AS bigint) AS length, o_orderdate AS mtime FROM {orders}
"""

_COMPACTION = """
SELECT concat('svc-', cast(l_suppkey % 4 AS varchar(20))) AS stream, cast(l_shipdate AS date) AS dt,
 concat(CASE WHEN l_linenumber = 1 THEN 'compacted_' ELSE 'batch_' END, cast(l_orderkey AS varchar(20)), '_',
        cast(l_linenumber AS varchar(20)), '_', cast(l_partkey AS varchar(20)), '_', cast(l_suppkey AS varchar(20))) AS name,
 cast(floor(l_extendedprice) AS bigint) AS length, l_shipdate AS mtime FROM {lineitem}
"""

_ESC = "\x1b"

# One line text per format, rendered from a row of the logs table.
_SHAPES = {
    "structured": "concat({iso_ms}, 'Z [', level, '] [', source, '] request_id=', request_id, ' user=', user_id, "
    "' operation=', component, ' note=\"', message, '\"')",
    "syslog": "concat({month_day}, ' host1 ', source, ': [', level, '] ', message)",
    "json_prefix": """concat('{{"timestamp":"', {iso}, 'Z","level":"', level, '","service":"', source, '"}} ', message)""",
    "bracketed": "concat('[', {plain}, '] [', lower(level), '] ', message)",
    "level_first": "concat(level, ' ', {plain}, ' ', source, ': ', message)",
    "any_bracket": "concat({plain}, ' [', level, '] ', message)",
    "time_service": """concat('[', {clock_ms}, '] ', level, ' (', source, '): {{"trace_id":"', coalesce(trace_id, ''), '","context":"', component, '","message":"', message, '"}}')""",
    "json": """concat('{{"ts":"', {iso_ms}, 'Z","severity":"', lower(level), '","msg":"', message, '","svc":"', source, '","User":"', user_id, '","n":', cast(event_id AS varchar(20)), ',"skipped":{{"a":1}}}}')""",
    "ansi": f"concat('{_ESC}[31m', message, '{_ESC}[0m status=\"in progress\" trace=', coalesce(trace_id, 'none'))",
}
SHAPES = tuple(_SHAPES)

_SPARK_TIMES = {
    "iso_ms": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\")",
    "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "month_day": "date_format(ts, 'MMM dd HH:mm:ss')",
    "plain": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "clock_ms": "date_format(ts, 'HH:mm:ss.SSS')",
}
_DUCKDB_TIMES = {
    "iso_ms": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')",
    "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    "month_day": "strftime(ts, '%b %d %H:%M:%S')",
    "plain": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
    "clock_ms": "strftime(ts, '%H:%M:%S.%g')",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    own_checkpoint_dir(spark)
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _fixture(spark: SparkSession, sf_dir: str, text: str, *names: str, **parts: str) -> DataFrame:
    frames = {name: table(spark, sf_dir, name) for name in names}
    slots = {name: f"{{{name}}}" for name in names}
    return spark.sql(text.format(**slots, **parts), **frames)


# The first day of the events. For lakes their time passes 24 times as fast, so that
# all rows and streams fall into some thirty hours of two days.
_BEGIN = "2024-01-01 00:00:00"


def logs(spark: SparkSession, sf_dir: str, fast: bool = False) -> DataFrame:
    begin = f"timestamp_ntz'{_BEGIN}'"
    fast_ts = f"timestampadd(MICROSECOND, timestampdiff(MICROSECOND, {begin}, cast(ts AS timestamp_ntz)) div 24, {begin})"
    ts = f"cast(date_trunc('MILLISECOND', {fast_ts if fast else 'ts'}) AS timestamp_ntz)"
    return _fixture(spark, sf_dir, _LOGS, "events", ts=ts)


def members(spark: SparkSession) -> DataFrame:
    return spark.sql(MEMBERS)


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, sf_dir, _CONTAINERS, "nation")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, sf_dir, _SESSIONS, "customer", "orders")


def retention_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, sf_dir, _RETENTION, "orders")


def compaction_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, sf_dir, _COMPACTION, "lineitem")


def lines(spark: SparkSession, sf_dir: str, shape: str, fast: bool = False) -> DataFrame:
    """(id, value): every log row as a line of one format."""
    text = _SHAPES[shape].format(**_SPARK_TIMES)
    return spread(logs(spark, sf_dir, fast)).selectExpr("id", f"{text} AS value")


def mixed_lines(spark: SparkSession, sf_dir: str, fast: bool = False) -> DataFrame:
    """(id, value): every log row, the formats taking turns."""
    return spread(logs(spark, sf_dir, fast)).selectExpr("id", f"{mixed(_SPARK_TIMES)} AS value")


def mixed(times: dict[str, str]) -> str:
    cases = " ".join(
        f"WHEN {at} THEN {text.format(**times)}" for at, text in enumerate(_SHAPES.values())
    )
    return f"CASE event_id % {len(_SHAPES)} {cases} END"


def duckdb_logs(fast: bool = False) -> str:
    begin = f"TIMESTAMP '{_BEGIN}'"
    fast_ts = f"{begin} + to_microseconds((epoch_us(ts) - epoch_us({begin})) // 24)"
    return _LOGS.format(ts=f"date_trunc('millisecond', {fast_ts if fast else 'ts'})", events="events")


def duckdb_fixture(name: str) -> str:
    text = {
        "containers": _CONTAINERS,
        "sessions": _SESSIONS,
        "retention_inventory": _RETENTION,
        "compaction_inventory": _COMPACTION,
        "members": MEMBERS,
    }[name]
    tables = ("nation", "customer", "orders", "lineitem")
    return text.format(**{table_name: table_name for table_name in tables})


def duckdb_line(shape: str) -> str:
    return _SHAPES[shape].format(**_DUCKDB_TIMES)


def duckdb_mixed_line() -> str:
    return mixed(_DUCKDB_TIMES)

"""The logs table: its columns and the fixed vocabularies around it."""

from __future__ import annotations

from pyspark.sql import types as T

# Optional text columns: an empty string is stored as NULL.
OPTIONAL_COLUMNS = (
    "id",
    "trace_id",
    "process",
    "component",
    "thread",
    "user_id",
    "request_id",
    "tags",
)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        *[T.StructField(name, T.StringType()) for name in OPTIONAL_COLUMNS],
    ]
)
LOG_COLUMNS = tuple(LOG_SCHEMA.fieldNames())

PARTITION_COLUMNS = ("stream", "dt", "hour")
LAKE_SCHEMA = T.StructType(
    [
        *LOG_SCHEMA.fields,
        T.StructField("stream", T.StringType()),
        T.StructField("dt", T.DateType()),
        T.StructField("hour", T.IntegerType()),
    ]
)

# Columns whose distinct values may be listed.
DISTINCT_COLUMNS = frozenset(
    {
        "source",
        "level",
        "process",
        "component",
        "thread",
        "user_id",
        "request_id",
        "trace_id",
    }
)

# The level sets used by views and counters.
ERROR_LEVELS = ("ERROR", "FATAL")
WARNING_LEVELS = ("WARN", "WARNING")
WARNING_VIEW_LEVELS = ("WARN", "WARNING", "ERROR", "FATAL")

# A session file as it lies on disk, one JSON object per file.
SESSION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField(
            "processes",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("start_time", T.TimestampType()),
                        T.StructField("log_count", T.LongType()),
                        T.StructField("last_seen", T.TimestampType()),
                        T.StructField("error_count", T.LongType()),
                        T.StructField("warning_count", T.LongType()),
                    ]
                ),
            ),
        ),
        T.StructField("active", T.BooleanType()),
        T.StructField("last_update", T.TimestampType()),
    ]
)

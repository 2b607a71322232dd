"""Session definitions: one JSON file per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators.sessions import deactivate_stale
from logspark.schema import SESSION_SCHEMA


def read_sessions(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """All readable session files; stale sessions come out inactive."""
    sessions = (
        spark.read.schema(SESSION_SCHEMA)
        .option("multiLine", "true")
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .where(F.col("id").isNotNull())
        .withColumnRenamed("name", "session")
    )
    return deactivate_stale(sessions, now)


def session_members(sessions: DataFrame) -> DataFrame:
    """(session, stream, start_time): the streams attached to each session."""
    attached = sessions.select("session", F.explode("processes").alias("stream", "process"))
    return attached.select("session", "stream", F.col("process.start_time").alias("start_time"))

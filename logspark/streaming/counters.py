"""Running counters per stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logspark.operators.sessions import counters


def running_counters(rows: DataFrame) -> DataFrame:
    """Log, error and warning counts and the last time of every stream.

    Write with output mode ``update`` (changed streams) or ``complete``. Each
    micro-batch is reduced per stream before the shuffle; the state is one row
    per stream.
    """
    return rows.groupBy("stream").agg(*counters())

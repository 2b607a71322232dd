"""Rows as the texts a list, a command line or a detail pane shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions.text import blank_to_null, ellipsis, null_to_blank


def _text(name: str):
    return null_to_blank(F.col(name))


def list_rows(rows: DataFrame) -> DataFrame:
    """time, level, process, source, trace, message of the session list."""
    process = F.coalesce(blank_to_null(F.col("process")), _text("source"))
    return rows.select(
        "id",
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.col("level"),
        ellipsis(process, 12).alias("process"),
        ellipsis(_text("source"), 15).alias("source"),
        ellipsis(_text("trace_id"), 10).alias("trace"),
        ellipsis(_text("message"), 50).alias("message"),
    )


def cli_rows(rows: DataFrame) -> DataFrame:
    """Columns of the filter command; ``tags`` is an array of trimmed tags."""
    trace = F.coalesce(blank_to_null(F.col("trace_id")), F.lit("-"))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("["), F.array_join("tags", ","), F.lit("]")))
    return rows.select(
        "id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("level"),
        F.col("source"),
        ellipsis(trace, 12).alias("trace_id"),
        ellipsis(_text("message"), 50).alias("message"),
        F.coalesce(tags, F.lit("")).alias("tags"),
    )


def detail_rows(rows: DataFrame) -> DataFrame:
    """``Level: .. | Process: .. | Source: ..[ | Trace: ..]``"""
    trace = blank_to_null(F.col("trace_id"))
    return rows.select(
        "id",
        F.concat_ws(
            " | ",
            F.concat(F.lit("Level: "), _text("level")),
            F.concat(F.lit("Process: "), _text("process")),
            F.concat(F.lit("Source: "), _text("source")),
            F.concat(F.lit("Trace: "), trace),
        ).alias("detail"),
    )


def search_rows(rows: DataFrame) -> DataFrame:
    """``[time] [level] message[ [trace:id]]``"""
    trace = F.concat(F.lit(" [trace:"), blank_to_null(F.col("trace_id")), F.lit("]"))
    return rows.select(
        "id",
        F.concat(
            F.lit("["),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.lit("] ["),
            _text("level"),
            F.lit("] "),
            _text("message"),
            null_to_blank(trace),
        ).alias("line"),
    )

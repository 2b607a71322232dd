"""Search: pages of rows, counts and page arithmetic."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.functions.text import null_to_blank, split_tags
from logspark.operators.filters import (
    QueryFilter,
    partitions_between,
    predicate,
    timestamp_literal,
)
from logspark.operators.membership import keep_members
from logspark.sources.inventory import file_inventory

NEWEST_FIRST = ("ts DESC", "id ASC")
_BLANKED = ("trace_id", "source", "id", "process")


def matching(logs: DataFrame, wanted: QueryFilter) -> DataFrame:
    """All rows the filter accepts, unordered, all columns."""
    return logs.where(predicate(logs, wanted))


def result_columns(columns: tuple[str, ...] = ()) -> list[Column]:
    """The eight result columns, NULL texts as '' and tags as an array, plus
    any opted-in ones."""
    return [
        F.col("ts"),
        F.col("level"),
        F.col("message"),
        null_to_blank(F.col("trace_id")).alias("trace_id"),
        null_to_blank(F.col("source")).alias("source"),
        split_tags(F.col("tags")).alias("tags"),
        null_to_blank(F.col("id")).alias("id"),
        null_to_blank(F.col("process")).alias("process"),
        *[null_to_blank(F.col(name)).alias(name) for name in columns],
    ]


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("ts").desc(), F.col("id").asc())


def page_of(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first; without a limit all rows and no offset."""
    ordered = newest_first(rows)
    if limit <= 0:
        return ordered
    return (ordered.offset(offset) if offset > 0 else ordered).limit(limit)


def search(logs: DataFrame, wanted: QueryFilter, columns: tuple[str, ...] = ()) -> DataFrame:
    """One page of results."""
    return page_of(
        matching(logs, wanted).select(*result_columns(columns)), wanted.limit, wanted.offset
    )


def search_after(
    logs: DataFrame, wanted: QueryFilter, last_ts: dt.datetime, last_id: str
) -> DataFrame:
    """The page after the row (``last_ts``, ``last_id``).

    Costs one page however deep it lies, where an offset keeps offset + limit
    rows per task.
    """
    last = timestamp_literal(logs, last_ts)
    later = (F.col("ts") < last) | (
        (F.col("ts") == last) & (null_to_blank(F.col("id")) > F.lit(last_id))
    )
    rows = matching(logs, replace(wanted, end=min(wanted.end, last_ts))).where(later)
    return page_of(rows.select(*result_columns()), wanted.limit)


def search_traces(logs: DataFrame, wanted: QueryFilter, trace_ids: DataFrame) -> DataFrame:
    """A page of rows whose trace id is in a table of ids of any size."""
    rows = keep_members(matching(logs, wanted), trace_ids, "trace_id")
    return page_of(rows.select(*result_columns()), wanted.limit, wanted.offset)


def count_matches(logs: DataFrame, wanted: QueryFilter) -> DataFrame:
    """One row: rows the filter accepts, whatever limit and offset say."""
    return matching(logs, wanted).agg(F.count("*").alias("total"))


def files_scanned(spark: SparkSession, root: str, wanted: QueryFilter) -> DataFrame:
    """One row: data files in the folders of the lake that the filter reaches.

    Files are listed, not read, and only in those folders.
    """
    files = file_inventory(spark, root, start=wanted.start, end=wanted.end, stream=wanted.process)
    reached = files.where(partitions_between(files, wanted.start, wanted.end))
    if wanted.process:
        reached = reached.where(F.col("stream") == wanted.process)
    return reached.agg(F.count("*").alias("files_scanned"))


def page_info(logs: DataFrame, wanted: QueryFilter) -> DataFrame:
    """One row: totals and where the page lies."""
    if wanted.limit <= 0:
        raise ValueError("page_info needs a limit")
    size, offset = F.lit(wanted.limit).cast("bigint"), F.lit(wanted.offset).cast("bigint")
    total = F.col("total")
    pages = F.greatest(F.ceil(total / size), F.lit(1).cast("bigint"))
    left = F.greatest(total - offset, F.lit(0).cast("bigint"))
    page = F.least(F.floor(offset / size) + 1, F.col("total_pages"))
    return (
        count_matches(logs, wanted)
        .withColumns(
            {
                "limit": size,
                "offset": offset,
                "returned": F.least(left, size),
                "total_pages": pages,
            }
        )
        .withColumn("page", page)
        .withColumns(
            {"has_previous": F.col("page") > 1, "has_next": F.col("page") < F.col("total_pages")}
        )
    )


@dataclass(frozen=True)
class SearchResult:
    """A finished page with its envelope; entries are at most ``limit`` rows."""

    entries: list[Row]
    total: int
    query_time_ms: int
    files_scanned: int | None
    limit: int
    offset: int
    schema: T.StructType

    @property
    def returned(self) -> int:
        return len(self.entries)


def run_search(logs: DataFrame, wanted: QueryFilter, root: str = "") -> SearchResult:
    """Run one bounded page and its count in one pass; the page alone reaches the driver.

    With the lake's ``root`` the files in reach are counted from a listing.
    """
    if wanted.limit <= 0:
        raise ValueError("run_search needs a limit; use search() for all rows")
    began = time.monotonic()
    counted = Observation()
    matches = matching(logs, wanted).observe(counted, F.count("*").alias("total"))
    page = page_of(matches.select(*result_columns()), wanted.limit, wanted.offset)
    entries = page.collect()
    total = counted.get["total"]
    scanned = None
    if root:
        scanned = files_scanned(logs.sparkSession, root, wanted).first()["files_scanned"]
    elapsed = int((time.monotonic() - began) * 1000)
    return SearchResult(entries, total, elapsed, scanned, wanted.limit, wanted.offset, page.schema)


def search_envelope(logs: DataFrame, wanted: QueryFilter, root: str = "") -> DataFrame:
    """One row: the page as an array, total, returned, limit, offset, files scanned and time taken."""
    found = run_search(logs, wanted, root)
    schema = T.StructType(
        [
            T.StructField("entries", T.ArrayType(found.schema)),
            *[T.StructField(name, T.LongType()) for name in ("total", "returned", "limit", "offset")],
            T.StructField("files_scanned", T.LongType()),
            T.StructField("query_time_ms", T.LongType()),
        ]
    )
    row = (
        found.entries, found.total, found.returned, found.limit, found.offset,
        found.files_scanned, found.query_time_ms,
    )
    return logs.sparkSession.createDataFrame([row], schema)

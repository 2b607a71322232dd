"""Parsed lines -> rows of the logs table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions.text import blank_to_null, null_to_blank
from logspark.schema import OPTIONAL_COLUMNS


def from_pipe(parsed: DataFrame, collector: str) -> DataFrame:
    """Rows of a piped command: the service, else the collector, is the source."""
    source = F.coalesce(blank_to_null(F.col("service")), F.lit(collector))
    return parsed.withColumns(
        {
            "source": source,
            "process": source,
            "tags": F.lit("").cast("string"),
            "stream": stream_key(source, collector),
        }
    ).drop("service")


def from_containers(parsed: DataFrame, containers: DataFrame) -> DataFrame:
    """Rows of container logs, for containers that opted in.

    ``parsed`` carries ``container`` and ``stream_type``; ``containers`` has
    container, enabled, project and component.
    """
    labels = containers.where("enabled").select(
        "container",
        F.col("project").alias("_project"),
        F.col("component").alias("_component"),
    )
    rows = parsed.join(labels, "container", "inner")
    plain = F.when(
        F.col("stream_type") == "stderr", F.concat("container", F.lit("[stderr]"))
    ).otherwise(F.col("container"))
    source = F.coalesce(blank_to_null(F.col("_project")), plain)
    return rows.withColumns(
        {
            "source": source,
            "process": F.col("container"),
            "component": F.coalesce(blank_to_null(F.col("_component")), F.col("service")),
            "tags": F.lit("").cast("string"),
            "stream": F.coalesce(blank_to_null(source), F.col("container")),
        }
    ).drop("service", "_project", "_component")


def stream_key(source: Column, collector: str) -> Column:
    return F.coalesce(blank_to_null(source), F.lit(collector))


def with_random_id(rows: DataFrame) -> DataFrame:
    """A fresh id per row. A retried task may draw other ids, so assign them
    right before the one write that keeps them."""
    return rows.withColumn("id", F.uuid())


def with_content_id(rows: DataFrame) -> DataFrame:
    """An id that is the same in every run; for de-duplicated rows."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    text = joined(null_to_blank(F.col("source")), micros, null_to_blank(F.col("message")))
    return rows.withColumn("id", F.sha2(text, 256))


def joined(*parts: Column) -> Column:
    """The parts behind their lengths, so that different parts never read alike."""
    pieces = []
    for part in parts:
        pieces += [F.char_length(part).cast("string"), F.lit(":"), part]
    return F.concat(*pieces)


def _same_line() -> list[Column]:
    """Rows equal in these are copies: message, second and source."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    return [null_to_blank(F.col("message")), second, null_to_blank(F.col("source"))]


def dedup_key() -> Column:
    """16 hex digits over message, second and source, to show; too short to group by."""
    message, second, source = _same_line()
    return F.substring(F.sha2(F.concat_ws("|", message, second.cast("string"), source), 256), 1, 16)


def exact_key() -> Column:
    """A full digest that only copies share."""
    message, second, source = _same_line()
    return F.sha2(joined(message, F.coalesce(second.cast("string"), F.lit("")), source), 256)


def dedup(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One row per message, second and source, the first by ``order``.

    Each task keeps its first row of a key before the shuffle (a group limit), so
    a message repeated any number of times costs one row per task. Rows without
    their own time (``timed`` is false) share the ingest second, which says
    nothing about repetition: each has a number for a key of its own, so they all stay
    and the input is read once. Select the columns to keep beforehand: whole rows are sorted.
    """
    message, second, source = _same_line()
    keys = {"_message": message, "_second": second, "_source": source}
    if "timed" in rows.columns:
        keys = {name: F.when(F.col("timed"), key) for name, key in keys.items()}
        keys["_own"] = F.when(~F.col("timed"), F.monotonically_increasing_id())
    copies = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumns(keys).withColumn("_rank", F.row_number().over(copies)).where("_rank = 1")
    return first.drop(*keys, "_rank")


def storage_rows(rows: DataFrame) -> DataFrame:
    """Rows as stored: milliseconds, tags as a comma list, '' as NULL."""
    kind = rows.schema["ts"].dataType
    columns = {"ts": F.date_trunc("MILLISECOND", "ts").cast(kind)}
    for name in OPTIONAL_COLUMNS:
        if name not in rows.columns:
            columns[name] = F.lit(None).cast("string")
        elif rows.schema[name].dataType.typeName() == "array":
            columns[name] = blank_to_null(F.array_join(name, ","))
        else:
            columns[name] = blank_to_null(F.col(name))
    return rows.withColumns(columns)


def tail_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text; empty optional members are left out."""
    tags = F.col("tags")
    if rows.schema["tags"].dataType.typeName() != "array":
        tags = F.split(blank_to_null(tags), ",", -1)
    fraction = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    members = [
        F.col("id"),
        F.concat(F.regexp_replace(fraction, r"\.?0+$", ""), F.lit("Z")).alias("ts"),
        F.col("source"),
        F.col("level"),
        F.col("message"),
        *[
            blank_to_null(F.col(name)).alias(name)
            for name in ("trace_id", "process", "component", "thread", "user_id", "request_id")
        ],
        F.when(F.size(tags) > 0, tags).alias("tags"),
    ]
    as_json = F.to_json(F.struct(*members), {"ignoreNullFields": "true"})
    return rows.select(as_json.alias("value"))

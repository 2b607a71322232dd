"""Raw text lines, from files in batch or as a stream, and from Kafka."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.text import trim_space


def clean_lines(lines: DataFrame) -> DataFrame:
    """Drop a closing carriage return, then empty lines; lines of any length stay.

    The pattern decodes and walks through a whole line: only lines that it changes are given to it,
    those with a return at the end or with bytes that are no text.
    """
    value = F.col("value")
    cut = F.regexp_replace(value, r"\r\z", "")
    kept = F.when(value.endswith("\r") | ~F.is_valid_utf8(value), cut).otherwise(value)
    return lines.where(~value.isin("", "\r")).withColumn("value", kept)


def spread(lines: DataFrame) -> DataFrame:
    """Lines on at least as many tasks as there are cores.

    Parsing costs far more than moving a line, and one file without split
    points (gzip, a single row group) would keep it on one core. Input that
    already has enough partitions is returned as it is, without a shuffle.
    """
    wanted = lines.sparkSession.sparkContext.defaultParallelism
    return lines if lines.rdd.getNumPartitions() >= wanted else lines.repartition(wanted)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files; only a line feed ends a line."""
    return clean_lines(spark.read.option("lineSep", "\n").text(path))


def stream_lines(
    spark: SparkSession,
    path: str,
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """Lines of files that arrive under ``path``, with the file's arrival time
    as ``ingest_ts``.

    A file is read once, so files must be moved in complete; ``grown_files``
    finds those that were not. Use Kafka for lines that keep coming.
    """
    lines = (
        spark.readStream.option("lineSep", "\n")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .text(path)
        .select("value", F.col("_metadata.file_modification_time").alias("ingest_ts"))
    )
    return clean_lines(lines)


def grown_files(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """(path, seen, modified): files of a line stream that changed after the stream took them.

    The stream's source log in ``checkpoint`` has the modification time that each
    file was taken with. Lines written later were not read: move such files in
    again under a new name.
    """
    taken = (
        spark.read.text(f"{checkpoint}/sources/0/*")
        .where("value LIKE '{%'")
        .select(F.from_json("value", "path string, timestamp bigint").alias("file"))
        .groupBy(F.url_decode("file.path").alias("path"))
        .agg(F.max("file.timestamp").alias("seen"))
    )
    there = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.unix_millis("modificationTime").alias("modified"))
    )
    plain = lambda name: F.regexp_replace(name, "^file:/+", "/")
    same = plain(F.col("t.path")) == plain(F.col("h.path"))
    changed = taken.alias("t").join(there.alias("h"), same).where("modified > seen")
    return changed.select("h.path", F.timestamp_millis("seen").alias("seen"), F.timestamp_millis("modified").alias("modified"))


def kafka_lines(
    spark: SparkSession,
    servers: str,
    topic: str,
    max_offsets_per_trigger: int = 10_000_000,
) -> DataFrame:
    """Lines from a Kafka topic (needs Spark's Kafka package on the cluster)."""
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        .load()
    )
    lines = records.select(
        F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_ts")
    )
    return clean_lines(lines)


def container_columns(path: Column) -> list[Column]:
    """container and stream_type out of ``.../<container>/<stdout|stderr>*``."""
    pattern = r"([^/]+)/(stdout|stderr)[^/]*$"
    return [
        F.regexp_extract(path, pattern, 1).alias("container"),
        F.regexp_extract(path, pattern, 2).alias("stream_type"),
    ]


def trim_lines(lines: DataFrame) -> DataFrame:
    """Container lines lose white space at both ends; blank ones are dropped."""
    return lines.withColumn("value", trim_space(F.col("value"))).where(F.col("value") != "")


def read_container_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``<path>/<container>/<stdout|stderr>*`` files."""
    lines = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .text(path)
        .select("value", *container_columns(F.col("_metadata.file_path")))
    )
    return trim_lines(lines)


def stream_container_lines(
    spark: SparkSession, path: str, max_files_per_trigger: int = 1000
) -> DataFrame:
    lines = (
        spark.readStream.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_modification_time").alias("ingest_ts"),
            *container_columns(F.col("_metadata.file_path")),
        )
    )
    return trim_lines(lines)

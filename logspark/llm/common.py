"""What the operators share: reading documents, scratch tables, text blocks, slices of a key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.runtime import ensure_checkpoint_dir, own_checkpoint_dir

# Texts are handled in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
# The place of null keys.
LOWEST = -(2**63)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of any table that has them; a null text is an empty one."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    own_checkpoint_dir(spark)
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there."""
    spark = frame.sparkSession
    folder = new_folder(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of neighbouring texts: first row, UTF-8 bytes, and offsets of the rows in them.

    ``column`` has no nulls. The bytes are views of the Arrow buffers.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if not rows:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, places, data = column.buffers()
    ends = np.frombuffer(places, kind, rows + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(ends, ends[first] + BLOCK_BYTES, "right")) - 1
        last = min(max(last, first + 1), rows)
        part = ends[first : last + 1]
        yield first, raw[part[0] : part[-1]], part - part[0]
        first = last


def small_batches(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about BLOCK_BYTES of one column each, so that what is made of them stays small."""
    for first, _, offsets in text_blocks(batch.column(column)):
        yield batch.slice(first, len(offsets) - 1)


def slice_bounds(docs: DataFrame, key: str, count: int) -> list[int]:
    """At most ``count - 1`` rising values that cut a long column into parts of like row counts."""
    shares = [i / count for i in range(1, count)]
    if not shares:
        return []
    row = docs.agg(F.percentile_approx(key, shares, 20 * count).alias("cuts")).first()
    return sorted({int(x) for x in row["cuts"] or []})


def place(values: np.ndarray, bounds: list[int]) -> np.ndarray:
    """How many bounds are at or below each value."""
    return np.searchsorted(np.array(bounds, np.int64), values, "right").astype(np.int32)


def with_slice(docs: DataFrame, key: str, bounds: list[int]) -> DataFrame:
    """Add ``slice``: how many bounds are at or below the key; a null key belongs to slice 0."""


    @F.pandas_udf(T.IntegerType())
    def placed(values):
        import pandas as pd

        return pd.Series(place(values.to_numpy(), bounds))

    return docs.withColumn("slice", placed(F.coalesce(F.col(key), F.lit(LOWEST))))


class Memory(dict):
    """Results of a function for the keys met, in two generations of bounded size.

    Look-ups of known keys run as plain dictionary access. ``age`` starts a new
    generation when the present one is full; keys longer than ``longest`` are
    never kept.
    """

    def __init__(self, make, limit: int, longest: int):
        super().__init__()
        self.make, self.limit, self.longest, self.before = make, limit, longest, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def age(self) -> None:
        if len(self) >= self.limit:
            # The older one goes first, so that there are never three.
            self.before = {}
            self.before = dict(self)
            self.clear()

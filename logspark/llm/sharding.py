"""Shuffled shards by a two-pass external shuffle.

Pass one scatters records into buckets that fit in memory by a seeded hash of
their doc_id. Pass two brings each bucket into a fixed order, shuffles it by
Fisher-Yates with a generator seeded for that bucket, and writes it. The buckets
in a row are one shuffled sequence of all records; shards are its equal parts, so
their row counts differ by one at most. The result depends on the records and
the seed alone.

Null texts, null doc_ids, repeated rows and empty tables are records like any
other; equal doc_ids meet in one bucket. A bucket that such rows make too large
for memory is shuffled in runs of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm.common import new_folder, partitions, read_documents

SHARDS = 24
SEED = 20240
# Bytes of text in a bucket, about, and in a run at most.
BUCKET_BYTES = 32 << 20
RUN_BYTES = 4 * BUCKET_BYTES


def fisher_yates(count: int, generator: np.random.Generator) -> np.ndarray:
    """A random order of 0 .. count-1: each place from the last on swaps with one not after it."""
    order = np.arange(count)
    picks = generator.integers(0, np.arange(count, 0, -1)) if count else order
    swap = order.tolist()
    for last, pick in zip(range(count - 1, 0, -1), picks.tolist()):
        swap[last], swap[pick] = swap[pick], swap[last]
    return np.array(swap, np.int64)


def _spread(seed: int, buckets: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(buckets)).cast("int")


def scatter(docs: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(bucket, record): pass one. Neighbouring partitions hold neighbouring buckets, one each."""
    record = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    return (
        docs.select(
            _spread(seed, buckets).alias("bucket"),
            F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("place"),
            record.alias("record"),
        )
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", "place", "record.doc_id", "record.text")
    )


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(record, shard, slot): every record and its place; ``record`` has all its columns.

    One count for each bucket reaches the driver: as many as the input's bytes
    divided by ``bucket_bytes``, or the session's shuffle partitions if more.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("n")).first()["n"] or 0
    buckets = max(-(-size // bucket_bytes), partitions(spark))
    counts = np.zeros(buckets, np.int64)
    for row in docs.groupBy(_spread(seed, buckets).alias("bucket")).count().collect():
        counts[row["bucket"]] = row["count"]
    offsets = spark.sparkContext.broadcast(np.concatenate([[0], np.cumsum(counts)]))
    total = int(counts.sum())
    # Places at which shards begin.
    begins = np.array([-(-shard * total // shards) for shard in range(shards)], np.int64)

    def dealt(batches, bucket, at, run):
        generator = np.random.Generator(np.random.PCG64([seed, bucket, run]))
        table = pa.Table.from_batches(batches)
        order = fisher_yates(table.num_rows, generator)
        places = offsets.value[bucket] + at + np.arange(table.num_rows)
        shard = np.searchsorted(begins, places, "right") - 1
        # Of shards that begin at one place all but the last are empty.
        table = table.select(["record"]).take(pa.array(order))
        table = table.append_column("shard", pa.array(shard.astype(np.int32)))
        table = table.append_column("slot", pa.array(places - begins[shard]))
        yield from table.to_batches(max_chunksize=2048)

    def run(batches):
        held, size, bucket, at, number = [], 0, None, 0, 0
        for batch in batches:
            values = batch.column("bucket").to_numpy()
            borders = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
            for first, last in zip(borders, borders[1:]):
                if first == last:
                    continue
                if held and (values[first] != bucket or size > RUN_BYTES):
                    yield from dealt(held, bucket, at, number)
                    at, number = at + sum(part.num_rows for part in held), number + 1
                    held, size = [], 0
                if values[first] != bucket:
                    bucket, at, number = int(values[first]), 0, 0
                held.append(batch.slice(first, last - first))
                size += batch.nbytes * (last - first) // batch.num_rows
        if held:
            yield from dealt(held, bucket, at, number)

    spread = scatter(docs, buckets, seed).select("bucket", "record")
    schema = T.StructType(
        [spread.schema["record"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    )
    return spread.mapInArrow(run, schema)


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write ``folder/shard=N``: within a shard, files by name and rows in them follow the shuffled order."""
    shuffled(docs, shards, seed).write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """(record, shard, slot) of written shards; ``docs`` gives the columns of a record."""
    record = T.StructField("record", T.StructType(docs.schema.fields))
    schema = T.StructType([record, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(folder)


def op10_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    folder = new_folder(spark, "shards")
    write_shards(docs, folder)
    text = F.encode(F.coalesce("record.text", F.lit("")), "UTF-8")
    return read_shards(spark, folder, docs).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

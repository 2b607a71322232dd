"""Bottom-k sketches of word shingles.

A sketch holds the k smallest hashes of a text's shingle set. Sketches of parts
merge into the sketch of the whole; two of them estimate resemblance and
containment, one of them the number of distinct shingles. With fewer than k
shingles every estimate is exact.

Texts: null is empty; a text without words has the empty sketch, and one with
fewer words than a shingle has its whole sequence as its only shingle. Equal
texts have equal sketches.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import partitions, read_documents, slice_bounds, texts, text_blocks, with_slice
from logspark.llm.hashing import shingle_sets

SHINGLE_WORDS = 5
SKETCH_SIZE = 128
_SPACE = float(2**64)


def sketches(column: pa.Array, width: int = SHINGLE_WORDS, size: int = SKETCH_SIZE) -> list[np.ndarray]:
    """The sketch of each text: rising distinct uint64 values, at most ``size``."""
    out = []
    for _, raw, offsets in text_blocks(column):
        values, places = shingle_sets(raw, offsets, width)
        out += [values[a : min(b, a + size)] for a, b in zip(places[:-1], places[1:])]
    return out


def merge(one: np.ndarray, two: np.ndarray, size: int = SKETCH_SIZE) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return np.union1d(one, two)[:size]


def distinct_count(sketch: np.ndarray, size: int = SKETCH_SIZE) -> float:
    if len(sketch) < size:
        return float(len(sketch))
    return (size - 1) / ((float(sketch[-1]) + 1) / _SPACE)


def resemblance(one: np.ndarray, two: np.ndarray, size: int = SKETCH_SIZE) -> float:
    """Share of the union that is common; 1 for two empty sets."""
    union = merge(one, two, size)
    if not len(union):
        return 1.0
    common = np.intersect1d(one, two, assume_unique=True)
    return float(np.searchsorted(common, union[-1], "right")) / len(union)


def containment(one: np.ndarray, two: np.ndarray, size: int = SKETCH_SIZE) -> float:
    """Share of the first set that the second has too; 1 if the first is empty."""
    if not len(one):
        return 1.0
    common = resemblance(one, two, size) * distinct_count(merge(one, two, size), size)
    return min(1.0, common / distinct_count(one, size))


def to_text(sketch: np.ndarray) -> str:
    """Base64 of the big-endian values."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, size: int = SKETCH_SIZE) -> DataFrame:
    """(doc_id, text, fingerprint, shingles): the sketch of every text and its distinct count."""

    def run(batches):
        for batch in batches:
            found = sketches(batch.column("text"), width, size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array([to_text(x) for x in found], pa.string()),
                    pa.array([distinct_count(x, size) for x in found], pa.float64()),
                ],
                names=["doc_id", "text", "fingerprint", "shingles"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, text string, fingerprint string, shingles double")


_EDITS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def with_next(docs: DataFrame) -> DataFrame:
    """Documents in slices by doc_id, each slice closed by the first document of the next one.

    ``halo`` is 0 for a slice's own rows. Rows of one doc_id (null sorts first)
    stay in one slice, ordered by text. The last slice is closed by the first
    document of all. Only doc_ids of slice heads reach the driver, at most one
    for each slice.
    """
    spark = docs.sparkSession
    count = partitions(spark)
    rows = texts(docs)
    bounds = slice_bounds(rows.select("doc_id"), "doc_id", count)
    placed = with_slice(rows, "doc_id", bounds)
    heads = (
        with_slice(rows.select("doc_id"), "doc_id", bounds)
        .groupBy("slice")
        .agg(F.min("doc_id").alias("head"), F.bool_or(F.isnull("doc_id")).alias("no_id"))
        .orderBy("slice")
        .collect()
    )
    # A slice that holds null ids begins with one.
    starts = [None if row["no_id"] else row["head"] for row in heads]
    closes = [
        (starts[at], heads[at - 1]["slice"], int(at == 0)) for at in range(len(heads))
    ]
    table = spark.createDataFrame(closes, "head long, slice int, wraps int")
    halo = (
        rows.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("head")))
        .select("doc_id", "text", "slice", F.lit(1).alias("halo"))
    )
    own = placed.withColumn("halo", F.lit(0))
    return (
        own.unionByName(halo)
        .repartitionById(len(bounds) + 1, F.col("slice"))
        .sortWithinPartitions("slice", "halo", "doc_id", "text")
    )


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def edit_report(docs: DataFrame, width: int = SHINGLE_WORDS, size: int = SKETCH_SIZE) -> DataFrame:
    """Per document: its sketch, that of its edited text, and its likeness to that and to the next document's."""

    def run(batches):
        # The last document waits for the next one, maybe in the next batch.
        waiting = None
        for batch in batches:
            ids, halos = batch.column("doc_id").to_pylist(), batch.column("halo").to_pylist()
            values = batch.column("text").to_pylist()
            at = 0
            while at < len(ids):
                # Pieces of a batch bound the memory that edited texts take.
                to, taken = at, 0
                while to < len(ids) and taken < 4_000_000:
                    taken += len(values[to])
                    to += 1
                rows = [(ids[i], halos[i], values[i]) for i in range(at, to)]
                at = to
                marks = sketches(pa.array([row[2] for row in rows], pa.large_string()), width, size)
                rows = [(*row, mark) for row, mark in zip(rows, marks)]
                if waiting is not None:
                    rows.insert(0, waiting)
                waiting = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[1] == 0]
                if pairs:
                    yield report(pairs)
        # A slice alone in its partition always ends with a halo row.

    def report(pairs):
        changed = [edited(a[2], b[2]) for a, b in pairs]
        marks = sketches(pa.array(changed, pa.large_string()), width, size)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a, _ in pairs], pa.int64()),
                pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                pa.array([to_text(a[3]) for a, _ in pairs], pa.string()),
                pa.array([to_text(x) for x in marks], pa.string()),
                pa.array([resemblance(a[3], x, size) for (a, _), x in zip(pairs, marks)], pa.float64()),
                pa.array([resemblance(a[3], b[3], size) for a, b in pairs], pa.float64()),
            ],
            names=[part.split()[0] for part in _EDITS.split(", ")],
        )

    return with_next(docs).mapInArrow(run, _EDITS)


def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(read_documents(spark, sf_dir))

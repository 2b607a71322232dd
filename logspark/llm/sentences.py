"""Removing repeated passages by sliding spans of sentences.

A sentence ends with a word that ends in a dot, an exclamation or a question mark, or that
a line feed follows. One of more than PIECE words is cut before the word of least hash
among any PIECE in a row (the last of equals), so a piece has at most PIECE words, and
where a passage is cut depends on its own words alone. White space belongs to the word
before it, at the start of a text to nothing: the start and the pieces, joined, are the text.

At every piece a span begins: the fewest following pieces that are at least SPAN and have
at least WORDS words together. Its words are hashed (128 bits). Spans that occur more than
once anywhere, within a document too, are repeats; the first is the one of the least
(doc_id, mark, place). A piece goes if any span over it is a repeat and not the first.

Any 51 words of a passage hold a whole span, wherever it begins: a cut comes within PIECE
words, and the span ends within 3 * PIECE words of it. Shorter passages may hold one.

Texts without a span, null and empty ones stay as they are. Rows that differ in doc_id or in
the mark of their text (128 bits) are different documents; rows with equal doc_id
(or none) and equal text are copies of one and lose the same pieces. Rows without
doc_id come before all others.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm.common import Memory, read_documents, text_blocks, texts, written
from logspark.llm.hashing import Words, least_last, sequence_hashes

PIECE, SPAN, WORDS = 12, 3, 24
# Words whose ranks a worker keeps, in one of two generations, and the longest worth keeping.
KEPT_WORDS, KEPT_BYTES = 50_000, 60
_MARKS = np.zeros(256, bool)
_MARKS[list(b".!?")] = True


def digest(word: bytes) -> bytes:
    """A word's MD5. Words are compared for cuts by its first 64 bits."""
    return hashlib.md5(word, usedforsecurity=False).digest()


@functools.cache
def _digests() -> Memory:
    return Memory(digest, KEPT_WORDS, KEPT_BYTES)


class Pieces:
    """The pieces of a block of texts.

    ``starts`` holds the first word of each, and one more entry for the end;
    ``first`` the first piece of each text, likewise.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words = self.words = Words(raw, offsets)
        data = raw.tobytes()
        edges = offsets.tolist()
        spelled = [word for a, b in zip(edges, edges[1:]) for word in data[a:b].split()]
        count = len(spelled)
        #: Two numbers of 64 bits for each word.
        self.halves = np.zeros((0, 2), np.uint64)
        begins = np.zeros(count + 1, bool)
        begins[words.first] = True
        if count:
            feeds = np.concatenate([[0], np.cumsum(raw == 10)])
            until = np.append(words.starts[1:], len(raw))
            ends = _MARKS[raw[words.ends - 1]] | (feeds[until] > feeds[words.ends])
            begins[1:] |= ends
            memory = _digests()
            found = b"".join(map(memory.__getitem__, spelled))
            memory.age()
            self.halves = np.frombuffer(found, ">u8").astype(np.uint64).reshape(count, 2)
            sentence = np.cumsum(begins[:-1])
            whole = sentence[: max(0, count - PIECE + 1)] == sentence[PIECE - 1 :]
            begins[least_last(self.halves[:, 0], PIECE)[whole]] = True
        begins[count] = True
        self.starts = np.flatnonzero(begins)
        self.first = np.searchsorted(self.starts, words.first)

    @functools.cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """The first piece of each span, and the piece after its last one."""
        begin = np.arange(len(self.starts) - 1)
        end = np.maximum(np.searchsorted(self.starts, self.starts[:-1] + WORDS), begin + SPAN)
        last = np.repeat(self.first[1:], np.diff(self.first))
        inside = end <= last
        return begin[inside], end[inside]

    def hashes(self) -> list[np.ndarray]:
        """Two hashes of 64 bits for the words of each span."""
        begin, end = (self.starts[at] for at in self.spans)
        return [sequence_hashes(half, begin, end) for half in self.halves.T]

    def without(self, text: int, places: np.ndarray) -> tuple[bytes, int]:
        """A text without the spans that begin at some of its pieces, and how many pieces went."""
        first, stop = self.first[text], self.first[text + 1]
        begin, end = self.spans
        at = np.searchsorted(begin, places + first)
        gone = np.zeros(stop - first + 1, np.int64)
        np.add.at(gone, begin[at] - first, 1)
        np.add.at(gone, end[at] - first, -1)
        gone = np.cumsum(gone[:-1]) > 0
        edges = np.append(self.words.starts[self.starts[first:stop]], self.words.offsets[text + 1])
        spans = np.column_stack([edges[:-1], edges[1:]])[~gone].tolist()
        raw = self.words.raw
        head = raw[self.words.offsets[text] : edges[0]].tobytes()
        return b"".join([head, *(raw[a:b].tobytes() for a, b in spans)]), int(gone.sum())

    def texts_of(self, pieces: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, pieces, "right") - 1


#: What tells documents apart, besides the place of a span in them.
DOCUMENT = ["doc_id", "mark_high", "mark_low"]


def marks(text: Column) -> list[Column]:
    """128 bits of a text: two hashes of different seeds."""
    return [F.xxhash64(text).alias("mark_high"), F.xxhash64(F.lit(1), text).alias("mark_low")]


def span_rows(docs: DataFrame) -> DataFrame:
    """(high, low, doc_id, mark_high, mark_low, place) of every span."""

    def run(batches):
        for batch in batches:
            for at, raw, offsets in text_blocks(batch.column("text")):
                found = Pieces(raw, offsets)
                begin, _ = found.spans
                owners = found.texts_of(begin)
                high, low = found.hashes()
                rows_of = pa.array(owners + at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(high.view(np.int64)),
                        pa.array(low.view(np.int64)),
                        *[batch.column(name).take(rows_of) for name in DOCUMENT],
                        pa.array((begin - found.first[owners]).astype(np.int32)),
                    ],
                    names=["high", "low", *DOCUMENT, "place"],
                )

    rows = texts(docs)
    rows = rows.select("doc_id", *marks(F.col("text")), "text")
    return rows.mapInArrow(run, "high long, low long, doc_id long, mark_high long, mark_low long, place int")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, mark_high, mark_low, places): where non-first repeated spans begin in each document that has some.

    Spans are counted with partial sums, and a span met in very many documents only
    makes one side of the join long, which adaptive execution can split. Which of a span's
    rows is the first is found among the repeated ones alone.
    """
    rows = written(span_rows(docs), "spans")
    counted = rows.groupBy("high", "low").agg(F.count("*").alias("n"))
    # Written, so that both sides of the join are dealt for it alone and a hot span can be split.
    known = written(counted.where("n > 1").select("high", "low"), "repeats")
    met = written(rows.join(known, ["high", "low"]), "met")
    spot = F.struct(*DOCUMENT, "place")
    first = written(met.groupBy("high", "low").agg(F.min(spot).alias("first")), "first")
    again = met.join(first, ["high", "low"]).where(~spot.eqNullSafe(F.col("first")))
    return again.groupBy(*DOCUMENT).agg(F.collect_set("place").alias("places"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with shortened texts."""
    return cut_documents(docs).select("record.*")


def cut_documents(docs: DataFrame) -> DataFrame:
    """(record, n_sentences, n_removed): the rows of ``docs`` as structs, with shortened texts.

    The numbers are those of pieces, which are sentences or parts of long ones.
    """
    found = repeats(docs)
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id"))
    for mark, name in zip(marks(F.col("d.text").cast("string")), DOCUMENT[1:]):
        same &= mark == F.col(f"r.{name}")
    marked = docs.alias("d").join(found.alias("r"), same, "left")

    def run(batches):
        for batch in batches:
            texts_in = batch.column("text")
            for at, raw, offsets in text_blocks(texts_in.fill_null("")):
                found = Pieces(raw, offsets)
                part = batch.slice(at, len(offsets) - 1)
                kept, removed = texts_in.slice(at, len(part)).to_pylist(), [0] * len(part)
                for text, places in enumerate(part.column("places")):
                    if places.is_valid:
                        cut, removed[text] = found.without(text, places.values.to_numpy())
                        kept[text] = cut.decode()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        pa.array(kept, pa.string()),
                        pa.array(np.diff(found.first)),
                        pa.array(removed, pa.int64()),
                    ],
                    names=["row", "text", "n_sentences", "n_removed"],
                )

    slim = F.struct(*[F.col(f"d.`{name}`") for name in docs.columns if name != "text"]).alias("row")
    text = F.col("d.text").cast("string")
    laid = marked.select(slim, text.alias("text"), F.col("r.places").alias("places"))
    schema = T.StructType(
        [
            laid.schema["row"],
            T.StructField("text", T.StringType()),
            T.StructField("n_sentences", T.LongType()),
            T.StructField("n_removed", T.LongType()),
        ]
    )
    columns = [
        (F.col("text") if name == "text" else F.col(f"row.`{name}`")).alias(name) for name in docs.columns
    ]
    out = laid.mapInArrow(run, schema)
    return out.select(F.struct(*columns).alias("record"), "n_sentences", "n_removed")


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return cut_documents(docs).select("record.doc_id", "n_sentences", "n_removed", "record.text")

"""Token ids in blocks of interleaved range asymmetric numeral systems (rANS).

Documents are taken in runs of some million ids. The ids of a run are counted,
and their frequencies, scaled to a power of two, are the table that all blocks of
the run share. A block holds whole documents. Its ids are dealt in turns to lanes,
each with a 64-bit state, and all lanes write 32-bit words to one stream, so that
encoder and decoder treat a row of ids (one for each lane) in a few vector steps.
A block keeps the lane states and the stream position at checkpoints, from which
its parts decode independently, and checksums of stream and ids.

File format: a folder of Parquet files, one row for each run, in the order of
doc_id. A row has slice (a part of the doc_id range), run, start (ids of the slice
before it), n_tokens, the table (bits, ids, frequencies), and its blocks: n_tokens,
lanes, doc_ids, doc_tokens, marks (for each checkpoint its first row of ids, words
before it and lane states), words, words_crc32 and ids_crc32.

Null and empty texts have the end id alone. Documents of one doc_id (or without
one: they come first) follow each other, ordered by their ids. An empty input
makes a folder without blocks.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from logspark.llm.common import LOWEST, new_folder, partitions, place, read_documents, slice_bounds, texts
from logspark.llm.tokens import id_kind, token_rows

SCALE_BITS = 20
LANES = 512
BLOCK_TOKENS = 1 << 17
RUN_TOKENS = 1 << 22
CHECKPOINT_TOKENS = 1 << 16
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each id that occurs."""
    total = int(counts.sum())
    present = counts > 0
    if not total:
        return np.zeros(len(counts), np.int64)
    size = 1 << bits
    if int(present.sum()) > size:
        raise ValueError("more ids than the scale has places")
    out = np.where(present, np.maximum(1, counts * (size / total)).astype(np.int64), 0)
    # The largest ones bear the rounding: their shares change least.
    order = np.argsort(-out, kind="stable")
    rest = size - int(out.sum())
    at = 0
    while rest:
        step = rest if rest > 0 else max(rest, 1 - int(out[order[at]]))
        out[order[at]] += step
        rest -= step
        at += 1
    return out


class Table:
    def __init__(self, ids: np.ndarray, frequencies: np.ndarray, bits: int):
        self.bits, self.mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        self.ids = ids.astype(np.uint32)
        self.frequencies = frequencies.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64)

    @functools.cached_property
    def places(self) -> np.ndarray:
        """The id of each slot, as its place in the table."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.frequencies.astype(np.int64))

    def encode(self, ids: np.ndarray, lanes: int, every: int):
        """Stream words, and checkpoints as (row, words before it, states)."""
        rows = -(-len(ids) // lanes)
        # Unused places of the last row hold the first id of the table.
        grid = np.zeros(rows * lanes, np.int64)
        grid[: len(ids)] = np.searchsorted(self.ids, ids)
        grid = grid.reshape(rows, lanes)
        states = np.full(lanes, _LOW, np.uint64)
        limit_shift = np.uint64(63) - self.bits
        pieces, marks, written = [], [], 0
        for row in range(rows - 1, -1, -1):
            frequency = self.frequencies[grid[row]]
            full = states >= (frequency << limit_shift)
            words = states[full].astype(np.uint32)
            states[full] >>= _WORD
            quotient = states // frequency
            states = (quotient << self.bits) + (states - quotient * frequency) + self.starts[grid[row]]
            pieces.append(words)
            written += len(words)
            if row % every == 0:
                marks.append((row, written, states.copy()))
        stream = np.concatenate(pieces[::-1])
        return stream, [(row, written - after, kept) for row, after, kept in marks[::-1]]

    def decode(self, stream: np.ndarray, at: int, states: np.ndarray, rows: int) -> np.ndarray:
        """The ids of ``rows`` rows from a checkpoint on."""
        out = np.empty((rows, len(states)), np.int32)
        states = states.copy()
        for row in range(rows):
            slot = states & self.mask
            symbols = self.places[slot]
            out[row] = symbols
            states = self.frequencies[symbols] * (states >> self.bits) + slot - self.starts[symbols]
            low = states < _LOW
            need = int(np.count_nonzero(low))
            states[low] = (states[low] << _WORD) | stream[at : at + need].astype(np.uint64)
            at += need
        return self.ids[out.reshape(-1)]


_MARK = pa.struct([("row", pa.int64()), ("word", pa.int64()), ("states", pa.binary())])
_BLOCK = pa.struct(
    [
        ("n_tokens", pa.int64()), ("lanes", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())), ("marks", pa.list_(_MARK)), ("words", pa.binary()),
        ("words_crc32", pa.int64()), ("ids_crc32", pa.int64()),
    ]
)
_RUN = pa.schema(
    [
        ("slice", pa.int32()), ("run", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
        ("bits", pa.int32()), ("ids", pa.binary()), ("frequencies", pa.binary()), ("blocks", pa.list_(_BLOCK)),
    ]
)


def encode_block(table: Table, doc_ids: list, parts: list[np.ndarray], lanes: int, every: int) -> dict:
    ids = np.concatenate(parts).astype("<u4")
    width = min(lanes, max(1, 1 << (len(ids) // 32).bit_length()))
    stream, marks = table.encode(ids, width, max(1, every // width))
    words = stream.astype("<u4").tobytes()
    return {
        "n_tokens": len(ids),
        "lanes": width,
        "doc_ids": doc_ids,
        "doc_tokens": [len(part) for part in parts],
        "marks": [{"row": r, "word": w, "states": s.astype("<u8").tobytes()} for r, w, s in marks],
        "words": words,
        "words_crc32": zlib.crc32(words),
        "ids_crc32": zlib.crc32(ids.tobytes()),
    }


def decode_block(table: Table, block: dict) -> np.ndarray:
    """The ids of a block; each checkpoint begins a part of its own."""
    _checked(block["words"], block["words_crc32"], "a stream")
    stream = np.frombuffer(block["words"], "<u4")
    marks = block["marks"]
    closes = [mark["row"] for mark in marks[1:]] + [-(-block["n_tokens"] // block["lanes"])]
    parts = []
    for mark, close in zip(marks, closes):
        states = np.frombuffer(mark["states"], "<u8").astype(np.uint64)
        parts.append(table.decode(stream, mark["word"], states, close - mark["row"]))
    ids = np.concatenate(parts)[: block["n_tokens"]].astype("<u4")
    _checked(ids.tobytes(), block["ids_crc32"], "ids")
    return ids


def encode_run(doc_ids: list, parts: list[np.ndarray], lanes: int, block_tokens: int, every: int) -> dict:
    """The table of some documents, and their blocks."""
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    bits = max(SCALE_BITS, int(len(values) - 1).bit_length())
    frequencies = scaled(counts, bits)
    table = Table(values, frequencies, bits)
    blocks, first, held = [], 0, 0
    for at, part in enumerate(parts):
        held += len(part)
        if held >= block_tokens or at + 1 == len(parts):
            span = slice(first, at + 1)
            blocks.append(encode_block(table, doc_ids[span], parts[span], lanes, every))
            first, held = at + 1, 0
    return {
        "bits": bits,
        "ids": values.astype("<u4").tobytes(),
        "frequencies": frequencies.astype("<u4").tobytes(),
        "blocks": blocks,
    }


def _checked(raw: bytes, expected: int, what: str) -> None:
    if zlib.crc32(raw) != expected:
        raise ValueError(f"checksum of {what} does not match")


def write_ids(
    tokens: DataFrame,
    folder: str,
    kind: str = "<u4",
    lanes: int = LANES,
    run_tokens: int = RUN_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
    checkpoint_tokens: int = CHECKPOINT_TOKENS,
) -> None:
    """Write rows of slice, doc_id and ids, each slice in one partition, as files in ascending doc_id order.

    A task holds the ids of one run.
    """

    def run(batches):
        place, number, start, doc_ids, parts, held = None, 0, 0, [], [], 0

        def close():
            row = {"slice": place, "run": number, "start": start, "n_tokens": held}
            row |= encode_run(doc_ids, parts, lanes, block_tokens, checkpoint_tokens)
            return pa.RecordBatch.from_pylist([row], _RUN)

        for batch in batches:
            columns = [batch.column(name) for name in ("slice", "doc_id", "ids")]
            for at, doc_id, ids in zip(*columns):
                at = at.as_py()
                if parts and (at != place or held >= run_tokens):
                    yield close()
                    number, start, doc_ids, parts, held = number + 1, start + held, [], [], 0
                if at != place:
                    place, number, start = at, 0, 0
                doc_ids.append(doc_id.as_py())
                parts.append(np.frombuffer(ids.as_buffer(), kind))
                held += len(parts[-1])
        if parts:
            yield close()

    rows = tokens.select("slice", "doc_id", "ids").sortWithinPartitions("slice", "doc_id", "ids")
    # Encoded words do not compress further.
    rows.mapInArrow(run, from_arrow_schema(_RUN)).write.option("compression", "none").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a folder.

    Runs decode independently of each other. What slices hold before each other
    is summed on the driver: one number for each slice.
    """
    runs = spark.read.schema(from_arrow_schema(_RUN)).parquet(folder)
    before, passed = {}, 0
    for row in runs.groupBy("slice").agg(F.sum("n_tokens").alias("n")).orderBy("slice").collect():
        before[row["slice"]] = passed
        passed += row["n"]
    shared = spark.sparkContext.broadcast(before)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                table = Table(np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["frequencies"], "<u4"), row["bits"])
                start = shared.value[row["slice"]] + row["start"]
                for block in row["blocks"]:
                    raw = decode_block(table, block).tobytes()
                    ends = np.cumsum(block["doc_tokens"])
                    starts = ends - block["doc_tokens"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(block["doc_ids"], pa.int64()),
                            pa.array(starts + start, pa.int64()),
                            pa.array(block["doc_tokens"], pa.int64()),
                            pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, ends)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    start += block["n_tokens"]

    return runs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def encode_documents(docs: DataFrame, tokenizer_path: str, folder: str) -> None:
    """Tokenise documents and write their ids to a folder.

    Slices of doc_id are fixed beforehand from the ids alone, so the only shuffle
    moves token ids, and a task run again deals them out alike.
    """
    kind = id_kind(tokenizer_path)
    bounds = slice_bounds(texts(docs).select("doc_id"), "doc_id", partitions(docs.sparkSession))
    which = ("slice", pa.int32(), lambda ids, _: place(ids.fill_null(LOWEST).to_numpy(), bounds))
    tokens = token_rows(docs, tokenizer_path, kind=kind, extra=which)
    write_ids(tokens.repartitionById(len(bounds) + 1, F.col("slice")), folder, kind)


def op2_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "rans")
    encode_documents(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), folder)
    back = read_ids(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

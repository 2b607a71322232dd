"""Packing documents into token windows by lexical retrieval.

Documents are laid out by a signature that puts lexically alike ones near each
other, and cut into shards of bounded token count. Each shard has an inverted
index with BM25 weights, whose document frequencies and mean length are those of
the whole corpus. A seed document opens a window; the index returns its unused
neighbours by score, and they fill the window one after the other. The last one
is cut where the window ends, and its rest is the next seed. Thus every window
but the last of a task is full; that one is cut into windows whose sizes are
powers of two, which need no padding either.

Null and empty texts consist of the end id alone. Repeated rows are packed as
often as they occur. Each id of a document lies in exactly one piece.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import partitions, read_documents, written
from logspark.llm.hashing import mix
from logspark.llm.tokens import (
    KEPT_CHUNKS,
    collected_counts,
    document_counts,
    id_kind,
    token_rows,
    vocabulary_size,
)

WINDOW = 2048
SHARD_TOKENS = 1 << 20
# Tokens that one task packs, about.
TASK_TOKENS = 1 << 23
K1, B = 1.2, 0.75
# Neighbours taken from one look at the scores; more are fetched as needed.
_BEST = 32


@functools.cache
def _token_hashes(size: int) -> np.ndarray:
    """Four hashes of 32 bits for each id."""
    turns = [np.arange(size, dtype=np.uint64) + np.uint64((turn + 1) << 32) for turn in range(4)]
    return np.stack([(mix(tokens) >> np.uint64(32)).astype(np.uint32) for tokens in turns])


def signature(ids: np.ndarray, size: int) -> int:
    """Four minima of token hashes in a row, 15 bits each: alike token sets sort near each other."""
    value = 0
    for hashes in _token_hashes(size):
        value = value << 15 | int(hashes[ids].min()) & 0x7FFF
    return value


class Index:
    """BM25 weights of a shard's documents, by token and by document.

    Tokens that stand in more than half of the corpus have no positive weight
    in BM25 and are left out, which changes no score.
    """

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.count = len(documents)
        lengths = np.array([len(ids) for ids in documents])
        sets = [np.unique(ids, return_counts=True) for ids in documents]
        owner = np.repeat(np.arange(self.count), [len(tokens) for tokens, _ in sets])
        token = np.concatenate([tokens for tokens, _ in sets])
        times = np.concatenate([counts for _, counts in sets])
        useful = idf[token] > 0
        owner, token, times = owner[useful], token[useful], times[useful]
        norm = K1 * (1 - B + B * lengths[owner] / mean_length)
        weight = idf[token] * times * (K1 + 1) / (times + norm)
        self.tokens_of = token
        self.first_of = np.searchsorted(owner, np.arange(self.count + 1))
        order = np.argsort(token, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.known, starts = np.unique(token[order], return_index=True)
        self.starts = np.append(starts, len(order))

    def query_of(self, document: int) -> np.ndarray:
        return self.tokens_of[self.first_of[document] : self.first_of[document + 1]]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The score of every document for a set of tokens."""
        at = np.searchsorted(self.known, query)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == query)] if len(self.known) else at[:0]
        sizes = self.starts[at + 1] - self.starts[at]
        total = int(sizes.sum())
        if not total:
            return np.zeros(self.count)
        ends = np.cumsum(sizes)
        places = np.arange(total) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        return np.bincount(self.owner[places], self.weight[places], self.count)


class Packer:
    """Fills windows; ``take`` packs a shard, ``close`` ends the open window."""

    def __init__(self, window: int, number: int):
        self.window, self.number = window, number
        self.open: list[tuple] = []
        self.room = window
        self.query = np.zeros(0, np.int64)
        self.done: list[tuple] = []

    def _put(self, doc_id, ids: np.ndarray, start: int) -> int:
        """Lay ids from ``start`` on into the open window; returns where they had to stop."""
        piece = ids[start : start + self.room]
        self.open.append((doc_id, start, piece, len(ids)))
        self.room -= len(piece)
        if not self.room:
            self._emit(self.open)
            self.open, self.room = [], self.window
        return start + len(piece)

    def _emit(self, pieces) -> None:
        offset = 0
        for doc_id, start, piece, size in pieces:
            self.done.append((doc_id, start, piece, size, self.number, offset))
            offset += len(piece)
        self.number += 1

    def _place(self, doc_id, ids: np.ndarray) -> bool:
        """Lay a whole document; whether its rest opened a window."""
        at = self._put(doc_id, ids, 0)
        opened = False
        while at < len(ids):
            opened = True
            at = self._put(doc_id, ids, at)
        return opened and bool(self.open)

    def take(self, doc_ids: list, documents: list[np.ndarray], index: Index) -> None:
        unused = np.ones(len(documents), bool)
        seed = 0

        def lay(document: int) -> bool:
            unused[document] = False
            return self._place(doc_ids[document], documents[document])

        while True:
            if not self.open:
                while seed < len(documents) and not unused[seed]:
                    seed += 1
                if seed == len(documents):
                    return
                lay(seed)
                self.query = index.query_of(seed)
                if not self.open:
                    continue
            scores = np.where(unused, index.scores(self.query), -1.0)
            top = np.arange(len(scores))
            if len(top) > _BEST:
                top = np.argpartition(-scores, _BEST - 1)[:_BEST]
            best = top[np.lexsort((top, -scores[top]))]
            if scores[best[0]] < 0:
                return
            for document in best.tolist():
                if not unused[document]:
                    break
                if lay(document):
                    # A rest opened the next window: it is the seed.
                    self.query = index.query_of(document)
                    break
                if not self.open:
                    break

    def close(self) -> None:
        """Cut the open window into ones whose sizes are powers of two."""
        filled, pieces = self.window - self.room, self.open
        while filled:
            size = 1 << (filled.bit_length() - 1)
            filled -= size
            part, rest = [], []
            for doc_id, start, piece, whole in pieces:
                if size:
                    part.append((doc_id, start, piece[:size], whole))
                if len(piece) > size:
                    rest.append((doc_id, start + size, piece[size:], whole))
                size -= min(size, len(piece))
            self._emit(part)
            pieces = rest
        self.open, self.room = [], self.window


_PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


def pack_tokens(
    tokens: DataFrame, size: int, kind: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Pieces of rows of doc_id, ids, n_tokens and signature, which must be cheap to read again.

    A task holds the ids and the index of one shard. The driver gets two sums
    and one count for each id of the vocabulary.
    """
    spark = tokens.sparkSession
    whole = tokens.agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens")).first()
    rows, total = whole["rows"], whole["tokens"] or 0
    counts = collected_counts(document_counts(tokens, size, kind), size)
    idf = np.maximum(np.log((rows - counts + 0.5) / (counts + 0.5)), 0.0)
    shared = spark.sparkContext.broadcast(idf)
    mean_length = total / max(rows, 1)

    def run(batches):
        from pyspark import TaskContext

        idf = shared.value
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        doc_ids, documents, held = [], [], 0

        def pieces():
            while packer.done:
                part, packer.done = packer.done[:4096], packer.done[4096:]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in part], pa.int64()),
                        pa.array([x[1] for x in part], pa.int64()),
                        pa.array([len(x[2]) for x in part], pa.int64()),
                        pa.array([x[2].astype("<u4").tobytes() for x in part], pa.binary()),
                        pa.array([x[3] for x in part], pa.int64()),
                        pa.array([x[4] for x in part], pa.int64()),
                        pa.array([x[5] for x in part], pa.int64()),
                    ],
                    names=[name.split()[0] for name in _PIECES.split(", ")],
                )

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                doc_ids.append(doc_id)
                documents.append(np.frombuffer(ids.as_buffer(), kind))
                held += len(documents[-1])
                if held >= shard_tokens:
                    packer.take(doc_ids, documents, Index(documents, idf, mean_length))
                    doc_ids, documents, held = [], [], 0
                    yield from pieces()
        if documents:
            packer.take(doc_ids, documents, Index(documents, idf, mean_length))
        packer.close()
        yield from pieces()

    parts = max(1, min(partitions(spark), -(-total // window)), -(-total // TASK_TOKENS))
    laid = tokens.repartitionByRange(parts, "signature", "doc_id").sortWithinPartitions(
        "signature", "doc_id", "ids"
    )
    return laid.select("doc_id", "ids").mapInArrow(run, _PIECES)


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, kept: int = KEPT_CHUNKS
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents.

    ``ids`` holds a piece's ids as little-endian uint32. Texts are tokenised once,
    into a table in the shared folder; ``kept`` bounds what a worker remembers for it.
    """
    kind, size = id_kind(tokenizer_path), vocabulary_size(tokenizer_path)
    sign = ("signature", pa.int64(), lambda _, ids: [signature(np.frombuffer(x, kind), size) for x in ids])
    tokens = written(token_rows(docs, tokenizer_path, kind=kind, extra=sign, kept=kept), "tokens")
    return pack_tokens(tokens, size, kind, window)


def op1_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )

"""Texts to token ids with a word-level tokenizer file, by the tokenizers library.

The tokenizer drops white space and never joins what it parts, so a text's ids
are those of its space-separated chunks in order. Chunks repeat; each worker
keeps the ids of those it has met, in two generations of bounded size.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import Memory, small_batches, texts

END_ID = 1
# A chunk of letters that composition leaves alone and case folds one by one, then
# marks: two pieces to the tokenizer, the first of which its model takes as it is.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
# Entries in one generation of the memory, and the longest one worth keeping.
WIDE, NARROW = "<u4", "<u2"
KEPT_CHUNKS, KEPT_CHARS = 640_000, 40


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte, as Latin-1 text maps to it.

    Visible bytes stand for themselves, the others follow from U+0100 in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + at) for at, byte in enumerate(hidden)}


class ChunkEncoder:
    """Ids of texts as bytes: little-endian uint32, or uint16 for a small vocabulary."""

    def __init__(self, tokenizer, kind: str = WIDE, kept: int = KEPT_CHUNKS):
        self.kind, self.code = kind, {WIDE: "I", NARROW: "H"}[kind]
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        self.memory = Memory(self._chunk, kept, KEPT_CHARS)

    def _ids(self, word: str) -> bytes:
        return array(self.code, [token.id for token in self.model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            # Most chunks: one piece to the tokenizer.
            return self._ids(chunk) if chunk.islower() else self.memory[chunk.lower()]
        plain = _PLAIN.fullmatch(chunk)
        if plain is None:
            found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            return np.array(found, self.kind).tobytes()
        word, marks = plain[1].lower(), plain[2]
        if marks:
            return self.memory[word] + self.memory[marks]
        if word != chunk:
            return self.memory[word]
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return self._ids(word)

    def encode(self, text: str) -> bytes:
        # Line feeds are white space to the tokenizer just as spaces are.
        ids = b"".join(map(self.memory.__getitem__, text.replace("\n", " ").split(" ")))
        self.memory.age()
        return ids


@functools.cache
def encoder(definition: bytes, kind: str = WIDE, kept: int = KEPT_CHUNKS) -> ChunkEncoder:
    """The encoder of a tokenizer file; it refuses one that parts words in another way."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition.decode())
    found = ChunkEncoder(tokenizer, kind, kept)
    for chunk in ("word", "Word", "\u00c9t\u00e9", "Fin.", "a!?", "x,"):
        text = f"b {chunk} c\n{chunk}"
        whole = np.array(tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes()
        if found.encode(text) != whole:
            raise ValueError("this tokenizer does not part words at white space and marks")
    return found


def id_kind(tokenizer_path: str) -> str:
    """The narrowest integers that hold every id."""
    return NARROW if vocabulary_size(tokenizer_path) <= 1 << 16 else WIDE


def token_rows(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = END_ID,
    kind: str = WIDE,
    extra: tuple[str, pa.DataType, Callable] | None = None,
    kept: int = KEPT_CHUNKS,
) -> DataFrame:
    """(doc_id, ids, n_tokens): the ids of each text and then ``end_id``, as integers of one kind.

    The driver reads the tokenizer file and sends its content along, so
    executors need no copy. A null or empty text has the end id alone. ``extra``
    adds a column: its name, type, and a function of the doc_ids (an Arrow
    array) and the ids (a list of bytes). A worker remembers at most twice ``kept``
    chunks, some 200 bytes each; how many changes no id.
    """
    with open(tokenizer_path, "rb") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], kind).tobytes()
    width = len(end)

    def run(batches):
        encode = encoder(definition.value, kind, kept).encode
        for batch in batches:
            for part in small_batches(batch):
                ids = [encode(text.as_py()) + end for text in part.column("text")]
                columns = {
                    "doc_id": part.column("doc_id"),
                    "ids": pa.array(ids, pa.binary()),
                    "n_tokens": pa.array([len(x) // width for x in ids], pa.int64()),
                }
                if extra is not None:
                    columns[extra[0]] = pa.array(extra[2](part.column("doc_id"), ids), extra[1])
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, ids binary, n_tokens long"
    if extra is not None:
        schema += f", {extra[0]} {'int' if extra[1] == pa.int32() else 'long'}"
    return texts(docs).mapInArrow(run, schema)


def vocabulary_size(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)


def document_counts(tokens: DataFrame, size: int, kind: str) -> DataFrame:
    """(token, n): in how many documents each id occurs; one row for each id and task before the sum."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total[np.unique(np.frombuffer(ids.as_buffer(), kind))] += 1
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["token", "n"])

    found = tokens.select("ids").mapInArrow(run, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def collected_counts(counts: DataFrame, size: int) -> np.ndarray:
    """The counts as an array; at most ``size`` rows reach the driver."""
    out = np.zeros(size, np.int64)
    for row in counts.collect():
        out[row["token"]] = row["n"]
    return out

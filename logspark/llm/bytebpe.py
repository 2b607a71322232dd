"""Byte-level BPE from a rank file, by backtracking over longest matches.

An automaton over the vocabulary (bytes as Latin-1 text) finds the longest token
at each place. A piece is then covered from the left: a token may follow another
only if no merge of lower rank would have crossed their border, which is looked
up once per pair. When no token fits, the last one gives way to its longest
prefix. Places found to be dead ends are never tried twice, so the time is
linear in the piece, and the result is that of merging by rank.

Null and empty texts have no ids. Each match of the pattern is encoded alone.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from array import array

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import Memory, read_documents, small_batches, texts

# Pieces and chunks in one generation of a worker's memory; long ones are not kept.
KEPT_PIECES, KEPT_CHUNKS, KEPT_CHARS = 200_000, 100_000, 40
# Pairs of tokens whose compatibility is kept.
KEPT_PAIRS = 500_000


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """token -> rank, from lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """Ranks of the two parts whose merge yields the token; None if merging never does."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        found = [(ranks.get(a + b, own), at) for at, (a, b) in enumerate(itertools.pairwise(parts))]
        rank, at = min(found)
        if rank >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (ranks[parts[0]], ranks[parts[1]]) if all(part in ranks for part in parts) else None


class ByteEncoder:
    def __init__(self, content: bytes, pattern: str):
        self.ranks = ranks = parse_ranks(content)
        if any(bytes([byte]) not in ranks for byte in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.matches = regex.compile(pattern).findall
        self.usual = pattern == public_tokenizers.PATTERN
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.splits: dict[int, tuple[int, int]] = {}
        automaton = ahocorasick.Automaton()
        self.by_text: dict[str, int] = {}
        for token, rank in ranks.items():
            parts = last_merge(token, ranks) if len(token) > 1 else None
            if len(token) == 1 or parts:
                automaton.add_word(token.decode("latin-1"), rank)
                self.by_text[token.decode("latin-1")] = rank
            if parts:
                self.splits[rank] = parts
        automaton.make_automaton()
        self.reach, self.matched = automaton.longest_prefix, automaton.iter_long
        self.most = max(map(len, self.by_text))
        self.lengths = {rank: len(token) for rank, token in self.tokens.items()}
        self.prefixes = {rank: self._prefix(rank) for rank in self.by_text.values()}
        self.cuts = Memory(self._cut, KEPT_PIECES, KEPT_CHARS)
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = Memory(self._piece, KEPT_PIECES, KEPT_CHARS)
        self.chunks = Memory(self._chunk, KEPT_CHUNKS, KEPT_CHARS)

    def _cut(self, text: str) -> int | None:
        """The token that is the longest prefix of a text."""
        look = self.by_text
        for size in range(self.reach(text), 0, -1):
            rank = look.get(text[:size])
            if rank is not None:
                return rank
        return None

    def _prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        return self._cut(self.tokens[token][:-1].decode("latin-1"))

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between the two tokens.

        Both are taken apart again, the later merge first. Whatever stands at the
        border meanwhile must not merge earlier than what was undone; equal ranks
        go to the left one.
        """
        one, two, bound, fits = left, right, len(self.tokens) + 2, True
        while True:
            across = self.ranks.get(self.tokens[one] + self.tokens[two])
            if across is not None and across < bound:
                fits = False
                break
            first, second = self.splits.get(one), self.splits.get(two)
            if first and (one > two or not second):
                bound, one = one, first[1]
            elif second:
                bound, two = two + 1, second[0]
            else:
                break
        if len(self.fits) > KEPT_PAIRS:
            self.fits.clear()
        self.fits[left, right] = fits
        return fits

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return array("I", [whole]).tobytes()
        text, most, lengths, known = raw.decode("latin-1"), self.most, self.lengths, self.fits
        # Longest matches, one after the other; often they fit each other as they are.
        found = [rank for _, rank in self.matched(text)]
        out = found[:1]
        for token in found[1:]:
            fits = known.get((out[-1], token))
            if not (self._fit(out[-1], token) if fits is None else fits):
                break
            out.append(token)
        else:
            return array("I", out).tobytes()
        places = list(itertools.accumulate([lengths[token] for token in found], initial=0))
        longest = dict(zip(places, found))
        at, live, cuts = places[len(out)], bytearray(b"\1") * (len(raw) + 1), self.cuts
        while True:
            end = at + lengths[token]
            if live[end]:
                fits = not out or known.get((out[-1], token))
                if fits is None:
                    fits = self._fit(out[-1], token)
                if fits:
                    out.append(token)
                    at = end
                    if at == len(raw):
                        return array("I", out).tobytes()
                    token = longest.get(at)
                    if token is None:
                        token = cuts[text[at : at + most]]
                    continue
            shorter = self.prefixes[token]
            if shorter is not None:
                token = shorter
                continue
            live[at] = 0
            token = out.pop()
            at -= lengths[token]

    def _chunk(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk) if self.usual else None
        if plain is None:
            return b"".join(map(self.pieces.__getitem__, self.matches(chunk)))
        word, marks = plain.groups()
        return self.pieces[word] + self.pieces[marks] if marks else self.pieces[word]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32.

        Where no white space stands before a space, a match of the usual pattern
        always begins at that space, so chunks between spaces have ids of their own.
        """
        if not text:
            return b""
        if not self.usual or _GAP.search(text):
            ids = b"".join(map(self.pieces.__getitem__, self.matches(text)))
        else:
            first, *rest = text.split(" ")
            look = self.chunks.__getitem__
            ids = look(first) + b"".join([look(" " + chunk) for chunk in rest])
        for memory in (self.pieces, self.chunks, self.cuts):
            memory.age()
        return ids


_GAP = re.compile(r"\s ")
# Letters after at most one space, then marks: two matches of the usual pattern.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


@functools.cache
def _encoder(content: bytes, pattern: str) -> ByteEncoder:
    return ByteEncoder(content, pattern)


@functools.cache
def _vocabulary(content: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in parse_ranks(content).items()}


def _shared(docs: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode_bytes(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids): the ids of each text as little-endian uint32."""
    content = _shared(docs, ranks_path)

    def run(batches):
        encode = _encoder(content.value, pattern).encode
        for batch in batches:
            for part in small_batches(batch):
                ids = [encode(text.as_py()) for text in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
                )

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_bytes(rows: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for; null ids have none."""
    content = _shared(rows, ranks_path)

    def run(batches):
        look = _vocabulary(content.value).__getitem__
        for batch in batches:
            for part in small_batches(batch, "ids"):
                ids = [np.frombuffer(x.as_buffer(), "<u4").tolist() for x in part.column("ids")]
                found = [b"".join(map(look, x)) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), pa.array(found, pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    known = rows.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return known.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = decode_bytes(encode_bytes(read_documents(spark, sf_dir), ranks), ranks)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Removing repeated byte strings by sorting and re-ranking positions.

A byte goes if a string of LENGTH bytes covers it that begins elsewhere too, in
the same document or another. Strings of LENGTH bytes are told apart by prefix
doubling: positions are ranked by their first LENGTH / 2 bytes; those that stand
alone are settled, the others are ranked anew by the pair of ranks at offsets 0
and LENGTH / 2, which reaches the threshold.

Ranking every byte of a large corpus would shuffle it many times over, so the
first round ranks anchors only. The anchor of a string is the position in it
whose first half-length bytes have the least hash, the last one of equals. It
depends on the string's bytes alone, so equal strings have anchors of equal rank
at equal places, and a string whose anchor's rank is unique is unique itself.
Neighbouring strings share anchors; about two of a hundred positions are one.
Where an anchor's rank repeats and the bytes of all its strings are the same as
another's, all of them repeat. Only where they differ, at the ends of repeats, the
second round ranks the single strings.

Ranks are hashes of the bytes (64 bits; two of them, 128 bits, decide that strings
are equal). Null and empty texts have no bytes, texts below LENGTH bytes keep
theirs. Rows that differ in doc_id or text are different documents, told apart by 80 bits of
both; rows with equal doc_id (or none) and equal text are copies of each other and go
whole if they are long enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import read_documents, text_blocks, texts, written
from logspark.llm.hashing import Spans, least_last, mix

LENGTH = 200


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int):
    """Anchors of the strings of a block: rank, hash of all their strings, text, anchor, first and last string.

    Positions count within a text.
    """
    half = length // 2
    if len(raw) < length:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
    spans = Spans(raw)
    at = np.arange(len(raw) - half + 1)
    ranks = spans.hashes(at, at + half)
    places = least_last(ranks, length - half + 1)
    begins = np.arange(len(places))
    texts_of = np.searchsorted(offsets, begins, "right") - 1
    inside = begins + length <= offsets[texts_of + 1]
    begins, places, texts_of = begins[inside], places[inside], texts_of[inside]
    new = np.ones(len(begins), bool)
    new[1:] = (places[1:] != places[:-1]) | (texts_of[1:] != texts_of[:-1])
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(begins)) - 1
    low, high, place, text = begins[starts], begins[stops], places[starts], texts_of[starts]
    context = mix(spans.hashes(low, high + length) + (place - low).astype(np.uint64))
    origin = offsets[text]
    return ranks[place], context, text, place - origin, low - origin, high - origin


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, mark): 80 bits of doc_id and text, that tell documents apart."""
    mark = F.xxhash64(F.lit(1), "doc_id", "text").bitwiseAND(F.lit((1 << 16) - 1))
    return texts(docs).withColumns({"key": F.xxhash64("doc_id", "text"), "mark": mark})


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(rank, context, key, spot): spot packs the mark, the place and where its strings begin."""

    def run(batches):
        for batch in batches:
            for at, raw, offsets in text_blocks(batch.column("text")):
                rank, context, text, place, low, high = anchors(raw, offsets, length)
                rows = pa.array(text + at)
                # One number holds the place and how far its strings begin before it.
                spot = place << 16 | (place - low) << 8 | (place - high)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rank.view(np.int64)),
                        pa.array(context.view(np.int64)),
                        batch.column("key").take(rows),
                        pa.array(spot << 16 | batch.column("mark").take(rows).to_numpy()),
                    ],
                    names=["rank", "context", "key", "spot"],
                )

    return _documents(docs).mapInArrow(run, "rank long, context long, key long, spot long")


def _fields(batch_or_spot) -> list[np.ndarray]:
    """mark, first and last string of packed anchors."""
    spot = batch_or_spot
    mark, near, far, place = spot & 0xFFFF, spot >> 16 & 0xFF, spot >> 24 & 0xFF, spot >> 32
    return [mark, place - far, place - near]


def first_round(rows: DataFrame) -> DataFrame:
    """(key, mark, low, high, open, alone) of anchors whose rank repeats, sorted ranks being compared with their neighbours.

    Closed rows are strings known to repeat, as their context does. Open rows
    are one for each context whose rank has other contexts too; ``alone`` tells
    that the context itself does not repeat. A task streams through its ranks and
    holds one row.
    """

    def run(batches):
        # The last row waits for the next one: whether its context repeats, and whether its rank had another.
        held, repeated, mixed = None, False, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, context, keys, spot = (
                batch.column(name).to_numpy() for name in ("rank", "context", "key", "spot")
            )
            if held is not None:
                rank, context, keys, spot = (
                    np.concatenate([[h], x]) for h, x in zip(held, (rank, context, keys, spot))
                )
            else:
                repeated, mixed = False, False
            same_rank = rank[1:] == rank[:-1]
            same = same_rank & (context[1:] == context[:-1])
            before = np.concatenate([[repeated], same])
            many = before[:-1] | same
            # Contexts are counted along the rows; a rank is mixed where it has met a second one.
            number = np.concatenate([[0], np.cumsum(~same)])
            begin = np.concatenate([[0], np.where(same_rank, 0, np.arange(1, len(rank)))])
            begin = np.maximum.accumulate(begin)
            earlier = (number > number[begin]) | (mixed & (begin == 0))
            open_ = ~same & (earlier[:-1] | same_rank)
            yield from _first_rows(keys, spot, many, open_)
            held = (rank[-1], context[-1], keys[-1], spot[-1])
            repeated, mixed = bool(before[-1]), bool(earlier[-1])
        if held is not None:
            yield from _first_rows(
                np.array([held[2]]), np.array([held[3]]), np.array([repeated]), np.array([mixed])
            )

    def _first_rows(keys, spot, many, open_):
        for picked, alone, is_open in ((many, None, False), (open_, ~many, True)):
            at = np.flatnonzero(picked)
            if len(at):
                mark, low, high = _fields(spot[at])
                alone_of = alone[at] if is_open else np.zeros(len(at), bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[at]),
                        pa.array(mark),
                        pa.array(low.astype(np.int32)),
                        pa.array(high.astype(np.int32)),
                        pa.array(np.full(len(at), is_open)),
                        pa.array(alone_of),
                    ],
                    names=["key", "mark", "low", "high", "open", "alone"],
                )

    laid = rows.repartition("rank").sortWithinPartitions("rank", "context")
    return laid.mapInArrow(run, "key long, mark long, low int, high int, open boolean, alone boolean")


def second_round(docs: DataFrame, open_rows: DataFrame, length: int) -> DataFrame:
    """(key, mark, low, high): strings of open rows, alone in their context, that repeat.

    Only strings of rows that are alone may have to go; the others tell that they exist.
    """
    half = length // 2
    lists = open_rows.groupBy("key", "mark").agg(F.collect_set(F.struct("low", "high", "alone")).alias("lists"))
    pieces = _same_document(_documents(docs), lists)

    def pairs(batches):
        for batch in batches:
            for row, (at, raw, offsets) in _each(batch):
                spans = Spans(raw)
                found = row["lists"]
                counts = np.array([x["high"] - x["low"] + 1 for x in found])
                begins = np.concatenate([np.arange(x["low"], x["high"] + 1) for x in found])
                one = spans.hashes(begins, begins + half)
                two = spans.hashes(begins + half, begins + length)
                alone = np.repeat([x["alone"] for x in found], counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array(np.where(alone, row["key"], 0)),
                        pa.array(np.where(alone, begins << 17 | row["mark"] << 1 | 1, 0)),
                    ],
                    names=["one", "two", "key", "spot"],
                )

    def _each(batch):
        for at, row in enumerate(batch.select(["key", "mark", "lists"]).to_pylist()):
            for block in text_blocks(batch.column("text").slice(at, 1)):
                yield row, block

    def run(batches):
        held, repeated = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two, keys, spot = (batch.column(name).to_numpy() for name in ("one", "two", "key", "spot"))
            if held is not None:
                one, two, keys, spot = (np.concatenate([[h], x]) for h, x in zip(held, (one, two, keys, spot)))
            same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            before = np.concatenate([[repeated], same])
            yield _strings(keys, spot, before[:-1] | same)
            held, repeated = (one[-1], two[-1], keys[-1], spot[-1]), bool(before[-1])
        if held is not None and repeated:
            yield _strings(np.array([held[2]]), np.array([held[3]]), np.array([True]))

    def _strings(keys, spot, many):
        at = np.flatnonzero(many & (spot[: len(many)] & 1 == 1))
        low = (spot[at] >> 17).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[at]), pa.array(spot[at] >> 1 & 0xFFFF), pa.array(low), pa.array(low)],
            names=["key", "mark", "low", "high"],
        )

    ranked = pieces.mapInArrow(pairs, "one long, two long, key long, spot long")
    laid = ranked.repartition("one", "two").sortWithinPartitions("one", "two")
    return laid.mapInArrow(run, "key long, mark long, low int, high int")


def _same_document(documents: DataFrame, others: DataFrame, how: str = "inner") -> DataFrame:
    one, two = documents.alias("d"), others.alias("o")
    same = (F.col("d.key") == F.col("o.key")) & (F.col("d.mark") == F.col("o.mark"))
    names = [name for name in others.columns if name not in documents.columns]
    return one.join(two, same, how).select("d.*", *[f"o.{name}" for name in names])


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, mark, runs): where strings that repeat begin, as first and last places, per document."""
    ranked = written(first_round(anchor_rows(docs, length)), "ranked")
    settled = ranked.where("NOT open").select("key", "mark", "low", "high")
    # Only ranks with an unsettled context need the second round.
    rest = second_round(docs, ranked.where("open").select("key", "mark", "low", "high", "alone"), length)
    every = settled.unionByName(rest)
    return every.groupBy("key", "mark").agg(F.collect_list(F.struct("low", "high")).alias("runs"))


def removed_spans(runs, length: int) -> np.ndarray:
    """Rising, disjoint (begin, end) byte spans that the strings of some runs cover."""
    if not runs:
        return np.zeros((0, 2), np.int64)
    edges = np.array([(run["low"], run["high"] + length) for run in runs], np.int64)
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
    reach = np.maximum.accumulate(edges[:, 1])
    new = np.concatenate([[True], edges[1:, 0] > reach[:-1]])
    return np.column_stack([edges[new, 0], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])])


def without_repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): what stays of every document, as bytes."""
    found = repeated_strings(docs, length)
    marked = _same_document(_documents(docs), found, "left").select("doc_id", "text", "runs")

    def run(batches):
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                raw = text.as_buffer().to_pybytes()
                cuts = removed_spans(runs.as_py(), length)
                begin, parts = 0, []
                for a, b in cuts.tolist():
                    parts.append(raw[begin:a])
                    begin = b
                parts.append(raw[begin:])
                kept.append(b"".join(parts))
                sizes.append(len(raw)), removed.append(len(raw) - len(kept[-1])), spans.append(len(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(kept, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                ],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return marked.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op9_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_bytes(read_documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

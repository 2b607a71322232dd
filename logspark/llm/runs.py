"""Periodic runs of words, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q, of at least max(6, 4 q) words, that
cannot be made longer on either side with that period. Candidates come from a harmonic
grid: for every period p the places 0, p, 2 p, ... are compared with those p further on. A
run of period p holds a grid place from which at least 2 p words (5 for p = 1) equal those p
words on, so a few direct comparisons drop nearly all pairs. How far the rest go on being
equal, to the right and to the left, is answered by longest common extensions (LCE):

* Of the places of a text only those are sampled that are in a difference cover modulo COVER
  (6 of 31 residues): any two places are, at one shift below COVER, both sampled.
* Sampled suffixes alone are sorted: their blocks of COVER words are ranked, and the
  sequences of blocks by prefix doubling. Neighbours' common prefixes are read off the
  doubling ranks and stand in a sparse table.
* An LCE compares words up to the shift at which both places are sampled, and then asks
  the table for the least common prefix between their ranks.

All texts of a block that need it share one structure, with a word of its own after each
text. Of equal stretches the least period counts; by the theorem of Fine and Wilf the others
are its multiples. Words are told apart by 64-bit hashes within a block of texts.

Collapsing keeps a run's first q words. A null or empty text has no words and no runs; a long
text is a block of its own, in memory proportional to it. Repeated rows are answered each.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logspark.llm.common import read_documents, text_blocks, texts
from logspark.llm.hashing import Spans, Words

#: A difference cover modulo 31: any residue is a difference of two of these.
COVER, RESIDUES = 31, (1, 5, 11, 24, 25, 27)
TIMES, LEAST = 4, 6
# Words compared directly before an LCE is asked for, and pairs looked at together.
FEW, PAIRS = 8, 1 << 21


@functools.cache
def _shifts() -> np.ndarray:
    """For two residues, the least shift after which both are in the cover."""
    member = np.isin(np.arange(COVER), RESIDUES)
    step = np.arange(COVER)
    both = member[(step[:, None, None] + step) % COVER] & member[(step[None, :, None] + step) % COVER]
    return both.argmax(axis=2)


def ranks_of(rows: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows of a matrix of non-negative numbers below 2**32."""
    keys = np.ascontiguousarray(rows.astype(">u4")).view(f"V{4 * rows.shape[1]}")[:, 0]
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Extensions:
    """Longest common extensions to the right, of a text that ends in a word of its own."""

    def __init__(self, text: np.ndarray):
        # Words of their own behind the end, so that every block is whole and no comparison leaves it.
        top = int(text.max(initial=0)) + 1
        self.text = text = np.concatenate([text, np.arange(top, top + 2 * COVER)])
        count = len(text) - COVER + 1
        places = [np.arange(residue, count, COVER) for residue in RESIDUES]
        blocks = np.concatenate(places)
        #: The number of each sampled place, in the order of residues.
        self.number = np.zeros(len(text), np.int64)
        self.number[blocks] = np.arange(len(blocks))
        last = np.cumsum([len(each) for each in places]) - 1
        ranks = ranks_of(text[blocks[:, None] + np.arange(COVER)])
        # The last block of each residue holds words of their own, so its suffix differs from all others.
        self.order, levels = self._sorted(ranks, last)
        self.rank = np.empty(len(blocks), np.int64)
        self.rank[self.order] = np.arange(len(blocks))
        self.table = self._table(self._prefixes(blocks, levels))

    @staticmethod
    def _sorted(ranks: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The order of the block sequences, and their ranks by 1, 2, 4, ... blocks."""
        count, levels, step = len(ranks), [ranks], 1
        rest = last[np.searchsorted(last, np.arange(count))] - np.arange(count)
        while levels[-1].max(initial=0) + 1 < count and step <= rest.max(initial=0):
            now = levels[-1]
            after = np.zeros(count, np.int64)
            going = np.flatnonzero(rest >= step)
            after[going] = now[going + step] + 1
            levels.append(np.unique(now * (count + 1) + after, return_inverse=True)[1].astype(np.int64))
            step *= 2
        return np.argsort(levels[-1], kind="stable"), levels

    def _prefixes(self, blocks: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sorted suffix shares with the one before it."""
        one, two = self.order[:-1].copy(), self.order[1:].copy()
        shared = np.zeros(len(one), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            # Sequences differ before either ends, so a step cannot leave its residue.
            same = levels[level][one] == levels[level][two]
            one[same] += 1 << level
            two[same] += 1 << level
            shared[same] += COVER << level
        a, b = blocks[one], blocks[two]
        going = np.ones(len(a), bool)
        for step in range(COVER):
            going &= self.text[a + step] == self.text[b + step]
            shared += going
        return np.concatenate([[0], shared])

    @staticmethod
    def _table(values: np.ndarray) -> list[np.ndarray]:
        table, span = [values], 1
        while 2 * span <= len(values):
            table.append(np.minimum(table[-1][:-span], table[-1][span:]))
            span *= 2
        return table

    def __call__(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many words are equal from each place of ``one`` and of ``two`` on; no pair is a place with itself."""
        shift = _shifts()[one % COVER, two % COVER]
        found = np.full(len(one), -1)
        going = np.arange(len(one))
        for step in range(COVER):
            met = shift[going] == step
            if met.any():
                at = going[met]
                found[at] = step + self._sampled(one[at] + step, two[at] + step)
                going = going[~met]
            if not len(going):
                break
            differ = self.text[one[going] + step] != self.text[two[going] + step]
            found[going[differ]] = step
            going = going[~differ]
        return found

    def _sampled(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        one, two = self.rank[self.number[one]], self.rank[self.number[two]]
        low, high = np.minimum(one, two) + 1, np.maximum(one, two) + 1
        level = np.frexp(high - low)[1] - 1
        found = np.empty(len(low), np.int64)
        for each in np.unique(level).tolist():
            at = np.flatnonzero(level == each)
            row = self.table[each]
            found[at] = np.minimum(row[low[at]], row[high[at] - (1 << each)])
        return found


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the grid pairs of texts of some sizes, at most about PAIRS together."""
    most = np.where(sizes >= LEAST, sizes // TIMES, 0)
    total = int(most.sum())
    ends = np.cumsum(most)
    at = 0
    while at < total:
        # Periods of the texts in a row; a period p has (size - 1) // p pairs.
        stop = min(at + PAIRS, total)
        line = np.arange(at, stop)
        owner = np.searchsorted(ends, line, "right")
        period = line - (ends[owner] - most[owner]) + 1
        pairs = (sizes[owner] - 1) // period
        reach = np.cumsum(pairs)
        begin = 0
        while begin < len(line):
            before = reach[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(reach, before + PAIRS, "right")))
            counts = pairs[begin:end]
            place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            step = np.repeat(period[begin:end], counts)
            yield np.repeat(owner[begin:end], counts), place * step, step
            begin = end
        at = stop


def _candidates(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid pairs whose next few words are equal: text, place in it, period."""
    found = []
    for owner, place, period in _grid(np.diff(first)):
        at = first[owner] + place
        need = np.where(period == 1, LEAST - 1, 2 * period)
        keep = np.flatnonzero(words[at] == words[at + period])
        for step in range(1, FEW):
            at_k, owner_k, period_k = at[keep], owner[keep], period[keep]
            inside = at_k + period_k + step < first[owner_k + 1]
            same = np.zeros(len(keep), bool)
            same[inside] = words[at_k[inside] + step] == words[at_k[inside] + period_k[inside] + step]
            keep = keep[same | (need[keep] <= step)]
        found.append((owner[keep], place[keep], period[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(each) for each in zip(*found))


def runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(text, start, length, period) of every run, by text, start and period.

    ``words`` are numbers below 2**31, text ``k`` has those from ``first[k]`` to ``first[k + 1]``.
    """
    owner, place, period = _candidates(words, first)
    if not len(owner):
        return np.zeros((0, 4), np.int64)
    # The texts that have candidates in a row, each with a word of its own behind it.
    needed, inner = np.unique(owner, return_inverse=True)
    sizes = first[needed + 1] - first[needed]
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    total = int(begins[-1])
    text = np.empty(total, np.int64)
    source = np.arange(total) - np.repeat(begins[:-1] - first[needed], sizes + 1)
    ends = begins[1:] - 1
    plain = np.ones(total, bool)
    plain[ends] = False
    text[plain] = words[source[plain]]
    text[ends] = int(words.max(initial=0)) + 1 + np.arange(len(ends))
    right = Extensions(text)
    # Backwards, a text is read from its end; the word of its own stands before it, that is behind it.
    back = np.concatenate([[int(text.max()) + 1], text[:-1]])[::-1]
    left = Extensions(back)
    out = []
    for cut in range(0, len(owner), PAIRS):
        part = slice(cut, cut + PAIRS)
        at, step = begins[inner[part]] + place[part], period[part]
        forth = right(at, at + step)
        enough = forth >= np.where(step == 1, LEAST - 1, 2 * step)
        at, step, forth, text_of = at[enough], step[enough], forth[enough], inner[part][enough]
        # Place i of a text is place total - 1 - i of the reversed one shifted by one word.
        behind = left(total - 1 - at, total - 1 - at - step)
        start, length = at - behind - begins[text_of], step + forth + behind
        long = length >= np.maximum(LEAST, TIMES * step)
        out.append(np.column_stack([needed[text_of], start, length, step])[long])
    every = np.concatenate(out)
    if not len(every):
        return every
    every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
    # The least period of each stretch.
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :3] != every[:-1, :3]).any(axis=1)
    every = every[new]
    return every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]


def strongest(found: np.ndarray) -> np.ndarray:
    """The row (start, length, period) of the greatest exact length / period; ties by start, then period."""
    best = found[0]
    for row in found[1:]:
        if row[1] * best[2] > best[1] * row[2]:
            best = row
    return best


def dropped(found: np.ndarray, count: int) -> np.ndarray:
    """Which of the words a run holds after its first period."""
    change = np.zeros(count + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def planted(doc_id: int | None, count: int) -> np.ndarray | None:
    """Which original word stands at each place of a document in which a repetition is planted, else nothing."""
    if doc_id is None or not count:
        return None
    crc = zlib.crc32(str(doc_id).encode())
    if crc % 10:
        return None
    group = crc // 10
    at = group % count
    period = 1 + (count - at) // (3 + group % 8)
    order = np.arange(count)
    order[at:] = at + np.arange(count - at) % period
    return order


#: The columns of a document's runs.
RUNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def document_runs(docs: DataFrame, edit=None) -> DataFrame:
    """(doc_id, runs, kept): the runs of each text as structs, and its words without their repetitions, in one text.

    ``edit`` may say for a doc_id and a number of words which of them stands at each place.
    """

    def run(batches):
        for batch in batches:
            for at, raw, offsets in text_blocks(batch.column("text")):
                words = Words(raw, offsets)
                numbers = np.unique(words.hashes(Spans(raw)), return_inverse=True)[1].astype(np.int64)
                first = words.first
                ids = batch.column("doc_id").slice(at, len(offsets) - 1).to_pylist()
                orders = {}
                for text, count in enumerate(words.counts.tolist()):
                    order = edit(ids[text], count) if edit else None
                    if order is not None:
                        orders[text] = order
                        span = slice(first[text], first[text + 1])
                        numbers[span] = numbers[span][order]
                found = runs(numbers, first)
                ends = np.searchsorted(found[:, 0], np.arange(len(ids) + 1))
                data, kept = raw.tobytes(), []
                for text in range(len(ids)):
                    spelled = data[offsets[text] : offsets[text + 1]].split()
                    if text in orders:
                        spelled = [spelled[place] for place in orders[text].tolist()]
                    own = found[ends[text] : ends[text + 1], 1:]
                    if len(own):
                        gone = dropped(own, len(spelled)).tolist()
                        spelled = [word for word, out in zip(spelled, gone) if not out]
                    kept.append(b" ".join(spelled).decode())
                rows = pa.StructArray.from_arrays(
                    [pa.array(found[:, column]) for column in (1, 2, 3)], names=["start", "length", "period"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows),
                        pa.array(kept, pa.string()),
                    ],
                    names=["doc_id", "runs", "kept"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, kept string")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, ...): number of runs, the strongest, and hashes of all runs and of the collapsed words."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, own, kept in zip(*(batch.column(name) for name in ("doc_id", "runs", "kept"))):
                rows = np.array([list(row.values()) for row in own.as_py()], np.int64).reshape(-1, 3)
                best = [None] * 4
                if len(rows):
                    start, length, period = strongest(rows.astype(object))
                    best = [start, length, period, 1000 * length // period]
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in rows.tolist()).encode()
                text = kept.as_buffer()
                out.append(
                    (doc_id.as_py(), len(rows), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(text).hexdigest())
                )
            schema = [("doc_id", pa.int64()), ("n_runs", pa.int64())]
            schema += [(name, pa.int64()) for name in ("start", "length", "period", "exponent_milli")]
            schema += [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, (_, kind) in zip(columns, schema)], names=[name for name, _ in schema]
            )

    return found.mapInArrow(run, f"doc_id long, {RUNS}")


def op12_difference_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(document_runs(read_documents(spark, sf_dir), planted))

"""Words and their 64-bit hashes, for a block of texts at once.

A hash is a polynomial in a fixed odd base over random byte values, taken from
prefix sums modulo 2**64 and then mixed, so that no step is done per word.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
_ONE = np.uint64(1)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


_powers: dict[int, np.ndarray] = {}
# Powers kept by a worker for each base; those of a longer text are made for it alone.
_KEPT_POWERS = 1 << 20


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base**0 .. base**(count-1), kept for the next block."""
    known = _powers.get(int(base))
    if known is None or len(known) < count:
        size = 1 << max(count - 1, 1).bit_length()
        known = np.full(size if size <= _KEPT_POWERS else count, base, np.uint64)
        known[0] = _ONE
        np.multiply.accumulate(known, out=known)
        if len(known) <= _KEPT_POWERS:
            _powers[int(base)] = known
    return known[:count]


class Spans:
    """Hashes of any byte spans of a block."""

    def __init__(self, raw: np.ndarray):
        self.inverse = powers(_INVERSE, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_byte_values()[raw] * powers(_BASE, len(raw)), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(value + (ends - starts).astype(np.uint64) * _WORD_BASE)


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of a sequence of 64-bit values, which should be random themselves."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(_INVERSE, len(values) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _WORD_BASE)


_KIND = np.zeros(256, bool)
_KIND[[9, 10, 11, 12, 13, 32]] = True


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    upper = (raw >= 65) & (raw <= 90)
    return raw + upper.astype(np.uint8) * np.uint8(32)


class Words:
    """The words of a block: maximal runs of bytes other than space and 9 to 13.

    ``first`` holds, per text, the place of its first word, and one more entry
    for the end.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        self.inside = ~_KIND[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        begins, closes = self.inside.copy(), self.inside.copy()
        if len(raw):
            begins[1:] &= ~self.inside[:-1] | edge[1:-1]
            closes[:-1] &= ~self.inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, spans: Spans) -> np.ndarray:
        return spans.hashes(self.starts, self.ends)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` neighbouring words of the block."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    total = words[: len(words) - width + 1].copy()
    for step in range(1, width):
        total *= _WORD_BASE
        total += words[step : len(words) - width + 1 + step]
    return mix(total + np.uint64(width))


def windows(hashes: np.ndarray, words: Words, width: int, whole: bool = True):
    """Hashes and texts of the word windows that stay inside a text.

    A text with fewer words than ``width``, but some, has its whole sequence as
    its only window if ``whole``. Also returned: the place of the first word.
    """
    owners = words.owners()
    every = window_hashes(hashes, width)
    inside = np.flatnonzero(owners[: len(every)] == owners[width - 1 :][: len(every)])
    values, texts, places = every[inside], owners[inside], inside
    if whole:
        short = np.flatnonzero((words.counts > 0) & (words.counts < width))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            length = words.counts[short]
            for step in range(width - 1):
                at = np.minimum(words.first[short] + step, len(hashes) - 1)
                extra = np.where(step < length, extra * _WORD_BASE + hashes[at], extra)
            values = np.concatenate([values, mix(extra + length.astype(np.uint64))])
            texts = np.concatenate([texts, short])
            places = np.concatenate([places, words.first[short]])
    return values, texts, places


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int):
    """The distinct shingles of each text of a block: hashes rising within a text, and where texts begin."""
    raw = lower_ascii(raw)
    words = Words(raw, offsets)
    values, owners, _ = windows(words.hashes(Spans(raw)), words, width)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(offsets)))


def least_last(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value among each run of ``width``, the last of equals."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    place, span = np.arange(len(values)), 1
    least = values
    while 2 * span <= width:
        right = least[span:] <= least[:-span]
        place = np.where(right, place[span:], place[:-span])
        least = np.where(right, least[span:], least[:-span])
        span *= 2
    shift = width - span
    right = least[shift:][:count] <= least[:count]
    return np.where(right, place[shift:][:count], place[:count])

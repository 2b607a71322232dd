import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from logspark.llm import runs as rn
from tests.llm.samples import no_documents, odd_documents, plain_rows, words


def smallest_period(part):
    return next(p for p in range(1, len(part) + 1) if all(part[i] == part[i + p] for i in range(len(part) - p)))


def plain_runs(text):
    """(start, length, period) by extending every stretch of equal words p apart."""
    found, n = set(), len(text)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and text[j] == text[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p) and smallest_period(text[i : i + length][: 3 * p]) == p:
                found.add((i, length, p))
            i = j + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def plain_row(doc_id, text, edit=True):
    spelled = words(text)
    n, crc = len(spelled), zlib.crc32(str(doc_id).encode())
    if edit and doc_id is not None and crc % 10 == 0 and n:
        g = crc // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        spelled = spelled[:a] + [spelled[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(spelled)
    best = [None] * 4
    if found:
        s, length, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = [s, length, q, 1000 * length // q]
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(spelled) if i not in gone)
    return (str(doc_id), len(found), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def got(frame):
    names = "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    return sorted(((str(r["doc_id"]), *(r[name] for name in names)) for r in frame.collect()), key=str)


def texts_of_numbers(seed, count):
    rng = random.Random(seed)
    out = [[], [1], [1] * 6, [1] * 5, [1, 2] * 4, [1, 2] * 3 + [1], [1] * 300, [1, 1, 2] * 40, [1, 2, 1, 2, 3] * 9]
    for _ in range(count):
        text = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            part = [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randint(1, 45))]
            text += part * rng.randint(1, 9) + part[: rng.randrange(len(part))]
            text += [rng.randrange(3) for _ in range(rng.randrange(5))]
        out.append(text)
    return out


def test_the_cover_meets_every_pair():
    shifts = rn._shifts()
    for one in range(rn.COVER):
        for two in range(rn.COVER):
            step = shifts[one, two]
            assert (one + step) % rn.COVER in rn.RESIDUES and (two + step) % rn.COVER in rn.RESIDUES


@pytest.mark.parametrize("kinds", [1, 2, 4])
def test_extensions(kinds):
    rng = np.random.default_rng(kinds)
    text = np.concatenate([rng.integers(0, kinds, 700), np.tile(rng.integers(0, kinds, 37), 20), [kinds]])
    ask = rn.Extensions(text)
    one, two = rng.integers(0, len(text), (2, 4000))
    one, two = one[one != two], two[one != two]
    for a, b, found in zip(one.tolist(), two.tolist(), ask(one, two).tolist()):
        plain = 0
        while max(a, b) + plain < len(text) and text[a + plain] == text[b + plain]:
            plain += 1
        assert found == plain


@pytest.mark.parametrize("pairs", [1 << 21, 50])
def test_runs_agree_with_plain_ones(monkeypatch, pairs):
    monkeypatch.setattr(rn, "PAIRS", pairs)
    texts = texts_of_numbers(pairs, 150)
    first = np.concatenate([[0], np.cumsum([len(text) for text in texts])])
    found = rn.runs(np.array([x for text in texts for x in text], np.int64), first)
    for at, text in enumerate(texts):
        assert [tuple(row) for row in found[found[:, 0] == at, 1:].tolist()] == plain_runs(text)


def test_no_words():
    assert len(rn.runs(np.zeros(0, np.int64), np.zeros(1, np.int64))) == 0
    assert len(rn.runs(np.zeros(0, np.int64), np.zeros(4, np.int64))) == 0


def test_long_periods_and_long_runs():
    part = list(range(4000))
    text = np.array([7] + part * 4 + [9] + [5] * 20_000 + part[:10])
    assert rn.runs(text, np.array([0, len(text)])).tolist() == [[0, 1, 16000, 4000], [0, 16002, 20_000, 1]]


def test_odd_documents(spark):
    docs = odd_documents(spark)
    for edit in (None, rn.planted):
        found = rn.digests(rn.document_runs(docs, edit))
        rows = [(doc_id, text) for doc_id, text in plain_rows(docs) if len(text) < 100_000]
        long = {str(doc_id) for doc_id, text in plain_rows(docs) if len(text) >= 100_000}
        assert [row for row in got(found) if row[0] not in long] == sorted(
            (plain_row(doc_id, text, edit is not None) for doc_id, text in rows), key=str
        )
        assert found.count() == docs.count()
    assert rn.digests(rn.document_runs(no_documents(spark))).count() == 0


def test_op12(spark, sf_dir):
    rows = plain_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = got(rn.op12_difference_cover_runs(spark, sf_dir))
    assert found == sorted((plain_row(*row) for row in rows), key=str)
    assert sum(row[1] > 0 for row in found) > 5

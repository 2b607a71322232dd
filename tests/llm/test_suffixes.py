import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logspark.llm import suffixes
from logspark.llm.common import text_blocks
from tests.llm.samples import no_documents, odd_documents, plain_rows, prose


def plain_cuts(rows, length):
    times = Counter()
    for _, text in rows:
        raw = text.encode()
        times.update(raw[at : at + length] for at in range(len(raw) - length + 1))
    out = []
    for doc_id, text in rows:
        raw, gone = text.encode(), np.zeros(len(text.encode()) + 1, bool)
        for at in range(len(raw) - length + 1):
            if times[raw[at : at + length]] > 1:
                gone[at : at + length] = True
        gone = gone[:-1]
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((str(doc_id), len(raw), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted(
        (str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest())
        for r in frame.collect()
    )


def test_anchors_cover_every_string_once():
    rng = random.Random(1)
    texts = [prose(rng, 60), "", "short", "a" * 300, "ab" * 150, prose(rng, 90), "x" * 40]
    for _, raw, offsets in text_blocks(pa.array(texts)):
        for length in (20, 40):
            rank, context, text, place, low, high = suffixes.anchors(raw, offsets, length)
            for at, whole in enumerate(texts):
                size = len(whole.encode())
                strings = [s for a, b in zip(low[text == at], high[text == at]) for s in range(a, b + 1)]
                assert sorted(strings) == list(range(max(0, size - length + 1)))
            assert ((place >= high) & (place <= low + length // 2)).all()


def test_equal_strings_share_their_anchor():
    rng = random.Random(2)
    passage = prose(rng, 30)
    texts = [prose(rng, 40) + passage + prose(rng, 40) for _ in range(4)]
    ((_, raw, offsets),) = text_blocks(pa.array(texts))
    rank, context, text, place, low, high = suffixes.anchors(raw, offsets, 40)
    size = len(passage.encode())
    for shift in range(size - 39):
        found = set()
        for at, whole in enumerate(texts):
            begin = whole.encode().find(passage.encode()) + shift
            pick = (text == at) & (low <= begin) & (high >= begin)
            found.add((int(rank[pick][0]), int(place[pick][0]) - begin))
        assert len(found) == 1


@pytest.mark.parametrize("length", [8, 30])
def test_repeats_of_many_kinds(spark, length):
    rng = random.Random(length)
    base = prose(rng, 120)
    cut = lambda: base[(a := rng.randrange(len(base) - 60)) : a + rng.randrange(5, 60)]
    texts = [base, base, "a" * 200, "ab" * 80, "abc" * 30 + "x" + "abc" * 30, "", "tiny"]
    texts += [prose(rng, 10) + cut() + prose(rng, 10) + cut() for _ in range(25)]
    texts += [cut() for _ in range(10)] + [base[:50] + "!" + base[51:], "é" * 60, "aé" * 40]
    docs = odd_documents(spark, texts)
    assert got(suffixes.without_repeated_bytes(docs, length)) == plain_cuts(plain_rows(docs), length)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert got(suffixes.without_repeated_bytes(docs)) == plain_cuts(plain_rows(docs), suffixes.LENGTH)
    assert suffixes.without_repeated_bytes(no_documents(spark)).count() == 0


def test_spans_join():
    runs = [{"low": 5, "high": 7}, {"low": 0, "high": 0}, {"low": 17, "high": 17}, {"low": 40, "high": 41}]
    assert suffixes.removed_spans(runs, 10).tolist() == [[0, 27], [40, 51]]
    assert suffixes.removed_spans(None, 10).shape == (0, 2)


def test_op9(spark, sf_dir):
    rows = plain_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = suffixes.op9_prefix_doubling(spark, sf_dir).collect()
    mine = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found)
    assert mine == plain_cuts(rows, 200)


def test_thousands_of_rows_without_doc_id(spark):
    """A shared passage, among unique texts; places and lengths are alike everywhere."""
    rng = random.Random(3)
    passage = prose(rng, 60)[:250]
    unique = lambda: "".join(rng.choice("abcdefghij ") for _ in range(300))
    for doc_id in (None, 7):
        rows = [(doc_id, (passage if at % 5 == 0 else unique()[:250]) + unique()) for at in range(3000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(suffixes.without_repeated_bytes(docs)) == plain_cuts(rows, suffixes.LENGTH)

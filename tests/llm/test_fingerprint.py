import hashlib
import random

import numpy as np
import pyarrow as pa

from logspark.llm import fingerprint as fp
from tests.llm.samples import no_documents, odd_documents, odd_texts, plain_rows, prose, shingles


def sketch(text, size=fp.SKETCH_SIZE):
    return fp.sketches(pa.array([text]), size=size)[0]


def test_small_sets_are_exact():
    texts = [text or "" for text in odd_texts() if len(text or "") < 500]
    marks = [sketch(text) for text in texts]
    for text, mark in zip(texts, marks):
        assert fp.distinct_count(mark) == len(shingles(text))
        assert np.array_equal(fp.from_text(fp.to_text(mark)), mark)
        for other, two in zip(texts, marks):
            one_set, two_set = shingles(text), shingles(other)
            if len(one_set | two_set) <= fp.SKETCH_SIZE:
                expected = len(one_set & two_set) / len(one_set | two_set) if one_set | two_set else 1.0
                assert abs(fp.resemblance(mark, two) - expected) < 1e-12


def test_sketches_of_parts_merge():
    rng = random.Random(2)
    one, two = prose(rng, 900), prose(rng, 700)
    parts = fp.sketches(pa.array([one, two]))
    both = np.union1d(fp.sketches(pa.array([one]), size=10**6)[0], fp.sketches(pa.array([two]), size=10**6)[0])
    assert np.array_equal(fp.merge(*parts), both[: fp.SKETCH_SIZE])


def test_estimates_are_near():
    rng = random.Random(4)
    for share in (0.2, 0.5, 0.9):
        words = prose(rng, 4000).split(" ")
        other = words[: int(share * 4000)] + prose(rng, 4000 - int(share * 4000)).split(" ")
        one, two = " ".join(words), " ".join(other)
        a, b = shingles(one), shingles(two)
        x, y = sketch(one, 1024), sketch(two, 1024)
        assert abs(fp.resemblance(x, y, 1024) - len(a & b) / len(a | b)) < 0.06
        assert abs(fp.containment(x, y, 1024) - len(a & b) / len(a)) < 0.1
        assert abs(fp.distinct_count(x, 1024) / len(a) - 1) < 0.12


def test_fingerprints_of_odd_documents(spark):
    docs = odd_documents(spark)
    found = fp.fingerprints(docs).collect()
    assert sorted(str(row["doc_id"]) for row in found) == sorted(str(doc_id) for doc_id, _ in plain_rows(docs))
    by_text = {}
    for row in found:
        assert by_text.setdefault(row["text"], row["fingerprint"]) == row["fingerprint"]
        assert row["fingerprint"] == fp.to_text(sketch(row["text"]))


def check_report(found, rows):
    rows = sorted(rows, key=lambda row: (-1 if row[0] is None else row[0], row[1]))
    expected = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        changed = text[: len(text) - cut] + following[:cut]
        one, two, three = sketch(text), sketch(changed), sketch(following)
        expected.append(
            (str(doc_id), len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.to_text(one), fp.to_text(two),
             round(fp.resemblance(one, two), 9), round(fp.resemblance(one, three), 9))
        )
    got = [
        (str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
         round(r["near_edited"], 9), round(r["near_next"], 9))
        for r in found
    ]
    assert sorted(got) == sorted(expected)


def test_edits_of_odd_documents(spark):
    docs = odd_documents(spark)
    check_report(fp.edit_report(docs).collect(), plain_rows(docs))
    alone = odd_documents(spark, ["a single document with words"])
    check_report(fp.edit_report(alone).collect(), plain_rows(alone))
    assert fp.edit_report(no_documents(spark)).count() == 0


def test_op6(spark, sf_dir):
    rows = plain_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    check_report(fp.op6_bottom_k(spark, sf_dir).collect(), rows)

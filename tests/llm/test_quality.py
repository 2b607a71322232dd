import math
from collections import Counter

import numpy as np
import pyarrow as pa

from logspark.llm import quality
from logspark.llm.common import text_blocks
from tests.llm.samples import no_documents, odd_documents, odd_texts, plain_rows, words


def plain_measures(text):
    found = words(text)
    windows = [tuple(found[at : at + 3]) for at in range(len(found) - 2)]
    times = Counter(windows)
    covered = {at + step for at, window in enumerate(windows) if times[window] > 1 for step in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    return (
        len(found), sum(map(len, found)), sum(text.count(mark) for mark in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered),
    )


def columns(row):
    return tuple(row[name] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


TEXTS = [text or "" for text in odd_texts() if len(text or "") < 20_000] + [
    "a\nb\na\n\n \n \nb\na", "x\r\nx\nx", "a b c a b c", "a b c\nd\na b c", "#*$%&|<> <<>> é|ü", "\n", "a\n", "\na\na",
    "a b a b a b a", "line \nline\nline ",
]


def test_measures():
    ratios = np.zeros(quality.BUCKETS)
    got = []
    for _, raw, offsets in text_blocks(pa.array(TEXTS)):
        got += list(zip(*(column.tolist() for column in quality.measures(raw, offsets, ratios)[:5])))
    assert got == [plain_measures(text) for text in TEXTS]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, good string")


def test_odd_documents(spark):
    docs = odd_documents(spark)
    known = labels(spark, [(6, 1, 0, None), (15, 0, 0, None), (7, None, None, None), (None, 1, 0, None), (6, 1, 1, None)])
    found = quality.judge(docs, known).collect()
    rows = plain_rows(docs)
    assert sorted(map(str, (columns(row) for row in found))) == sorted(str(plain_measures(text)) for _, text in rows)
    for row in found:
        assert row["base_failed"] == (row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"])
        assert not (row["base_failed"] and row["kept"])
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert sorted(str(row["doc_id"]) for row in kept.collect()) == sorted(str(row["doc_id"]) for row in found if row["kept"])
    assert quality.judge(no_documents(spark), known).count() == 0
    alone = quality.judge(docs, labels(spark, [])).collect()
    assert all(row["kept"] == (not row["base_failed"]) for row in alone)


def test_ratios_are_those_of_the_counts(spark):
    docs = odd_documents(spark, ["a b c d", "a b", "x y", ""])
    rows = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id < 2 THEN doc_id END AS half")
    ratios = quality.log_ratios(quality.gram_counts(rows, "half", 64), 64)
    corpus, targets = np.ones(64), np.ones((3, 64))
    for doc_id, text in enumerate(["a b c d", "a b", "x y", ""]):
        for _, raw, offsets in text_blocks(pa.array([text])):
            block = quality.Words(raw, offsets)
            found, _ = quality.ngrams(block.hashes(quality.Spans(raw)), block, 64)
            assert len(found) == max(0, 2 * len(words(text)) - 1)
            corpus += np.bincount(found, minlength=64)
            if doc_id < 2:
                targets[0] += np.bincount(found, minlength=64)
                targets[2 - doc_id] += np.bincount(found, minlength=64)
    # of all trusted documents, without the first half, without the second
    for ratio, target in zip(ratios, (targets[0], targets[1], targets[2])):
        expected = [math.log(t / target.sum()) - math.log(c / corpus.sum()) for t, c in zip(target, corpus)]
        assert np.allclose(ratio, expected)


def test_verdicts_on_held_out_labels(spark):
    """Fitted on half of the labels, the verdict follows the other half."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.judge(docs, known.where("doc_id % 2 = 0"))
    rows = found.join(known.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    right = [row["kept"] == (row["quality"] == 1) for row in rows]
    good = [row["kept"] for row in rows if row["quality"] == 1]
    assert len(rows) > 100 and np.mean(right) > 0.95 and np.mean(good) > 0.95


def test_op7(spark, sf_dir):
    docs = dict(plain_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    found = quality.op7_quality(spark, sf_dir).collect()
    assert {row["doc_id"]: columns(row) for row in found} == {key: plain_measures(text) for key, text in docs.items()}
    assert len(found) == len(docs)


def test_target_counts_all_trusted_documents(spark, sf_dir):
    """The bound on labelled rows holds for the threshold alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert known.count() > 20
    assert np.allclose(quality.fit(docs, known, most=20).ratios, quality.fit(docs, known).ratios)


def test_cells_grow_with_the_words(spark):
    docs = odd_documents(spark, TEXTS)
    assert quality.count_words(docs) == sum(len(words(text)) for text in TEXTS)
    assert quality.count_words(no_documents(spark)) == 0
    sizes = [quality.buckets_for(10**power) for power in range(12)]
    assert sizes == sorted(sizes) and sizes[0] == quality.BUCKETS < sizes[8] < sizes[10]
    assert all(size >= 4 * 10 ** (power / 2) for power, size in enumerate(sizes))


def test_toxic_documents_do_not_hold_the_threshold_down(spark):
    rng = np.random.default_rng(3)
    text = lambda kind: " ".join(f"{kind}{at}" for at in rng.integers(0, 200, 80))
    kinds = ["good"] * 60 + ["other"] * 40
    docs = spark.createDataFrame([(at, text(kind)) for at, kind in enumerate(kinds)], "doc_id long, text string")
    # Trusted ones, then toxic ones of quality 1 in the words of those of quality 0.
    known = labels(spark, [(at, int(at < 80), int(60 <= at < 80), None) for at in range(100)])
    kept = {row["doc_id"] for row in quality.judge(docs, known).where("kept").collect()}
    assert kept == set(range(60))


def test_all_labelled_documents_place_the_threshold(spark, sf_dir):
    """How the labelled side is joined changes nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    whole = quality.fit(docs, known).threshold
    assert np.isfinite(whole)
    assert [quality.fit(docs, known, most=most).threshold for most in (0, 20, 40, 80)] == [whole] * 4


def more_labels_than_broadcast(spark):
    """60 trusted documents, one of quality 0, 20 unlabelled ones like the latter, a null doc_id; most labels are of documents not here."""
    rng = np.random.default_rng(4)
    text = lambda kind: " ".join(f"{kind}{at}" for at in rng.integers(0, 200, 80))
    docs = [(at, text("good")) for at in range(60)] + [(at, text("other")) for at in range(60, 81)] + [(None, text("other"))]
    absent = spark.range(1000, 1000 + 5 * quality.MAX_BROADCAST).selectExpr(
        "id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic", "CAST(NULL AS STRING) AS good"
    )
    known = labels(spark, [(at, int(at < 60), 0, None) for at in range(61)])
    return spark.createDataFrame(docs, "doc_id long, text string"), known.unionByName(absent)


def test_a_single_label_counts_among_many(spark):
    docs, known = more_labels_than_broadcast(spark)
    found = quality.judge(docs, known).collect()
    assert len(found) == docs.count()
    assert {row["doc_id"] for row in found if row["kept"]} == set(range(60))

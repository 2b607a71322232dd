"""Quality rules: counts per document, and a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hashed word unigrams and bigrams: one
counted over trusted documents, one over the whole corpus. A document's score is
the mean log ratio of its n-grams. It is kept when the score reaches a threshold
fitted once on all labelled documents; every document meets the same threshold.

Null and empty texts have no words, fail the base rules and are not kept. Words
are maximal runs of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import read_documents, text_blocks, texts
from logspark.llm.hashing import Spans, Words, mix, window_hashes

# Cells of the multinomials: the least power of two of at least CELLS_A_ROOT for each
# square root of the corpus's words, and of BUCKETS. Distinct n-grams grow about so.
BUCKETS = 1 << 14
CELLS_A_ROOT = 4
MIN_WORDS = 50
REPEAT_WINDOW = 3
# Labelled documents that are broadcast, at most; more are joined as any table.
MAX_BROADCAST = 200_000
# Share of trusted labelled documents that the threshold must keep.
KEEP_SHARE = 0.99
# Cells of the score histogram the threshold is read from, and its range.
_CELLS, _REACH = 4096, 8.0

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _spread(values: np.ndarray, buckets: int) -> np.ndarray:
    return (values & np.uint64(buckets - 1)).astype(np.int64)


def ngrams(hashes: np.ndarray, words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and texts of all unigrams and bigrams of a block."""
    owners = words.owners()
    pairs = window_hashes(hashes, 2)
    inside = np.flatnonzero(owners[: len(pairs)] == owners[1:][: len(pairs)])
    return (
        np.concatenate([_spread(hashes, buckets), _spread(pairs[inside], buckets)]),
        np.concatenate([owners, owners[inside]]),
    )


def _sums(weights: np.ndarray, owners: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(owners, weights, rows)


def _twice(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: whether its value occurs twice in its text, and whether it is not the first."""
    key = mix(values ^ mix(owners.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    repeated = np.zeros(len(key), bool)
    repeated[order] = both
    return repeated, again


def _duplicate_lines(raw, offsets, spans, words) -> np.ndarray:
    breaks = np.flatnonzero(raw == 10)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw))
    # A line ends before its line feed; one that ends a text has none.
    ends = ends - ((ends > starts) & (raw[ends - 1] == 10)) if len(starts) else ends
    holds = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[holds], ends[holds]
    owners = np.searchsorted(offsets, starts, "right") - 1
    _, again = _twice(spans.hashes(starts, ends), owners)
    return np.bincount(owners[again], minlength=len(offsets) - 1)


def measures(raw: np.ndarray, offsets: np.ndarray, ratios: np.ndarray) -> list[np.ndarray]:
    """Per text of a block: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score."""
    rows = len(offsets) - 1
    words, spans = Words(raw, offsets), Spans(raw)
    hashes = words.hashes(spans)

    def per_text(mask):
        running = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask, out=running[1:])
        return np.diff(running[offsets])

    letters = per_text(words.inside & ((raw & 0xC0) != 0x80))
    owners = words.owners()
    runs = window_hashes(hashes, REPEAT_WINDOW)
    inside = np.flatnonzero(owners[: len(runs)] == owners[REPEAT_WINDOW - 1 :][: len(runs)])
    repeated, _ = _twice(runs[inside], owners[inside])
    covered = np.zeros(len(hashes), bool)
    for step in range(REPEAT_WINDOW):
        covered[inside[repeated] + step] = True
    buckets, grams_of = ngrams(hashes, words, len(ratios))
    total = np.bincount(grams_of, minlength=rows)
    score = _sums(ratios[buckets], grams_of, rows) / np.maximum(total, 1)
    return [
        words.counts.astype(np.int64),
        letters,
        per_text(_SYMBOLS[raw]),
        _duplicate_lines(raw, offsets, spans, words),
        np.bincount(owners[covered], minlength=rows),
        score,
    ]


def count_words(docs: DataFrame) -> int:
    def run(batches):
        found = 0
        for batch in batches:
            found += sum(int(Words(raw, offsets).counts.sum()) for _, raw, offsets in text_blocks(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], names=["words"])

    return texts(docs).select("text").mapInArrow(run, "words long").agg(F.sum("words")).first()[0] or 0


def buckets_for(n_words: int) -> int:
    return max(BUCKETS, 1 << math.ceil(math.log2(max(CELLS_A_ROOT * math.sqrt(n_words), 1))))


def gram_counts(docs: DataFrame, half: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, corpus, target_0, target_1): n-gram counts of all documents, and of the trusted ones of either half.

    The column ``half`` is 0 or 1 for trusted documents. Each task sends one row
    for each bucket it has met.
    """

    def run(batches):
        counts = np.zeros((3, buckets), np.int64)
        for batch in batches:
            half_of = batch.column("half").to_numpy()
            for first, raw, offsets in text_blocks(batch.column("text")):
                words = Words(raw, offsets)
                found, owners = ngrams(words.hashes(Spans(raw)), words, buckets)
                halves = half_of[first + owners]
                counts[2] += np.bincount(found, minlength=buckets)
                for at in (0, 1):
                    counts[at] += np.bincount(found[halves == at], minlength=buckets)
        met = np.flatnonzero(counts[2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), *[pa.array(counts[at][met]) for at in (2, 0, 1)]],
            names=["bucket", "corpus", "target_0", "target_1"],
        )

    rows = docs.select(
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col(half).cast("int"), F.lit(-1)).alias("half"),
    )
    found = rows.mapInArrow(run, "bucket long, corpus long, target_0 long, target_1 long")
    names = ("corpus", "target_0", "target_1")
    return found.groupBy("bucket").agg(*[F.sum(name).alias(name) for name in names])


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> list[np.ndarray]:
    """log(target share / corpus share) for each bucket, one added to every count.

    Three of them: of all trusted documents, and without those of either half. The
    table that reaches the driver has at most ``buckets`` rows. Without target
    documents every ratio is 0.
    """
    corpus, targets = np.ones(buckets), np.zeros((2, buckets))
    table = counts.toArrow()
    at = table.column("bucket").to_numpy()
    corpus[at] += table.column("corpus").to_numpy()
    for half in (0, 1):
        targets[half, at] = table.column(f"target_{half}").to_numpy()

    def ratio(target):
        if not target.sum():
            return np.zeros(buckets)
        return np.log((target + 1) / (target.sum() + buckets)) - np.log(corpus / corpus.sum())

    return [ratio(targets.sum(axis=0)), ratio(targets[1]), ratio(targets[0])]


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    threshold: float


def half_of(doc_id: str):
    """0 or 1, by a hash of a long column."""
    return F.pmod(F.xxhash64(doc_id), F.lit(2)).cast("int")


def labelled_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, trusted_half): labelled documents, trusted when of quality 1 and not toxic.

    A document labelled more than once is trusted if all its labels are, and of the
    greatest quality of them. ``trusted_half`` is the half of trusted ones, else null.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    judged = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.bool_and(good).alias("good"), F.max("quality").alias("quality")
    )
    return judged.select("doc_id", "quality", F.when(F.col("good"), half_of("doc_id")).alias("trusted_half"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int | None = None, most: int = MAX_BROADCAST) -> Model:
    """Count both multinomials over all documents and place the threshold.

    All trusted documents are counted, and all labelled ones place the threshold. The
    labelled side is broadcast up to ``most`` documents and joined as any table above,
    which changes no result: above, every document is scored and only the scores are
    joined, so that texts are shuffled once, for the counts. Labelled documents are
    scored without the trusted ones of their own half, so that they stand as any other
    document. The threshold is the cell border of a score histogram that parts trusted
    documents from those of quality 0 with the fewest errors, each class weighing the
    same, among those that keep KEEP_SHARE of the former; of equal borders the middle
    one. Toxic documents of quality 1 belong to neither class. Without both classes it
    is minus infinity, and the base rules decide alone.
    """
    if buckets is None:
        buckets = buckets_for(count_words(docs))
    known, whole = labelled_ids(labels), texts(docs)
    few = known.count() <= most
    if few:
        known = F.broadcast(known)
    rows = whole.join(known, "doc_id", "left")
    ratios, *others = log_ratios(gram_counts(rows, "trusted_half", buckets), buckets)
    if few:
        whole = whole.join(known, "doc_id")
    extra = ["quality", "trusted_half"] if few else []
    halves = [score(whole.where(half_of("doc_id") == half), Model(other, 0.0), extra) for half, other in enumerate(others)]
    scored = halves[0].unionByName(halves[1])
    if not few:
        scored = scored.join(known, "doc_id")
    scored = scored.where("NOT base_failed AND (trusted_half IS NOT NULL OR quality = 0)")
    cell = F.least(F.greatest(F.floor((F.col("score") + _REACH) * (_CELLS / (2 * _REACH))), F.lit(0)), F.lit(_CELLS - 1))
    table = scored.groupBy("quality", cell.alias("cell")).count().collect()
    good, bad = np.zeros(_CELLS + 1), np.zeros(_CELLS + 1)
    for row in table:
        (good if row["quality"] == 1 else bad)[row["cell"] + 1] += row["count"]
    if not good.sum() or not bad.sum():
        return Model(ratios, -np.inf)
    errors = np.cumsum(good) / good.sum() + 1 - np.cumsum(bad) / bad.sum()
    errors[np.cumsum(good) > (1 - KEEP_SHARE) * good.sum()] = np.inf
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return Model(ratios, float(best[len(best) // 2]) * (2 * _REACH / _CELLS) - _REACH)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: Model, extra: list[str]) -> DataFrame:
    """doc_id, the extra columns, the counts, score, base_failed and kept, for every document."""
    spark = docs.sparkSession
    ratios = spark.sparkContext.broadcast(model.ratios)

    def run(batches):
        for batch in batches:
            parts = [measures(raw, offsets, ratios.value) for _, raw, offsets in text_blocks(batch.column("text"))]
            if not parts:
                continue
            columns = [np.concatenate(values) for values in zip(*parts)]
            arrays = [batch.column(name) for name in kept] + [pa.array(x) for x in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *_MEASURES, "score"])

    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    kept = ["doc_id", *extra]
    rows = rows.select(*kept, *([] if "text" in kept else ["text"]))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    counts = ", ".join(f"{name} long" for name in _MEASURES)
    found = rows.mapInArrow(run, f"{types}, {counts}, score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("score") >= F.lit(float(model.threshold)))
    )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(texts(docs), fit(docs, labels), [])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns.

    Rows are numbered through their own text: the verdict is taken per row, so
    repeated doc_ids keep their own verdicts.
    """
    model = fit(docs, labels)
    wide = docs.withColumn("text", F.col("text").cast("string"))
    ratios = docs.sparkSession.sparkContext.broadcast(model.ratios)

    def run(batches):
        for batch in batches:
            column = batch.column("text").fill_null("")
            parts = [measures(raw, offsets, ratios.value) for _, raw, offsets in text_blocks(column)]
            if not parts:
                continue
            found = dict(zip([*_MEASURES, "score"], (np.concatenate(x) for x in zip(*parts))))
            kept = (
                (found["n_words"] >= MIN_WORDS)
                & (100 * found["n_repeat_words"] <= 50 * found["n_words"])
                & (found["score"] >= model.threshold)
            )
            yield batch.filter(pa.array(kept))

    return wide.mapInArrow(run, wide.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(read_documents(spark, sf_dir), labels)

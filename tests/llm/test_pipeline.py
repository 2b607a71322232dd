import itertools

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logspark.llm.common import written
from logspark.llm.quality import judge
from tests.llm import test_quality, test_sentences
from tests.llm.samples import least_reachable, linked, no_documents, odd_documents, plain_rows, shingles
from tests.llm.test_tokens import check_pieces


def test_stages_compare_with_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "packing"]

    good = written(stages["quality"](spark, docs, sf_dir), "good")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {row["doc_id"] for row in judge(docs, labels).where("kept").collect()}
    assert good.columns == columns and {row["doc_id"] for row in good.collect()} == kept

    single = written(stages["near_duplicates"](spark, good, sf_dir), "single")
    sets = {doc_id: shingles(text) for doc_id, text in plain_rows(good)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if linked(sets[a], sets[b])]
    heads = {node for node, least in least_reachable(sets, links).items() if node == least}
    assert single.columns == columns and {row["doc_id"] for row in single.collect()} == heads

    short = written(stages["repeated_passages"](spark, single, sf_dir), "short")
    expected = {row[0]: row[3] for row in test_sentences.plain_cuts(plain_rows(single))}
    assert short.columns == columns
    assert {str(row["doc_id"]): row["text"] for row in short.collect()} == expected
    assert short.where("n_chars <> length(text)").count() == 0

    packed = stages["packing"](spark, short, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    check_pieces(packed, dict(plain_rows(short)), tokenizer, 2048)

    lengths = lambda rows: sorted((row["doc_id"], row["doc_tokens"]) for row in rows if row["start"] == 0)
    assert lengths(corpus_pipeline.run(spark, sf_dir).collect()) == lengths(packed)


def test_odd_and_empty_tables(spark, sf_dir):
    for docs in (odd_documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = written(stage(spark, docs, sf_dir), "stage")
            assert found.columns == docs.columns and found.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_quality_stage_follows_a_single_label_among_many(spark, tmp_path):
    """More labels than are broadcast: all of them place the threshold."""
    docs, known = test_quality.more_labels_than_broadcast(spark)
    known.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id < 60").collect()))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_hands_out_texts_in_small_batches(spark, sf_dir, stage):
    """Three thousand texts of 10,000 bytes: no task gets them all at once."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["bytes", "rows"])

    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    dict(corpus_pipeline.STAGES)[stage](spark, no_documents(spark), sf_dir)
    met = long.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(row["rows"] for row in met) == 3000
    assert max(row["bytes"] for row in met) <= 5_000_000

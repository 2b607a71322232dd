"""From raw documents to packed token windows: the stages, in order, and all of them in a row.

Each stage works on everything its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import read_documents, written
from logspark.llm.ngram_join import one_of_each
from logspark.llm.packing import pack
from logspark.llm.quality import keep_good
from logspark.llm.sentences import without_repeats

TOKENIZER = "word_bpe_49k.json"
# Chunks a worker remembers: fewer than in packing alone, as it also holds what earlier stages left it.
KEPT_CHUNKS = 160_000
# Bytes of an Arrow batch, about: texts are handled in far smaller blocks, and the rest of a batch only waits in memory.
BATCH_BYTES = 4 << 20


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes; stages are carried out after they return, so the bound stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject."""
    small_arrow_batches(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of each group of near-duplicates."""
    small_arrow_batches(spark)
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut sentences of repeated passages out of all but the first document that has them."""
    small_arrow_batches(spark)
    shorter = without_repeats(docs)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        shorter = shorter.withColumn("n_chars", size)
    return shorter.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the ids of all documents into windows."""
    small_arrow_batches(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER), kept=KEPT_CHUNKS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: The stages' model and packing cannot be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, name)
    return docs

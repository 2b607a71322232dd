import zlib
from collections import Counter

import numpy as np

from logspark.llm import sharding
from tests.llm.samples import no_documents, odd_documents, plain_rows


def check(rows, count, shards):
    sizes = Counter(row["shard"] for row in rows)
    assert len(rows) == count and set(sizes) <= set(range(shards))
    assert max(sizes.values()) - min(sizes.get(shard, 0) for shard in range(shards)) <= 1
    for shard in sizes:
        assert sorted(row["slot"] for row in rows if row["shard"] == shard) == list(range(sizes[shard]))


def test_every_order_is_as_likely():
    generator = np.random.Generator(np.random.PCG64(1))
    found = Counter(tuple(sharding.fisher_yates(4, generator)) for _ in range(24_000))
    assert len(found) == 24 and all(850 < times < 1150 for times in found.values())
    assert sharding.fisher_yates(0, generator).tolist() == [] and sharding.fisher_yates(1, generator).tolist() == [0]


def test_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    sharding.write_shards(docs, str(tmp_path / "shards"), 5)
    back = sharding.read_shards(spark, str(tmp_path / "shards"), docs)
    rows = back.collect()
    check(rows, docs.count(), 5)
    assert back.select("record.*").columns == docs.columns
    assert back.select("record.*").exceptAll(docs).count() == 0
    assert sharding.shuffled(no_documents(spark)).count() == 0
    few = sharding.shuffled(odd_documents(spark, ["a", "b", None]), 24).collect()
    check(few, 3, 24)


def test_runs_of_a_bucket_beyond_memory(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_BYTES", 10_000)
    docs = odd_documents(spark, ["x" * 500] * 300).selectExpr("1L AS doc_id", "* EXCEPT (doc_id)")
    check(sharding.shuffled(docs, 4, bucket_bytes=20_000).collect(), 300, 4)


def test_the_seed_decides(spark):
    docs = odd_documents(spark, [str(at) for at in range(400)])
    order = lambda seed, frame: [
        r["record"]["doc_id"] for r in sorted(sharding.shuffled(frame, 3, seed).collect(), key=lambda r: (r["shard"], r["slot"]))
    ]
    one = order(1, docs)
    assert one == order(1, docs.repartition(7)) != order(2, docs)
    # neighbours in the input are spread
    assert np.mean(np.abs(np.diff(one))) > 90


def test_op10(spark, sf_dir):
    docs = dict(plain_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    rows = sharding.op10_two_pass_shuffle(spark, sf_dir).collect()
    check(rows, len(docs), 24)
    for row in rows:
        raw = docs[row["doc_id"]].encode()
        assert (row["size"], row["text_crc32"], row["law"], row["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
